"""Spark-native analytics over alignments, intervals and sequences.

Everything here returns a lazy DataFrame; nothing is collected to the driver
except sizes that are bounded by a documented parameter.
"""
