"""Operators for building language-model training data.

The rest of the package never imports this subpackage.
"""
