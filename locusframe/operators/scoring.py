"""Scores of alternative alignments: strata, primaries, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_two(df: DataFrame, worst: int = 0, larger_better: bool = True, group: str = "fid", score: str = "score") -> DataFrame:
    """Best and second best distinct score of each fragment; ``worst`` where there is no second."""
    ranked = df.select(group, score).distinct().withColumn("r", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(score) if larger_better else F.asc(score))))
    return ranked.where("r <= 2").groupBy(group).agg(F.max(F.when(F.col("r") == 1, F.col(score))).alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col(score))), F.lit(worst)).alias("second"))


def strata(df: DataFrame, preference: str, larger_better: bool = True) -> DataFrame:
    """``df`` with ``rank`` (dense, by score, then by place of the space in ``preference``) and ``stratum_size``."""
    space_order = F.instr(F.lit(preference), F.col("space"))
    first = F.desc("score") if larger_better else F.asc("score")
    by = Window.partitionBy("fid").orderBy(first, space_order)
    same = Window.partitionBy("fid", "score", "space")
    return df.withColumn("rank", F.dense_rank().over(by).cast("long")).withColumn("stratum_size", F.count(F.lit(1)).over(same))


def primary(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` (with ``rank``) with ``primary``: the first record of the best stratum."""
    w = Window.partitionBy("fid").orderBy("rank", *order)
    return df.withColumn("primary", F.row_number().over(w) == 1)


def lookup_mapq(df: DataFrame, calibration: DataFrame, default: int = 0) -> DataFrame:
    """``df`` (score) with ``mapq`` from ``calibration`` (top, second, given, mapq) and the fragment's two best scores."""
    tops = top_two(df)
    table = calibration.select("top", "second", F.col("given").alias("score"), F.col("mapq").alias("calibrated"))
    joined = df.join(tops, "fid").join(table, ["top", "second", "score"], "left")
    return joined.select(*[c for c in df.columns if c != "mapq"], "top", "second", F.coalesce("calibrated", F.lit(default)).cast("long").alias("mapq"))


def calibrate(df: DataFrame, right: Column) -> DataFrame:
    """(top, second, given) -> numbers of right and wrong records, and the Phred quality they make."""
    tops = top_two(df)
    counts = df.join(tops, "fid").groupBy("top", "second", F.col("score").alias("given")).agg(F.sum(right.cast("long")).alias("right"), F.sum((~right).cast("long")).alias("wrong"))
    share = (F.col("wrong") + 1) / (F.col("right") + F.col("wrong") + 2)
    return counts.withColumn("mapq", F.least(F.lit(255), F.round(-10 * F.log10(share))).cast("long"))


def score_fragments(df: DataFrame, calibration: DataFrame, preference: str, order: list[str | Column]) -> DataFrame:
    """Strata, primary flags and mapping qualities in one."""
    return lookup_mapq(primary(strata(df, preference), order), calibration)
