"""Depth from signed events: jumps, running depth, coverage, masks and depth distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import SWEEP_BIN, islands

DEPTHS = ("guide", "correct", "error")


def jumps(intervals: DataFrame, depths: Sequence[str] = DEPTHS) -> DataFrame:
    """Sparse depth changes (contig, pos, one column per depth) of intervals with 0/1 columns named as ``depths``.

    Boundaries at which every change is 0 are left out.
    """
    events = intervals.select(
        "contig",
        F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("sign")))).alias("e"),
        *depths,
    )
    summed = events.groupBy("contig", F.col("e.pos").alias("pos")).agg(*[F.sum(F.col(d).cast("long") * F.col("e.sign")).alias(d) for d in depths])
    some = F.lit(False)
    for d in depths:
        some = some | (F.col(d) != 0)
    return summed.where(some)


def integrate(changes: DataFrame, depths: Sequence[str] = DEPTHS, sweep_bin: int = SWEEP_BIN) -> DataFrame:
    """Runs of constant depth (contig, start, stop, depths) from ``jumps``; ``stop`` is null after the last jump.

    Depths are summed within coarse bins and offset by the sums of the bins
    before, so a contig is not one task.
    """
    binned = changes.withColumn("__bin", F.floor(F.col("pos") / sweep_bin))
    in_bin = Window.partitionBy("contig", "__bin").orderBy("pos")
    totals = binned.groupBy("contig", "__bin").agg(*[F.sum(d).alias(d) for d in depths], F.min("pos").alias("first"))
    over_bins = Window.partitionBy("contig").orderBy("__bin")
    earlier = over_bins.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("contig", "__bin", *[F.coalesce(F.sum(d).over(earlier), F.lit(0)).alias(f"__{d}") for d in depths], F.lead("first").over(over_bins).alias("__next"))
    runs = binned.select(
        "contig",
        "__bin",
        "pos",
        F.lead("pos").over(in_bin).alias("stop"),
        *[F.sum(d).over(in_bin.rowsBetween(Window.unboundedPreceding, 0)).alias(d) for d in depths],
    )
    joined = runs.join(offsets, ["contig", "__bin"])
    return joined.select("contig", F.col("pos").alias("start"), F.coalesce("stop", "__next").alias("stop"), *[(F.col(d) + F.col(f"__{d}")).alias(d) for d in depths])


def coverage_runs(runs: DataFrame, depths: Sequence[str] = DEPTHS) -> DataFrame:
    """Runs with some depth above 0."""
    some = F.lit(False)
    for d in depths:
        some = some | (F.col(d) != 0)
    return runs.where(some & F.col("stop").isNotNull())


def coverage_bases(runs: DataFrame, depths: Sequence[str] = DEPTHS) -> DataFrame:
    """One row per covered base, one-based."""
    return coverage_runs(runs, depths).select("contig", F.explode(F.sequence(F.col("start") + 1, F.col("stop"))).alias("pos"), *depths)


def mask_regions(runs: DataFrame, masked: Column, sweep_bin: int = SWEEP_BIN) -> DataFrame:
    """Maximal regions (contig, start, stop) of adjacent runs for which ``masked`` holds."""
    return islands(runs.where(masked & F.col("stop").isNotNull()).select("contig", "start", "stop"), sweep_bin=sweep_bin)


def depth_histogram(runs: DataFrame, depths: Sequence[str] = DEPTHS) -> DataFrame:
    """Loci for each combination of depths; from the contig's start, uncovered loci before the first jump count too."""
    first = runs.groupBy("contig").agg(F.min("start").alias("stop")).select(F.lit(0).cast("long").alias("start"), "stop", *[F.lit(0).cast("long").alias(d) for d in depths])
    all_runs = first.unionByName(runs.where("stop IS NOT NULL").select("start", "stop", *depths))
    return all_runs.groupBy(*depths).agg(F.sum(F.col("stop") - F.col("start")).alias("loci")).where("loci > 0")


def guide_fractions(runs: DataFrame) -> DataFrame:
    """(fraction, correct_loci, correct_before, error_loci, error_left): loci by share of the guide's depth.

    The window runs over distinct fractions only.
    """
    weight = F.col("stop") - F.col("start")
    there = runs.where("stop IS NOT NULL AND guide > 0")
    c = there.select(F.round(F.col("correct") / F.col("guide"), 6).alias("fraction"), weight.alias("correct_loci"), F.lit(0).cast("long").alias("error_loci"))
    e = there.select(F.round(F.col("error") / F.col("guide"), 6).alias("fraction"), F.lit(0).cast("long").alias("correct_loci"), weight.alias("error_loci"))
    both = c.union(e).groupBy("fraction").agg(F.sum("correct_loci").alias("correct_loci"), F.sum("error_loci").alias("error_loci"))
    up = Window.orderBy("fraction")
    return both.select(
        "fraction",
        "correct_loci",
        F.coalesce(F.sum("correct_loci").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("correct_before"),
        "error_loci",
        F.coalesce(F.sum("error_loci").over(up.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("error_left"),
    )


def accuracy_summary(reads: DataFrame) -> DataFrame:
    """Totals over reads with correct, error and unplaced bases: guide, correct, error, removed, sequenced, total and shares."""
    s = reads.agg(*[F.sum(c).alias(c) for c in ("guide", "correct", "error", "removed", "skipped")])
    unique = F.col("correct") + F.col("error") + F.col("removed")
    return s.select(
        "guide", unique.alias("used"), (unique + F.col("skipped")).alias("total"), "correct", "error", "removed", "skipped",
        F.round(100 * F.col("correct") / unique, 6).alias("correct_pct"), F.round(100 * F.col("error") / unique, 6).alias("error_pct"),
    )


def accuracy_bins(reads: DataFrame, category: str = "category", correct: str = "correct", bins: int = 100, halves: bool = False) -> DataFrame:
    """Reads by category and number of correct bases, empty bins included; or, by halves, under and over half of ``bins``."""
    if halves:
        under = F.col(correct) < (bins + 1) // 2
        return reads.groupBy(category).agg(F.sum(under.cast("long")).alias("under"), F.sum((~under).cast("long")).alias("over"))
    counts = reads.groupBy(category, F.col(correct).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = reads.select(category).distinct().select(category, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    return grid.join(counts, [category, "bin"], "left").select(category, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quality_histogram(df: DataFrame, column: str, top: int) -> DataFrame:
    """Counts of values 0..top, empty ones included, with the running count."""
    counts = df.groupBy(F.col(column).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(top + 1).withColumnRenamed("id", "value")
    full = grid.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("upto", F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
