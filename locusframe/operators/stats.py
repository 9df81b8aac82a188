"""Count cubes, histograms, smoothing and sample statistics."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import cuts, piece_of, ranked, spread


def count_cube(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def marginals(cube: DataFrame, dims: Sequence[str], joint: Sequence[str] = ()) -> DataFrame:
    """Sums of a cube over each single dimension, and over ``joint`` together: long form (dims as strings, or null, and n)."""
    sets = [[d] for d in dims] + ([list(joint)] if joint else [])
    expanded = cube.withColumn("__set", F.explode(F.array(*[F.lit(i) for i in range(len(sets))])))
    picked = [
        F.when(F.col("__set").isin(*[i for i, s in enumerate(sets) if d in s]), F.col(d).cast("string")).alias(d) for d in dims
    ]
    return expanded.select("__set", *picked, "n").groupBy("__set", *dims).agg(F.sum("n").alias("n")).where("n > 0").drop("__set")


def limits(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest, largest and number of distinct values of each column, in one pass."""
    return df.agg(*itertools.chain.from_iterable((F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_distinct(c).alias(f"n_{c}")) for c in columns))


def truncated_histogram(df: DataFrame, column: str, top: int) -> DataFrame:
    """Counts of 0..top; larger values count as ``top``; empty bins are listed."""
    counts = df.groupBy(F.least(F.col(column).cast("long"), F.lit(top).cast("long")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(top + 1).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def smooth_sd(df: DataFrame, x: str, y: str, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """Weighted standard deviation of y - x around each row: rows within ``reach`` of its x, Gaussian weights.

    Rows of one x have the same neighbours: they are combined first, and only
    distinct values of x meet, by an equi-join on bins of x (and ``by``) with a
    residual. Each then gives its result once for each of its rows.
    """
    base = df.select(*by, F.col(x).cast("double").alias("x"), (F.col(y) - F.col(x)).cast("double").alias("v"))
    places = base.groupBy(*by, "x").agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("v2"), F.count(F.lit(1)).alias("m"))
    at = places.withColumn("bin", F.floor(F.col("x") / reach))
    # A pair of places is made in the bin of the first; each place also gives to the bins beside its own.
    centre = at.select(*by, F.col("x").alias("cx"), F.col("m").alias("cm"), "bin")
    other = at.select(*by, "x", "v", "v2", "m", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = spread(centre, *by, "bin").join(spread(other, *by, "bin"), [*by, "bin"]).where(F.abs(F.col("x") - F.col("cx")) <= reach)
    w = F.exp(-0.5 * F.pow((F.col("x") - F.col("cx")) / reach, 2))
    sums = near.withColumn("w", w).groupBy(*by, "bin", "cx", "cm").agg(
        F.sum(F.col("w") * F.col("m")).alias("sw"), F.sum(F.col("w") * F.col("w") * F.col("m")).alias("sw2"), F.sum(F.col("w") * F.col("v")).alias("swv"), F.sum(F.col("w") * F.col("v2")).alias("swv2"), F.sum("m").alias("n")
    )
    around = F.col("swv2") - F.col("swv") * F.col("swv") / F.col("sw")
    factor = F.col("sw") / (F.col("sw") * F.col("sw") - F.col("sw2"))
    found = sums.where("n > 1").select(*by, F.col("cx").alias("x"), "n", F.sqrt(F.greatest(F.lit(0.0), factor * around)).alias("sd"), "cm")
    return found.select(*by, "x", "n", "sd", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cm")))).drop("col")


def _counted(df: DataFrame, column: str, by: Sequence[str], pieces: int) -> DataFrame:
    """(by, value, n, before, total): distinct values of each group, how often they occur, the rows below them, all rows.

    Values are combined before the shuffle and summed in order piece by piece
    (``pieces`` at most), so neither a group nor a value is one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.withColumn("__piece", piece_of(F.col("value"), cuts(df, column, pieces)))
    group = Window.partitionBy(*by)
    sums = parts.groupBy(*by, "__piece").agg(F.sum("n").alias("__n"))
    sums = sums.select(*by, "__piece", F.coalesce(F.sum("__n").over(group.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"), F.sum("__n").over(group).alias("total"))
    within = Window.partitionBy(*by, "__piece").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__piece") == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    sums = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__piece").alias("__p"), "__below", "total")
    counted = parts.withColumn("__in", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return counted.join(sums, same).select(*by, "value", "n", (F.col("__below") + F.col("__in")).alias("before"), "total")


def windowed_mode(df: DataFrame, column: str, width: int, by: Sequence[str] = (), pieces: int = 128) -> DataFrame:
    """The most crowded value of each group (by, mode, density): the first with the greatest density.

    With the values in order, a place's density is one over its distance to the
    value ``width`` places on, plus that of the place ``width`` places before.
    Past the end the last known density counts, before the begin the first; the
    very first place has its own alone. Equal values have infinite density.
    Groups of no more than ``width`` rows have none.
    """
    ranks = _counted(df, column, by, pieces).where(F.col("total") > width)
    # A value that fills more than ``width`` places is at distance 0 of itself: its first place wins, its last ones are not needed.
    places = ranks.withColumn("i", F.explode(F.sequence(F.col("before"), F.col("before") + F.least(F.col("n"), F.lit(width + 1)) - 1))).select(*by, "value", "i", "total")
    on = places.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("value").alias("__on"), F.col("i").alias("__i"))

    def same(at: Column) -> Column:
        cond = F.col("__i") == at
        for b in by:
            cond = cond & F.col(b).eqNullSafe(F.col(f"__{b}"))
        return cond

    gap = (F.col("__on") - F.col("value")).cast("double")
    ahead = places.join(on, same(F.col("i") + width)).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("i").alias("__i"), F.when(gap > 0, F.lit(1.0) / F.nullif(gap, F.lit(0.0))).otherwise(float("inf")).alias("__d"))
    right = places.join(ahead, same(F.least(F.col("i"), F.col("total") - width - 1))).select(*by, "value", "i", F.col("__d").alias("right"))
    both = right.join(ahead, same(F.greatest(F.col("i") - width, F.lit(0))))
    density = F.when(F.col("i") == 0, F.col("right")).otherwise(F.col("right") + F.col("__d"))
    best = F.max(F.struct(density.alias("density"), (-F.col("i")).alias("first"), "value"))
    return both.groupBy(*by).agg(best.alias("m")).select(*by, F.col("m.value").alias("mode"), F.col("m.density").alias("density"))


def quantiles(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str] = (), pieces: int = 128) -> DataFrame:
    """Exact interpolated quantiles of each group, one row per quantile.

    Approximate cuts split the values; exact counts below each piece then tell
    the one that a quantile lies in.
    """
    counted = _counted(df, column, by, pieces).withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    place = F.col("quantile") * (F.col("total") - 1)
    lower, upper = F.floor(place), F.ceil(place)
    holds = lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))
    ends = counted.where(holds(lower) | holds(upper)).groupBy(*by, "quantile").agg(
        F.max(F.when(holds(lower), F.col("value"))).alias("lo"), F.max(F.when(holds(upper), F.col("value"))).alias("hi"), F.max(place - lower).alias("share")
    )
    return ends.select(*by, "quantile", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("value"))


def dimension_ranks(df: DataFrame, columns: Sequence[str], tie: str, pieces: int = 128) -> DataFrame:
    """``df`` with rank_<column>, the 0-based place of each row along each column (numerical distribution); ``tie`` orders equal values."""
    for c in columns:
        df = ranked(df, [piece_of(F.col(c), cuts(df, c, pieces))], [c, tie], f"rank_{c}").withColumn(f"rank_{c}", F.col(f"rank_{c}") - 1)
    return df


def mean_and_rank(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Mean of each group and the rank of that mean."""
    means = df.groupBy(*by).agg(F.avg(column).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), *by)).cast("long"))
