"""Global ranks without a task that sees all rows, and scans with too few splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, coarse: Sequence[Column], keys: Sequence[Column | str], to: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank under (``coarse``, ``keys``).

    ``coarse`` leads the order and splits the rows into groups of moderate size;
    their counts are summed in order (one row per group), and rows are numbered
    within their group.
    """
    names = [f"__c{i}" for i in range(len(coarse))]
    grouped = df.withColumns(dict(zip(names, coarse, strict=True)))
    counts = grouped.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(n).alias(f"{n}_") for n in names], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = grouped.withColumn("__within", F.row_number().over(Window.partitionBy(*names).orderBy(*keys)))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return numbered.join(counts, same).withColumn(to, (F.col("__before") + F.col("__within")).cast("long")).select(*df.columns, to)


def lagged(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], bin_: Column, to: str = "previous") -> DataFrame:
    """``df`` with ``value`` of the row before, by ``order`` within ``keys``; no task sees all rows of a key.

    ``bin_`` leads the order: rows are looked at within a bin, and the first of
    a bin gets the last value of the bin before (one row per bin).
    """
    marked = df.withColumn("__bin", bin_)
    within = Window.partitionBy(*keys, "__bin").orderBy(*order)
    last = marked.groupBy(*keys, "__bin").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bin")
    before = last.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bin").alias("__b"), F.lag("__last").over(across).alias("__before"))
    same = F.col("__bin").eqNullSafe(F.col("__b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    numbered = marked.withColumn("__n", F.row_number().over(within)).withColumn("__lag", F.lag(value).over(within))
    return numbered.join(before, same).select(*df.columns, F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__lag")).alias(to))


def cuts(df: DataFrame, column: str, pieces: int = 128) -> list:
    """Values that split a numeric column into about equal pieces: a bounded list, the same for the same rows."""
    at = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.approx_percentile(column, F.array(*[F.lit(q) for q in at]), F.lit(20 * pieces)).alias("q")).first()["q"]
    return sorted(set(found or []))


def piece_of(column: Column, at: Sequence) -> Column:
    """Number of ``cuts`` that are not above a value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(at[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(at))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A scan, its rows dealt out by ``keys`` if it has fewer splits than there are cores (a file that is one row group); else as it is.

    For work that costs much for each row. ``df`` must be without a shuffle, so that its splits are known from its plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its rows sent by ``keys`` to as many tasks as a shuffle has: small rows that make much work each are not put together in a few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder that all executors share, for plans that read it several times; as it is where there is no such folder."""
    try:
        from ..llm._common import work_dir, write_shared

        path = work_dir(df.sparkSession, label)
    except (ImportError, RuntimeError):
        return df
    return write_shared(df, path)
