"""Mixing sources to target weights by hash thresholds.

Every document gets a hash in [0, 2**60). A source that must give ``target``
words of its ``source_size`` gives every document ``full = target div
source_size`` times, and once more the documents whose hash is below a
threshold. The threshold is found without sorting: words are summed by source
and the top 12 bits of the hash, the bucket where the running sum passes the
remainder is found, and only that bucket is refined by its next 12 bits, until
one hash value is left; it is taken if that comes nearer to the target. A
larger budget moves the threshold up, so mixes for growing budgets are nested.

Hot sources are summed in partial aggregates before any shuffle; documents meet
the thresholds (one row per source) in a join that Spark broadcasts only where
the measured table is small and that can be split otherwise.

Defined results: null text has 0 words and is taken 0 words; a null source is
a source of its own, the last; the order of sources is by code point. Rows
equal in ``doc_id`` and text share a hash, so they are taken together. If all
sizes are 0 every target is 0. An empty table gives an empty result. Columns of
the input other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import packed, word_count, work_dir, write_shared

#: A document is given at most so many times.
MAX_REPEATS = 3
#: Sources in order weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: Bits of the hash by which each pass refines, and passes at most (60 bits).
LEVEL_BITS, LEVELS = 12, 5


def doc_hash() -> Column:
    """60 bits of the MD5 of doc_id and text; the same in every engine."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Targets from (source, source_size): adds ``target``.

    Sharing the excess of capped sources by weight, again and again, ends
    where every source gets ``min(cap * size, level * weight)``; the level is
    found by going through the sources in order of the level that caps them.
    The single-partition windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        w.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # The first source, in this order, whose cap is not reached at the level of its rest fixes the level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    w = w.withColumn("final", level["level"])
    return w.select(
        "source",
        "source_size",
        F.when((F.col("final") * F.col("weight")) > F.col("cap"), F.col("cap").cast("double"))
        .otherwise(F.col("final") * F.col("weight"))
        .alias("target"),
    )


def thresholds(sized: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """(source, source_size, target, full, below): documents hashed under ``below`` are given once more.

    ``sized`` has (source, h, size) and is read once for the histogram and once
    for each refinement, where only rows of the boundary buckets count.
    """
    rest = F.col("target") - F.col("full") * F.col("source_size")
    open_ = (
        targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", rest)
        .withColumn("prefix", F.lit(0).cast("long"))  # the bucket so far
        .withColumn("below", F.lit(0).cast("long"))  # hashes under it are taken
        .withColumn("taken", F.lit(0).cast("long"))
    )
    state = write_shared(open_, f"{path}/level-0")
    total_bits = LEVEL_BITS * LEVELS
    for level in range(1, LEVELS + 1):
        shift = total_bits - level * LEVEL_BITS
        s = state.select(F.col("source").alias("src"), "prefix", "rest", "taken").where("rest > 0")
        hist = (
            sized.join(
                s,
                F.col("source").eqNullSafe(F.col("src"))
                & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")),
            )
            .groupBy("source", "prefix", "rest", "taken", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        # The boundary bucket: the first whose words bring the sum past the rest.
        edge = (
            hist.withColumn("sum", F.col("taken") + F.coalesce(F.sum("words").over(run), F.lit(0)))
            .where(F.col("sum") + F.col("words") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "sum", "words", "lo", "hi")).alias("edge"))
            .select(F.col("source").alias("src"), "edge")
        )
        one = F.col("edge.lo") == F.col("edge.hi")
        nearer = (F.col("edge.sum") + F.col("edge.words") - F.col("rest")) < (F.col("rest") - F.col("edge.sum"))
        start = F.shiftleft(F.col("edge.bucket"), shift)
        merged = (
            state.join(edge, F.col("source").eqNullSafe(F.col("src")), "left")
            .select(
                "source", "source_size", "target", "full",
                F.when(F.col("edge").isNull() | one, F.lit(0.0)).otherwise(F.col("rest")).alias("rest"),
                F.coalesce(F.col("edge.bucket"), F.col("prefix")).alias("prefix"),
                F.when(F.col("edge").isNull(), F.col("below"))
                .when(one & nearer, F.col("edge.hi") + 1)
                .when(one, F.col("edge.lo"))
                .otherwise(start).alias("below"),
                F.when(F.col("edge").isNull(), F.col("taken")).otherwise(F.col("edge.sum")).alias("taken"),
            )
        )
        state = write_shared(merged, f"{path}/level-{level}")
        if not state.where("rest > 0").head(1):
            break
    return state.select("source", "source_size", "target", "full", "below")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, source, h, size, source_size, target, copies, taken.

    ``copies`` is how often the mix gives the document, ``taken`` its words in
    the mix; the target of a source is its share of the words of all documents.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "mix")
    sized = write_shared(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", doc_hash().alias("h"), word_count(F.col("text")).alias("size")),
        f"{path}/sized",
    )
    totals = write_shared(sized.groupBy("source").agg(F.sum("size").alias("source_size")), f"{path}/totals")
    plan = thresholds(sized.select("source", "h", "size"), source_targets(totals, weights, cap), path)
    plan = plan.withColumnRenamed("source", "src")
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("long")
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("src")))
        .withColumn("copies", copies)
        .select("doc_id", "source", "h", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: every document as often as it is given, with its columns.

    Documents meet the verdicts on (doc_id, hash of doc_id and text), so that
    repeated rows and null ids come out right.
    """
    verdict = mix(docs, weights, cap).where("copies > 0").select("doc_id", "h", "source", "copies").dropDuplicates()
    d, v = packed(docs, h=doc_hash(), doc_id=F.col("doc_id").cast("long"), source=F.col("source")).alias("d"), verdict.alias("v")
    same = F.expr("d.h = v.h AND d.doc_id <=> v.doc_id AND d.source <=> v.source")
    return d.join(v, same).select("row", F.explode(F.expr("sequence(1L, v.copies)"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         source_size * 3 AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS capped_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weight
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped_before)::DOUBLE / (all_weight - weight_before) AS level FROM o),
f AS (SELECT first(level ORDER BY cap::DOUBLE / weight, level) AS final FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size,
         CASE WHEN final * weight > cap THEN cap::DOUBLE ELSE final * weight END AS target
  FROM l, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS fully FROM t),
u AS (  -- one row per source and hash, with the words up to it
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM d GROUP BY source, h),
k AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.fully,
         p.target - p.fully * p.source_size AS rest, u.upto, u.words
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
         JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h)
SELECT doc_id, size, source_size, target,
       size * (fully + CASE WHEN rest > 0 AND (upto <= rest
                 OR (upto - words <= rest AND upto - rest < rest - (upto - words))) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM k
"""
