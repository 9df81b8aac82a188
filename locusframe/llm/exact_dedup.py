"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row per
distinct text that names its document, and one per later batch that has it
again, with its count. New documents are reduced to one row per digest (partial
aggregation, so that a text with very many copies is combined before the
shuffle), deduplicated against the index by a sort-merge anti-join that needs
no shuffle of the index, and what is new is appended.

Every row carries its batch, a digest of the batch's texts and documents. Rows of
the same batch do not count when it is looked up, and are not appended twice: a
batch that is run again, because its driver was lost after appending or half
way, gives the result of its first run.

Defined results: null text counts as empty; texts are equal when identical
after deleting every character of ``[\\x20\\x09-\\x0D]``; of equal new texts the
one with the most code points stays, then the smallest ``doc_id`` (a null
``doc_id`` loses to any other); a text that the index already holds keeps the
document that the index names. Repeated rows are counted one by one; of rows
that share text and ``doc_id``, all carry the same ``kept`` value. Texts of any
length are digested whole. An empty table gives an empty result. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import packed, remove_shared, shuffle_width, work_dir, write_shared

_INDEX_SCHEMA = "digest binary, keep_id long, keep_chars int, seen long, batch long, named boolean"
_COLUMNS = [c.split()[0] for c in _INDEX_SCHEMA.split(", ")]


class DigestIndex:
    """A digest table at ``path``; opened again by naming the same path.

    ``buckets`` must be the same each time. Appending writes one file per
    bucket; ``compact`` rewrites the table so that each bucket is one sorted
    file again, with one row per text: its batches are then one, and old ones can
    not be run again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or shuffle_width(spark)
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({_INDEX_SCHEMA}) USING parquet OPTIONS (path '{path}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds rows (the index's columns) that it lacks."""
        (
            groups.repartition(self.buckets, "digest")
            .select(*_COLUMNS)
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def compact(self, path: str) -> DigestIndex:
        """A copy at ``path`` with one sorted file per bucket and one row per text."""
        other = DigestIndex(self.spark, path, self.buckets)
        own = F.when(F.col("named"), F.struct("keep_id", "keep_chars"))
        whole = self.table().groupBy("digest").agg(F.max(own).alias("k"), F.sum("seen").alias("seen"))
        other.append(whole.select("digest", "k.keep_id", "k.keep_chars", "seen", F.lit(0).cast("long").alias("batch"), F.lit(True).alias("named")))
        return other

    def missing(self, groups: DataFrame, batch: int) -> DataFrame:
        """The rows of ``groups`` whose digest no other batch has named (sort-merge anti-join)."""
        named = self.table().where(F.col("named") & (F.col("batch") != batch)).select("digest")
        return groups.join(named.hint("merge"), "digest", "left_anti")

    def known(self, groups: DataFrame, batch: int) -> DataFrame:
        """(digest, old_id, is_old, old_seen) of the digests of ``groups`` that other batches have; buckets are summed without a shuffle."""
        others = self.table().where(F.col("batch") != batch).groupBy("digest")
        told = others.agg(F.max(F.when(F.col("named"), F.struct("keep_id"))).alias("k"), F.sum("seen").alias("old_seen"))
        found = groups.select("digest").join(told.hint("merge"), "digest")
        return found.select("digest", F.col("k.keep_id").alias("old_id"), F.col("k").isNotNull().alias("is_old"), "old_seen")

    def drop(self) -> None:
        """Removes the index, its entry in the catalog and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_shared(self.spark, self.path)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest): code points of the text and SHA-256 of the text without white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).alias("n"),
        F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)).alias("digest"),
    )


def dedup(docs: DataFrame, index: DigestIndex, batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``group_size`` counts the documents with that text, here and in the other
    batches of the index, which is extended as a side effect. ``batch`` names the
    batch; by default its content does.
    """
    spark = docs.sparkSession
    here = work_dir(spark, "digests")
    rows = write_shared(digests(docs), f"{here}/rows")
    best = F.struct((-F.col("n")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    groups = write_shared(
        rows.groupBy("digest")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("seen"))
        .select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_chars"), "seen"),
        f"{here}/groups",
    )
    if batch is None:
        batch = groups.agg(F.bit_xor(F.xxhash64("digest", "keep_id", "keep_chars", "seen"))).first()[0] or 1
    known = write_shared(index.known(groups, batch), f"{here}/known")
    there = index.table().where(F.col("batch") == batch).select("digest")
    new = index.missing(groups, batch).withColumn("named", F.lit(True))
    again = groups.join(known.where("is_old").select("digest"), "digest", "left_semi").withColumn("named", F.lit(False))
    index.append(new.unionByName(again).withColumn("batch", F.lit(batch)).join(there.hint("merge"), "digest", "left_anti"))
    old = F.coalesce("is_old", F.lit(False))
    resolved = groups.join(known, "digest", "left").select(
        "digest", F.when(old, F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), (F.col("seen") + F.coalesce("old_seen", F.lit(0))).alias("group_size"), old.alias("is_old")
    )
    # Few groups may hold most rows; this join's large partitions are split at run time.
    return rows.join(resolved, "digest").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (~F.col("is_old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, with all their columns (equal rows all stay or go)."""
    kept = dedup(docs, index).where("kept").select("doc_id", "text_sha256").distinct().alias("k")
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    d = packed(docs, doc_id=F.col("doc_id").cast("long"), digest=digest).alias("d")
    return d.join(kept, F.expr("d.doc_id <=> k.doc_id AND d.digest = k.text_sha256"), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, work_dir(spark, "digest-index"))
    found = dedup(docs, index)
    index.drop()  # what the result needs of it is written
    return found


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
