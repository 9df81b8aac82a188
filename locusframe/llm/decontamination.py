"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the number of their word shingles. A partition
of items of up to ``m`` shingles keeps the ``k`` smallest hash values of each
(a bottom-k MinHash sketch), with ``k = floor((1 - t) m) + 1`` and ``MOST`` at
most: an item of which a document contains a share of at least ``t`` lacks at
most ``(1 - t) m`` shingles there, so the document holds one of the k values -
always for items of fewer than ``MOST / (1 - t)`` shingles, otherwise except with
probability ``(1 - t) ** MOST`` (1e-14). Documents, of any length, are probed
with all their shingles; an item is a candidate if enough of its values are
found (all but those that the lacking shingles may take; ``FEW`` where the sketch
is cut to ``MOST`` values, which misses a leak with a probability under 4e-10), so
items that share a boilerplate passage are no candidates of each other's
documents. Every candidate is verified by its exact shingle containment in the
same pass over the documents, which needs no shuffle.

The items are a stated query set: distinct texts are read in blocks whose size
is bounded (``BLOCK_CHARS``), and only a block is sent to the executors; each
block reads the documents once. Items with the same text are told apart
afterwards, in a join on the digest of the text, however many there are.

Defined results: words are runs of other than ``[\\x20\\x09-\\x0D]`` with A-Z in
lower case, shingles have five; an item of fewer words is one shingle of all of
them and matches that run of words anywhere. Null or wordless texts match
nothing. Repeated documents or items give repeated rows; null ids are kept. Of
documents that share an id, or have none, each is judged by its own text. Texts
of any length are read whole. Empty tables give an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import give_back, packed, read_table, slices, work_dir, write_shared
from ._shingles import U64, gram_hashes, word_hashes, words_of

#: Words of a shingle; share of an item's shingles that makes a leak, in per cent.
SHINGLE, PERCENT = 5, 80
#: Values of a sketch at most, and how many of so many a candidate needs.
MOST, FEW = 20, 3
#: Characters of item text in one block.
BLOCK_CHARS = 50_000_000

_PAIRS = "doc_id long, item string, n_item long, n_common long"
_BITS = 20


class ItemIndex:
    """Sketches of a block of items, by size partition, and their shingle sets."""

    def __init__(self, items: list[tuple[str, str | None]], shingle: int, percent: int):
        self.items: list[tuple[str, np.ndarray]] = []
        needs: list[int] = []
        probes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            h = word_hashes(words_of(text))
            if not len(h):
                continue
            n = min(shingle, len(h))
            grams = np.unique(gram_hashes(h, n))
            partition = 1 << int(len(grams) - 1).bit_length()  # sizes over half of it, up to it
            lacking = len(grams) * (100 - percent) // 100
            k = min(partition * (100 - percent) // 100 + 1, MOST, len(grams))
            needs.append(k - lacking if k > lacking and k < MOST else min(FEW, k))
            for value in grams[:k].tolist():  # the hash is a random order, so the first are a MinHash sketch
                probes[n][value].append(len(self.items))
            self.items.append((item_id, grams))
        self.needs = np.array(needs, np.int64)
        self.by_length = []
        for n, table in probes.items():
            seen = np.zeros(1 << _BITS, bool)
            seen[np.fromiter(table, U64, len(table)) >> U64(64 - _BITS)] = True
            self.by_length.append((n, seen, {v: np.array(i, np.int64) for v, i in table.items()}))

    def matches(self, text: str | None, percent: int) -> Iterator[tuple[str, int, int]]:
        """(item, size, shingles in common) of the items that the text contains."""
        h = word_hashes(words_of(text))
        for n, seen, table in self.by_length:
            if len(h) < n:
                continue
            grams = gram_hashes(h, n)
            near = grams[seen[grams >> U64(64 - _BITS)]]
            met = [table[value] for value in set(near.tolist()) if value in table]
            if not met:
                continue
            items, hits = np.unique(np.concatenate(met), return_counts=True)
            own = None
            for i in items[hits >= self.needs[items]].tolist():
                own = np.unique(grams) if own is None else own
                item_id, wanted = self.items[i]
                at = np.searchsorted(own, wanted)
                at[at == len(own)] = 0
                common = int(np.count_nonzero(own[at] == wanted))
                if 100 * common >= percent * len(wanted):
                    yield item_id, len(wanted), common


def _item_blocks(items: DataFrame, shingle: int, percent: int, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """The index of each block of distinct item texts, by digest, broadcast, and whether there are several."""
    spark = items.sparkSession
    items = items.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = items.select(F.md5("text").alias("item"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars) // block_chars + 1
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in part.collect()], shingle, percent)), blocks > 1


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, n_item, n_common, containment."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = []
    for index, several in _item_blocks(items, shingle, percent, block_chars):

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids = b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
                rows = [(d, *m) for d, text in zip(ids, b["text"], strict=True) for m in index.value.matches(text, percent)]
                yield pd.DataFrame(rows, columns=["doc_id", "item", "n_item", "n_common"]).astype({"doc_id": "Int64"})

        part = texts.mapInPandas(run, _PAIRS)
        found.append(write_shared(part, work_dir(spark, f"leaks-{len(found)}")) if several else part)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    ids = items.where("text IS NOT NULL").select(F.md5(F.col("text").cast("string")).alias("item"), F.col("item_id").cast("long").alias("item_id"))
    return pairs.join(ids, "item").select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item, with all their columns; each row by its own text, whatever its id."""
    for block, (index, several) in enumerate(_item_blocks(items, shingle, percent, block_chars)):
        docs = _without(docs, index, percent)
        if several:
            docs = write_shared(docs, work_dir(docs.sparkSession, f"clean-{block}"))
    return docs


def _without(docs: DataFrame, index: Broadcast, percent: int) -> DataFrame:
    """The rows whose text contains no item of the index."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([next(index.value.matches(t, percent), None) is None for part in slices(batch) for t in part.to_pylist()], pa.bool_())
        give_back()

    return packed(docs, clean=clean(F.coalesce(F.col("text").cast("string"), F.lit("")))).where("clean").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
i AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
  FROM iw, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(p) WHERE len(w) > 0),
size AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
lengths AS (SELECT DISTINCT n FROM i),
d AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM dw, lengths, unnest(range(1, len(w) - n + 2)) AS t(p)),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (n, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_common::BIGINT AS n_common, n_common::DOUBLE / n_item AS containment
FROM c JOIN size USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""
