"""Windows of sequences: k-mer counts, pair spectra, collisions, a k-mer index."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seq import PIECE, pieces

#: Letters that are scanned at a time.
SCAN = 1 << 18


def in_pieces(seqs: DataFrame, overlap: int, width: int = PIECE) -> DataFrame:
    """(id, at, piece): short pieces of sequences with where they begin, see ``pieces``; a window of 1 + ``overlap`` lies in one piece."""
    width = max(width, overlap)
    return seqs.select("id", F.posexplode(pieces(F.col("s"), overlap, width)).alias("at", "piece")).select("id", (F.col("at") * width).alias("at"), "piece")


def exploded(seqs: DataFrame, k: int) -> DataFrame:
    """(id, pos, kmer) of all windows."""
    w = in_pieces(seqs, k - 1, 64).where(F.length("piece") >= k).select("id", "at", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - k)).alias("i"))
    return w.select("id", (F.col("at") + F.col("i")).alias("pos"), F.substring("piece", F.col("i") + 1, F.lit(k)).alias("kmer"))


class Letters:
    """The letters of some pieces, end to end: ``codes`` (code points), ``row`` (piece) and ``left`` (letters from here to the end of the piece) of each."""

    def __init__(self, texts: pa.Array):
        joined = "".join(texts.to_pylist())
        raw = joined.encode("utf-32-le")
        self.text, self.plain = joined, joined.isascii()
        self.codes = np.frombuffer(joined.encode(), np.uint8) if self.plain else np.frombuffer(raw, np.uint32)
        self.lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.arange(len(self.codes)) - self.begin[self.row]
        self.left = self.lengths[self.row] - self.at

    def looked_up(self, table: np.ndarray) -> np.ndarray:
        """``table`` (of 256) at each letter; its last entry stands for all letters beyond."""
        return table[self.codes if self.plain else np.minimum(self.codes, 255)]

    def whole(self, k: int) -> np.ndarray:
        """Whether a window of ``k`` lies in the piece of its first letter, for the letters that such a window fits behind."""
        return self.left[: max(0, len(self.codes) - k + 1)] >= k

    def words(self, starts: np.ndarray, k: int) -> pa.Array:
        """The windows of ``k`` letters at ``starts``."""
        if not self.plain:
            return pa.array([self.text[i : i + k] for i in starts.tolist()], pa.string())
        data = self.codes[starts[:, None] + np.arange(k)].tobytes()
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer((np.arange(len(starts) + 1) * k).astype(np.int32)), pa.py_buffer(data))


def _scans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pieces in slices of about ``SCAN`` letters."""
    size = np.cumsum(pc.binary_length(batch.column("piece")).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SCAN)))
        yield batch.slice(i, j - i)
        i = j


def scanned(seqs: DataFrame, overlap: int, fields: str, find: Callable[[Letters], Iterator[tuple[np.ndarray, list[pa.Array]]]]) -> DataFrame:
    """(id, pos, and ``fields``) of what ``find`` sees in pieces of sequences: starts among the letters, and the columns of ``fields``.

    Many short pieces are looked at together, in arrays, whatever the number
    and length of the sequences.
    """
    names = T.StructType.fromDDL(fields)
    schema = T.StructType([seqs.schema["id"], T.StructField("pos", T.IntegerType()), *names])

    def scan(batches):
        for whole in batches:
            for b in _scans(whole):
                letters = Letters(b.column("piece"))
                first = b.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
                for starts, columns in find(letters):
                    row = letters.row[starts]
                    pos = pa.array((first[row] + letters.at[starts]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pos, *columns], ["id", "pos", *names.names])

    return in_pieces(seqs, overlap).mapInArrow(scan, schema)


def packed(seqs: DataFrame, k: int) -> DataFrame:
    """(id, pos, packed): ``two_bit`` of all windows of up to 31 letters."""
    digits = np.zeros(256, np.int64)
    for i, (upper, lower) in enumerate(("Aa", "Cc", "Gg", "Tt")):
        digits[[ord(upper), ord(lower)]] = i

    def find(letters):
        ok = letters.whole(k)
        value, digit = np.zeros(len(ok), np.int64), letters.looked_up(digits)
        for j in range(k):
            value = value * 4 + digit[j : j + len(ok)]
        starts = np.flatnonzero(ok)
        yield starts, [pa.array(value[starts])]

    return scanned(seqs, k - 1, "packed long", find)


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    return exploded(seqs, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def alphabet(seqs: DataFrame) -> DataFrame:
    """Symbols and how often they occur."""
    symbols = in_pieces(seqs, 0).select(F.explode(F.split("piece", "")).alias("symbol")).where("symbol != ''")
    return symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def pair_spectrum(seqs: DataFrame, k: int, least: int, most: int, cap: int = 100) -> DataFrame:
    """How many pairs of k-mers, the second starting ``least`` to ``most`` (exclusive) after the first, occur 1, 2, ... times.

    Pairs are made within the windows of a short piece (no self-join) and
    counted before they are shuffled: a task has one count for each pair of
    words of A, C, G and T if these are few, others are counted as strings.
    Counts over ``cap`` count as ``cap``.
    """
    overlap = most - 1 + k - 1
    table = 4 ** (2 * k) if 4 ** (2 * k) <= 1 << 22 else 0
    digits = np.full(256, 1 << 40, np.int64)
    digits[[ord(c) for c in "ACGT"]] = range(4)
    every = ["".join(c) for c in itertools.product("ACGT", repeat=k)] if table else []

    def rows(a, b, n):
        return pa.RecordBatch.from_arrays([a, b, pa.array(n.astype(np.int64))], ["a", "b", "n"])

    def count(batches):
        seen = np.zeros(table, np.int64)
        for whole in batches:
            for batch in _scans(whole):
                letters = Letters(batch.column("piece"))
                fits, digit = len(letters.codes) - k + 1, letters.looked_up(digits)
                code = np.zeros(max(fits, 0), np.int64)
                for j in range(k):
                    code = np.minimum(code * 4 + digit[j : j + len(code)], 1 << 40)
                # The first window starts in the piece itself.
                own, together = letters.at[: len(code)] < max(PIECE, overlap), []
                for d in range(least, most):
                    m = max(len(code) - d, 0)
                    ok = own[:m] & (letters.left[:m] >= d + k)
                    if table:
                        first, second = code[:m][ok], code[d : d + m][ok]
                        known = (first < 1 << 40) & (second < 1 << 40)
                        together.append(first[known] * 4**k + second[known])
                        starts = np.flatnonzero(ok)[~known]
                    else:
                        starts = np.flatnonzero(ok)
                    if len(starts):
                        yield rows(letters.words(starts, k), letters.words(starts + d, k), np.ones(len(starts)))
                if together:
                    seen += np.bincount(np.concatenate(together), minlength=table)
        pairs = np.flatnonzero(seen)
        for i in range(0, len(pairs), 1 << 16):
            some, names = pairs[i : i + (1 << 16)], pa.array(every)
            yield rows(names.take(pa.array(some // 4**k)), names.take(pa.array(some % 4**k)), seen[some])

    pairs = in_pieces(seqs, overlap).mapInArrow(count, "a string, b string, n long")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.groupBy(F.least("n", F.lit(cap).cast("long")).alias("times")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("total"))


def digest_collisions(seqs: DataFrame, k: int, bits: int = 128) -> DataFrame:
    """Digests (MD5, cut to ``bits``) that more than one k-mer shares, with the number of k-mers."""
    distinct = exploded(seqs, k).select("kmer").distinct()
    return distinct.groupBy(F.substring(F.md5("kmer"), 1, bits // 4).alias("digest")).agg(F.count(F.lit(1)).alias("kmers")).where("kmers > 1")


def index_entries(seqs: DataFrame, k: int, prefix: int = 4) -> DataFrame:
    """Entries (prefix, kmer, id, pos) of a k-mer index."""
    return exploded(seqs, k).withColumn("prefix", F.substring("kmer", 1, prefix))


def write_index(seqs: DataFrame, k: int, table: str, buckets: int, prefix: int = 4) -> None:
    """A k-mer index as a table, bucketed and sorted by k-mer."""
    rows = index_entries(seqs, k, prefix)
    rows.write.bucketBy(buckets, "kmer").sortBy("kmer", "id", "pos").mode("overwrite").saveAsTable(table)


def read_index(spark, table: str, prefix: Column | None = None) -> DataFrame:
    """Entries (prefix, kmer, id, pos) of an index; ``prefix`` is a condition on the column of that name."""
    index = spark.table(table)
    return index if prefix is None else index.where(prefix)


def index_nodes(index: DataFrame, depth: int) -> DataFrame:
    """(node, kmers, positions): the index as the nodes of a prefix tree, down to ``depth`` letters."""
    nodes = index.select("kmer", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("d")).withColumn("node", F.substring("kmer", F.lit(1), F.col("d")))
    counts = nodes.groupBy("node", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("node").agg(F.count(F.lit(1)).alias("kmers"), F.sum("n").alias("positions"))


def index_faults(index: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """Entries of an index that its sequences do not have, and windows that it lacks: (id, pos, indexed, found), of differing ones."""
    have = index.select("id", F.col("pos").cast("long").alias("pos"), F.col("kmer").alias("indexed"))
    want = exploded(seqs, k).select("id", F.col("pos").cast("long").alias("pos"), F.col("kmer").alias("found"))
    return have.join(want, ["id", "pos"], "full").where(~F.col("indexed").eqNullSafe(F.col("found")))
