"""Token-id files with one shared zstandard dictionary.

A corpus is a folder of shards. A shard holds documents in ascending order of
doc_id (null first, then by a hash of the text), each compressed by itself
with a dictionary that was trained on serialized id arrays, so that a short
document can be read alone at a good ratio::

    magic "LFTOK1\\0\\0" | dictionary SHA-256 (32 bytes) | id width (u32) | 4 zero bytes
    one zstandard frame for each document
    index: doc_id i64[n], has_id u8[n], offset u64[n + 1], tokens u64[n]
    index offset (u64) | n (u64) | magic

A shard ends at ``SHARD_BYTES`` or ``SHARD_DOCS``, whatever the size of the
corpus; a task that has more writes several, in order.

Ids are little-endian unsigned integers of 2 bytes where the vocabulary allows,
else of 4. Beside the shards lie ``dictionary.zdict`` and ``manifest`` (Parquet,
one row per shard: order, file, documents, tokens, bytes). A task writes its
shards under names of its own and moves them into place; only shards that the
manifest names count, and what lost or repeated tasks left is deleted at the end.

Defined results: null text counts as empty and is just the end id; repeated
rows are written as often as they come, next to each other; an empty table gives
a corpus of no shards. Texts of any length are encoded whole. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, filterfalse, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import give_back, open_store, read_table, shuffle_width, small_batches, work_dir, write_shared

MAGIC = b"LFTOK1\0\0"
_HEAD, _TAIL = struct.Struct("<8s32sII"), struct.Struct("<QQ8s")
#: The dictionary: its size, and documents (and bytes of each) that it is trained on at most.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 64 << 10, 2000, 16 << 10
LEVEL = 3
#: A shard ends when it has so many bytes or documents.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1 << 20
#: Bytes of a table, as the planner knows them, for each task that writes.
TASK_BYTES = 256 << 20
#: Documents that a reader hands on at a time.
READ_DOCS = 1 << 16
#: Bytes of text, about, that a worker encodes at a time.
CHUNK = 6 << 20
#: Entries of a worker's memo of parts before it is emptied.
MEMO = 600_000

# How the tokenizer splits texts, and the same for lower-case plain text.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII, and Latin letters whose lower case is one letter among them.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_LETTER = "a-zÀ-ÖØ-öø-ſ"
# Alternatives that begin differently may stand in any order; the commonest stands first. The line feed parts words.
PARTS = re.compile(f"[{_LETTER}]+|\n|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\r0-9{_LETTER}]+")

_MANIFEST = "shard long, file string, n_docs long, n_tokens long, n_bytes long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A tokenizer that lowers case, drops white space and encodes each run of
    letters, each digit and each run of other characters by itself (``PARTS``)
    gives a text the ids of its parts in a row. So the library encodes each
    distinct part once, many at a time; the distinct words of a chunk of texts
    are put together from parts, and the texts from words, as arrays. Words with
    other than plain characters go to the library by themselves; texts with the
    string of an added token, and all texts of any other tokenizer, as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.in_parts = self._in_parts()

    def _in_parts(self) -> bool:
        """Whether the tokenizer's definition is the one that ``PARTS`` is written for."""
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        splits = [x["pattern"]["Regex"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"]]
        return steps == NORMALIZER and splits == [PRE_TOKENS] and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>"

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 20_000):
            chunks = [parts[j : j + 500] for j in range(i, min(i + 20_000, len(parts)), 500)]
            encoded = self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)
            for chunk, e in zip(chunks, encoded, strict=True):
                ids = np.array(e.ids, np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1  # every part ends with one id that ends a word
                if len(cuts) != len(chunk):
                    self.parts.update((p, self._ids(p)) for p in chunk)
                    continue
                data, at = ids.astype(self.type).tobytes(), 0
                for p, cut in zip(chunk, (cuts * self.width).tolist(), strict=True):
                    self.parts[p] = data[at:cut]
                    at = cut

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): where the ids of each distinct word lie."""
        is_plain = np.fromiter((PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        found = PARTS.findall("\n".join([*compress(words, is_plain), ""]).lower())  # a line feed after each word
        if len(self.parts) > MEMO:
            self.parts.clear()
        self.parts["\n"] = b""
        self._learn_parts(list(set(filterfalse(self.parts.__contains__, found))))
        data = list(map(self.parts.__getitem__, found))
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // self.width
        ends = np.cumsum(sizes)[sizes == 0]  # only the line feed has no ids
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[is_plain] = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        size[is_plain] = ends - first[is_plain]
        at = int(ends[-1]) if len(ends) else 0
        for i in np.flatnonzero(~is_plain).tolist():
            ids = self._ids(words[i]) if words[i] else b""
            data.append(ids)
            first[i], size[i] = at, len(ids) // self.width
            at += len(ids) // self.width
        return np.frombuffer(b"".join(data), self.type), first, size

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The serialized ids of each text (strings without null)."""
        if not self.in_parts:
            for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, self.type).tobytes()
            return
        special = np.zeros(len(texts), bool)
        for a in self.added:
            special |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        # White space is just the six ASCII characters here.
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, first, sizes = self._encode_words(words.dictionary.to_pylist())
        at = words.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        place = np.repeat((first[at] - (ends - counts)).astype(small), counts)
        place += np.arange(total, dtype=small)
        flat = ids[place]
        del place
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i, own in enumerate(special.tolist()):
            yield self._ids(texts[i].as_py()) if own else flat[bounds[i] : bounds[i + 1]].tobytes()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        return self.encode(pa.array(texts, pa.string()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget_parts() -> None:
    """Empties the memos of the worker's encoders."""
    for enc in _encoders.values():
        enc.parts = {}


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the ids of at most ``SAMPLE_DOCS`` documents; empty bytes if they are too few."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = [r[0] or "" for r in chosen.select(F.substring("text", 1, SAMPLE_BYTES)).limit(SAMPLE_DOCS).collect()]
    enc = encoder(tokenizer)
    end = np.array([end_id], enc.type).tobytes()
    samples = [(x + end)[:SAMPLE_BYTES] for i in range(0, len(texts), 200) for x in enc.batch(texts[i : i + 200])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    def __init__(self, uri: str, name: str, width: int, dictionary: bytes):
        self.fs, folder = open_store(uri)
        self.fs.create_dir(folder, recursive=True)
        self.path, self.name = f"{folder}/{name}", name
        self.part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        shared = _dictionary(dictionary)
        if shared is not None:
            shared.precompute_compress(level=LEVEL)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        self.width, self.at = width, _HEAD.size
        self.out.write(_HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width, 0))
        # Arrays of machine words: a shard's index is small beside its documents.
        self.ids, self.has, self.offsets, self.tokens = array("q"), bytearray(), array("Q", [self.at]), array("Q")

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.zip.compress(data)
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(0 if doc_id is None else doc_id)
        self.has.append(doc_id is not None)
        self.offsets.append(self.at)
        self.tokens.append(len(data) // self.width)

    def close(self) -> tuple[str, int, int, int]:
        """(file, documents, tokens, bytes)."""
        index = b"".join((np.array(self.ids, "<i8").tobytes(), bytes(self.has), np.array(self.offsets, "<u8").tobytes(), np.array(self.tokens, "<u8").tobytes()))
        self.out.write(index + _TAIL.pack(self.at, len(self.ids), MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.name, len(self.ids), int(sum(self.tokens)), self.at + len(index) + _TAIL.size


class Shard:
    """An open shard: its index, and single documents."""

    def __init__(self, uri: str, name: str, dictionary: bytes):
        fs, folder = open_store(uri)
        self.file = fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        magic, digest, self.width, _ = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        index_at, n, tail = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{name} is no token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        raw = self.file.read_at(size - _TAIL.size - index_at, index_at)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.has = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.tokens = np.frombuffer(raw, "<u8", n, 17 * n + 8).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document; reads that document's bytes only."""
        a, b = self.offsets[i], self.offsets[i + 1]
        return self._ids(self.file.read_at(int(b - a), int(a)))

    def documents(self, block: int = 1 << 22) -> Iterator[np.ndarray]:
        """All documents in order, read in blocks."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + block)) - 1)
            base = int(self.offsets[i])
            data = self.file.read_at(int(self.offsets[j]) - base, base)
            for k in range(i, j):
                yield self._ids(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base])
            i = j


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHUNK`` bytes of text, one row at least."""
    size = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("text")), pa.int64())).to_numpy()
    i = 0
    while i < batch.num_rows:
        before = int(size[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + CHUNK)))
        yield batch.slice(i, j - i)
        i = j


def _tasks(docs: DataFrame) -> int:
    """Tasks for a table: more where the planner knows it to be large."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_width(docs.sparkSession), min(known // TASK_BYTES, 100_000) if known < 1 << 60 else 0)


def _remove_leftovers(uri: str, named: set[str]) -> None:
    """Deletes shards, finished or not, that the manifest does not name."""
    from pyarrow import fs as pafs

    fs, folder = open_store(uri)
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        name = info.base_name.lstrip(".")
        if info.is_file and name.startswith("shard-") and info.base_name not in named:
            fs.delete_file(info.path)


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int, tasks: int | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes the corpus at ``uri`` and returns its manifest.

    Documents are range-partitioned by doc_id (and by a hash of the text, so
    that rows without an id spread); each partition writes shards up to the
    bounds.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    fs, folder = open_store(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary.zdict") as out:
        out.write(dictionary)
    tasks = tasks or _tasks(docs)
    end_bytes = {w: np.array([end_id], f"<u{w}").tobytes() for w in (2, 4)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, writer, enc = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            for piece in _pieces(b):
                enc = enc or encoder(tokenizer)
                for doc_id, data in zip(piece.column("doc_id").to_pylist(), enc.encode(piece.column("text")), strict=True):
                    if writer is not None and (writer.at >= shard_bytes or len(writer.ids) >= shard_docs):
                        yield _shard_row(part, number, writer)
                        writer, number = None, number + 1
                    if writer is None:
                        writer = ShardWriter(uri, f"shard-{part:07d}-{number:05d}-{uuid.uuid4().hex[:12]}.tok", enc.width, dictionary)
                    writer.add(doc_id, data + end_bytes[enc.width])
        if writer is not None:
            yield _shard_row(part, number, writer)
        give_back()

    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), "h")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(spark, 10_000, CHUNK):
        manifest = write_shared(ordered.mapInArrow(run, _MANIFEST), f"{uri}/manifest")
    _remove_leftovers(uri, {r["file"] for r in manifest.select("file").collect()})  # one name for each shard
    return manifest


def _shard_row(part: int, number: int, writer: ShardWriter) -> pa.RecordBatch:
    """The manifest's row of a finished shard; shards are numbered by task and place in it."""
    return pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "n_docs", "n_tokens", "n_bytes"), (part * 1_000_000 + number, *writer.close()), strict=True))])


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    fs, folder = open_store(uri)
    with fs.open_input_stream(f"{folder}/dictionary.zdict") as f:
        dictionary = f.read()
    # The ids before each shard: a window over one row per shard. No join follows, as the planner
    # takes the documents for as few as the shards and would send them all to every executor.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")
    shards = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_parts()  # a worker that wrote the files needs its memo no more
        for b in batches:
            for name, base in zip(b["file"], b["base"], strict=True):
                s, i = Shard(uri, name, dictionary), 0
                docs = s.documents()
                while rows := [(len(d), zlib.crc32(d.tobytes())) for d in islice(docs, READ_DOCS)]:
                    part = slice(i, i + len(rows))
                    n = np.array([r[0] for r in rows], np.int64)
                    if not np.array_equal(n, s.tokens[part]):
                        raise ValueError(f"{name}: the index does not fit its documents")
                    yield pd.DataFrame({
                        "doc_id": pd.Series(s.ids[part], dtype="Int64").mask(~s.has[part]),
                        "start": base + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array([r[1] for r in rows], np.int64),
                    })
                    i, base = i + len(rows), base + int(n.sum())
        give_back()

    tasks = max(shuffle_width(spark), min(manifest.count() // 4, 100_000))
    return shards.repartition(tasks, "shard").select("file", "base").mapInPandas(run, _ROWS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = work_dir(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), uri, default_tokenizer(), end_id=1)
    return read_tokens(spark, uri)
