"""Exact Jaccard self-join of documents on word shingles by parity sketches.

The sketch of a set has one bit per hash value and XOR sets it: every shingle
flips its bit, so the Hamming distance of two sketches is a lower bound of the
symmetric difference. The sketch is cut into blocks. Two sets with Jaccard
similarity of at least ``t`` and sizes a, b differ in at most
``D = (1 - t) / (1 + t) * (a + b)`` shingles, hence in at most D blocks, and of
the first D + r non-empty blocks in a fixed order each has r in common with
the other's (pigeonhole; ``r`` grows with the size, so that long texts that
share a passage are no candidates). Only those blocks are joined, as 64-bit fingerprints
(the XOR of the mixed hashes of a block's shingles), per size band; a set just
below a band also joins as its guest. A dense folding of the sketch to 1024
bits prunes candidates before their texts are fetched and compared exactly.

Growth and skew. Sets with equal members are reduced to one representative
before the join, by partial aggregation. In a bucket (equal fingerprints) only
links to the bucket's smallest member are tried first; copies of one text form
a star, not all pairs. Buckets that afterwards still hold several components
give the pairs between different components, filtered inside the join; those
with r buckets in common are tried, so no link between components is lost and
no pair within one is made.

A bucket with more than ``HOT`` members (a passage that many different texts share)
is not paired. Instead its members bring further blocks, e more each, and meet in
those: two sets that may link have r + e blocks in common there, so r besides up
to e of hot buckets. Only a set with more than e hot blocks (most of it is such
passages) still meets the others of its hot buckets.

Exactness: a set of up to ``SINGLES`` shingles has a block for each shingle.
For larger sets the number of blocks is chosen so that fewer than D + 1
non-empty blocks has a probability under 1e-12 per set; hashes have 64 bits.

Defined results: null or wordless texts have no shingles, no links and their
own doc_id as component; a row without doc_id links with nothing and has a null
component; rows that share a doc_id are one document, linked when any of them
is. Repeated rows are returned as often as they come. Texts of any length are
read whole. Sets are told to be equal by 128 bits of sums over their hashes, and
linked sets are compared by their hashes; texts are not compared word by word.
An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import give_back, packed, remove_shared, small_batches, work_dir, write_shared
from ._shingles import U64, mix64, overlap, shingle_set, shingle_sets
from .components import components

#: Words of a shingle; two documents link at ``PERCENT`` or more.
SHINGLE, PERCENT = 5, 80
#: Sets of up to so many shingles have one block for each shingle.
SINGLES = 24
#: A set asks for a further block in common for every so many shingles.
PER_REPEAT = 64
#: 64-bit words of the dense sketch.
DENSE = 16
#: Texts that a worker sketches at a time, and their bytes, about.
CHUNK, CHUNK_BYTES = 256, 1 << 20
#: Members of a bucket up to which its pairs are looked at.
HOT = 2000

_DENSE = [f"d{i}" for i in range(DENSE)]


def _further(prefix):
    """Blocks beyond its prefix that a set keeps for hot buckets."""
    return prefix // 4 + 2


def _reach(size, percent: int):
    """Largest size of a partner of a set of ``size`` shingles."""
    return size * 100 // percent


def _repeats(size):
    """Blocks that the prefixes of two sets of at least ``size`` have in common, if they may link."""
    return 1 + size // PER_REPEAT


def _blocks(band: int) -> int:
    """Blocks of the sketches of a band (sizes of ``band`` binary digits); 0: one for each shingle."""
    top = (1 << band) - 1
    return 0 if top <= SINGLES else top * 3 // 10 + 64


def _fingerprints(h: np.ndarray, mixed: np.ndarray, owner: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, fingerprint) of the non-empty blocks of many sets; ``bands`` has a band for each hash."""
    blocks = np.array([_blocks(b) for b in range(65)], np.int64).astype(U64)[bands]
    at = np.where(blocks == 0, h, ((h >> U64(32)) * blocks) >> U64(32))  # rises with h, so blocks are runs
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    xor = np.bitwise_xor.reduceat(mixed, first)
    return owner[first], mix64(xor ^ mix64((bands[first].astype(U64) << U64(56)) ^ at[first]))


def sketches(texts: list[bytes | None], shingle: int = SHINGLE, percent: int = PERCENT):
    """Sketches of texts: (sizes, signatures, dense sketches, numbers of further tokens of a band, tokens and their bounds, further tokens and their bounds)."""
    h, bounds = shingle_sets(texts, shingle)
    count = len(texts)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(count), sizes)
    mixed = mix64(h)
    some = np.flatnonzero(sizes)
    s1, s2 = np.zeros(count, U64), np.zeros(count, U64)
    if len(some):
        with np.errstate(over="ignore"):
            s1[some] = np.bitwise_xor.reduceat(mixed, bounds[some])
            s2[some] = np.add.reduceat(mix64(mixed ^ U64(0x5BD1E995)), bounds[some])
    bits = 64 * DENSE
    odd = np.bincount(owner * bits + (mixed & U64(bits - 1)).astype(np.int64), minlength=count * bits) & 1
    dense = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(count, DENSE)
    partner = _reach(sizes, percent)
    prefix = (sizes + partner) * (100 - percent) // (100 + percent) + _repeats(sizes)
    digits = np.frexp(sizes.astype(np.float64))[1]
    found: list[list[np.ndarray]] = [[] for _ in range(count)]
    further: list[list[np.ndarray]] = [[] for _ in range(count)]
    if len(h):
        own_band = digits[owner]
        guest = partner[owner] >= (np.int64(1) << own_band)  # may link with a set of the next band
        for who, marks in (_fingerprints(h, mixed, owner, own_band), _fingerprints(h[guest], mixed[guest], owner[guest], own_band[guest] + 1) if guest.any() else (owner[:0], h[:0])):
            ends = np.searchsorted(who, np.arange(count + 1))
            for i in np.unique(who).tolist():
                m, k = marks[ends[i] : ends[i + 1]], int(prefix[i])
                if k < len(m):
                    most = k + _further(k)
                    m = np.partition(m, most - 1)[:most] if most < len(m) else m.copy()
                    m.sort()
                found[i].append(m[:k])
                further[i].append(m[k:])
    spare = np.array([min(map(len, f), default=0) for f in further], np.int32)  # of the band that has fewer
    return sizes, (s1, s2), dense, spare, _flat(found), _flat(further)


def _flat(lists: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the arrays of each list one after the other."""
    parts = [m for f in lists for m in f]
    lengths = [sum(map(len, f)) for f in lists]
    return np.concatenate(parts) if parts else np.empty(0, U64), np.concatenate(([0], np.cumsum(lengths)))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``CHUNK`` rows and about ``CHUNK_BYTES`` of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = int(size[i - 1]) if i else 0
        j = min(i + CHUNK, max(i + 1, int(np.searchsorted(size, before + CHUNK_BYTES))))
        yield batch.slice(i, j - i)
        i = j


def sets_of(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, dense sketch, spare, tokens, further tokens) of every document."""
    schema = f"doc_id long, n int, s1 long, s2 long, {', '.join(f'{d} long' for d in _DENSE)}, spare int, tokens array<long>, further array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                n, (s1, s2), dense, spare, *tokens = sketches(part.column("text").to_pylist(), shingle, percent)
                arrays = [part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))]
                arrays += [pa.array(dense[:, k]) for k in range(DENSE)]
                arrays.append(pa.array(spare))
                arrays += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t.view(np.int64))) for t, ends in tokens]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "s1", "s2", *_DENSE, "spare", "tokens", "further"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def _plausible(a: str, b: str, percent: int) -> str:
    """SQL: sizes and Hamming distance of the dense sketches allow a link."""
    distance = " + ".join(f"bit_count({a}.d{i} ^ {b}.d{i})" for i in range(DENSE))
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND "
        f"{100 + percent} * ({distance}) <= {100 - percent} * ({a}.n + {b}.n)"
    )


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts have the asked similarity.

    Only texts that occur in pairs are shuffled; large partitions (a hub with
    very many pairs) are split at run time.
    """
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    needed = write_shared(needed, work_dir(docs.sparkSession, "needed"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text")).join(needed, "id", "left_semi")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                text_a, text_b = text_a.as_py(), text_b.as_py()
                if known is None or text_b != last:
                    last, known = text_b, shingle_set(text_b, shingle)
                own = shingle_set(text_a, shingle)
                common = overlap(own, known)
                keep.append(common > 0 and 100 * common >= percent * (len(own) + len(known) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _hubs(entries: DataFrame) -> DataFrame:
    """(token, hub, members) of buckets with several members."""
    found = entries.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("other"), F.count(F.lit(1)).alias("members"))
    return found.where("hub != other").select("token", "hub", "members")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    path = work_dir(spark, "jaccard")
    with small_batches(spark):
        with_sets = write_shared(sets_of(docs, shingle, percent), f"{path}/sets")
    rows = write_shared(with_sets.select("doc_id", "n", "s1", "s2"), f"{path}/rows")
    classes = write_shared(
        with_sets.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("rep"), *[F.first(d).alias(d) for d in _DENSE]),
        f"{path}/classes",
    )
    member = write_shared(
        rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep"),
        f"{path}/members",
    )
    # Rows that share a doc_id are one document: its classes are linked.
    shared_ids = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")

    keys = with_sets.select("doc_id", "n", "s1", "s2", "spare", "tokens", "further").join(
        classes.select(F.col("rep").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"], "left_semi"
    )
    keys = write_shared(keys.select(F.col("doc_id").alias("id"), "spare", "tokens", "further"), f"{path}/keys")
    remove_shared(spark, f"{path}/sets")
    entries = keys.select(F.explode("tokens").alias("token"), "id")
    hubs = write_shared(_hubs(entries), f"{path}/hubs")
    bucket = write_shared(entries.join(hubs, "token").select("token", "id", "hub"), f"{path}/buckets")
    hot_tokens = write_shared(hubs.where(F.col("members") > hot).select("token"), f"{path}/hot")
    heavy = None
    if hot_tokens.head(1):
        # Pairs that only hot buckets hold are among their members: those meet in further buckets of their own.
        in_hot = write_shared(bucket.join(hot_tokens, "token", "left_semi").select("id").distinct(), f"{path}/in-hot")
        own = write_shared(keys.join(in_hot, "id", "left_semi"), f"{path}/in-hot-keys")
        whole = own.select(F.explode(F.concat("tokens", "further")).alias("token"), "id")
        some = whole.join(own.select(F.explode("further").alias("token")).distinct(), "token", "left_semi")
        again = write_shared(some.join(_hubs(some), "token").select("token", "id", "hub", "members"), f"{path}/further-buckets")
        hot_again = again.where(F.col("members") > hot).select("token").distinct()
        counted = whole.join(hot_tokens.union(hot_again).distinct(), "token", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("hot"))
        heavy = write_shared(counted.join(own.select("id", "spare"), "id").where(F.col("hot") > F.col("spare")).select("id"), f"{path}/heavy")
        if not heavy.head(1):
            heavy = None
        # The same block may stand in both, so these get names of their own.
        renamed = F.xxhash64("token", F.lit(1)).alias("token")
        bucket = bucket.union(again.select(renamed, "id", "hub"))
        hot_tokens = write_shared(hot_tokens.union(hot_again.select(renamed)), f"{path}/all-hot")
    remove_shared(spark, f"{path}/keys", f"{path}/hubs")
    nodes = classes.select("rep", "n", *_DENSE)
    star = bucket.select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    tried = write_shared(_candidates(write_shared(star, f"{path}/star"), nodes, percent), f"{path}/tried")
    with small_batches(spark):
        links = write_shared(verified(tried, docs, shingle, percent).union(shared_ids), f"{path}/links")
    found = components(links, f"{path}/first")

    # What the stars leave: pairs in one bucket whose ends are in different components.
    label = found.select(F.col("node").alias("id"), "component")
    in_bucket = write_shared(
        bucket.select("token", "id").join(label, "id", "left").select("token", "id", F.coalesce("component", "id").alias("component")),
        f"{path}/labelled",
    )
    remove_shared(spark, f"{path}/buckets", f"{path}/further-buckets")
    sizes = in_bucket.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", "size").alias("major"))
    mixed = mixed.where("parts > 1").select("token", "major")
    mixed = write_shared(mixed if heavy is not None else mixed.join(hot_tokens, "token", "left_anti"), f"{path}/mixed")
    left = write_shared(in_bucket.join(mixed, "token").join(nodes.withColumnRenamed("rep", "id"), "id"), f"{path}/mixed-members")
    remove_shared(spark, f"{path}/labelled", f"{path}/mixed")
    plain = left.join(hot_tokens, "token", "left_anti")
    differ = f"x.token = y.token AND x.component != y.component AND {_plausible('x', 'y', percent)}"
    x, y = plain.where("component != major").alias("x"), plain.alias("y")
    met = [x.join(y, F.expr(f"{differ} AND (y.component = y.major OR x.id < y.id)"))]
    if heavy is not None:
        among = left.join(hot_tokens, "token", "left_semi")
        met.append(among.join(heavy, "id", "left_semi").select(*among.columns).alias("x").join(among.alias("y"), F.expr(differ)))
    pairs = [m.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"), F.least("x.n", "y.n").alias("n")) for m in met]
    rest = (
        reduce(DataFrame.union, pairs)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"))
        .where(F.col("common") >= _repeats_column(F.col("n")))
        .select("a", "b")
    )
    rest = write_shared(rest.join(tried, ["a", "b"], "left_anti"), f"{path}/rest")
    remove_shared(spark, f"{path}/mixed-members")
    if rest.head(1):
        with small_batches(spark):
            more = write_shared(verified(rest, docs, shingle, percent), f"{path}/more-links")
        if more.head(1):
            found = components(links.union(more), f"{path}/second")

    # The smallest doc_id of a component: representatives are the smallest of their class.
    named = member.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    named = write_shared(named, f"{path}/named")
    return rows.select("doc_id", "n").join(named, "doc_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all their columns; those without an id stay."""
    others = similar_groups(docs, shingle, percent).where("doc_id != component_id").select("doc_id").distinct()
    others = write_shared(others, work_dir(docs.sparkSession, "others")).alias("o")
    d = packed(docs, doc_id=F.col("doc_id").cast("long")).alias("d")
    return d.join(others, F.expr("d.doc_id = o.doc_id"), "left_anti").select("row.*")


def _repeats_column(size: Column) -> Column:
    return F.lit(1) + F.floor(size / PER_REPEAT)


def _candidates(stars: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (a, b, common) that sizes and dense sketches allow, with half of the asked blocks.

    A pair that has fewer buckets under this hub, as smaller members took
    others, comes up again when components are compared.
    """
    x, y = nodes.alias("x"), nodes.alias("y")
    return (
        stars.alias("p")
        .join(x, F.expr("p.a = x.rep"))
        .join(y, F.expr("p.b = y.rep"))
        .where(_plausible("x", "y", percent))
        .where(F.col("p.common") * 2 >= _repeats_column(F.least("x.n", "y.n")))
        .select("p.a", "p.b")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
