"""Generators: fragments, expression levels and paired reads that carry their truth in their names.

Random numbers are digests of a seed and what they are drawn for, so they do
not depend on partitions or engines and a task that runs again draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.seq import accept_quality, error_probability
from ..plans.scan import ranked
from .conservation import mutated_reads
from .intervals import overlap_join
from .projection import CHUNK, _cut_out


def uniform(*key: Column) -> Column:
    """A number in [0, 1): 52 bits of the MD5 of the key, joined by colons."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform_fragments(transcripts: DataFrame, step: int, shortest: int, by: int, longest: int) -> DataFrame:
    """(transcript, start, stop) of every length in the range at every ``step``-th start; nothing random."""
    return (
        transcripts.select("transcript", "length", F.explode(F.sequence(F.lit(shortest), F.lit(longest), F.lit(by))).alias("size"))
        .where("size <= length")
        .select("transcript", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - F.col("size"), F.lit(step).cast("long"))).alias("start"), "size")
        .select("transcript", "start", (F.col("start") + F.col("size")).alias("stop"))
    )


def expression_levels(transcripts: DataFrame, mean: float, sigma: float, expressed: float = 1.0, seed: int = 1) -> DataFrame:
    """Log-normal levels of an ``expressed`` share of transcripts, 0 for the rest; the same for the same seed and name."""
    draw = lambda salt: uniform(F.lit(seed), F.lit(salt), F.col("transcript"))
    normal = F.sqrt(-2 * F.log(1 - draw(1))) * F.cos(2 * math.pi * draw(2))
    return transcripts.withColumn("level", F.when(draw(3) < expressed, F.exp(mean + sigma * normal)).otherwise(0.0))


def cut_fragments(expressed: DataFrame, cut: float, shortest: int, longest: int, molecules: int, seed: int = 1) -> DataFrame:
    """(transcript, molecule, start, stop): molecules shared by level, cut at random places, pieces within the length bounds kept.

    ``expressed`` has (transcript, length, level); levels count to a millionth.
    Each molecule draws a point of the summed levels and meets the transcript
    that it lies in by a binned join.
    """
    weights = expressed.select("transcript", "length", F.floor(F.col("level") * 1e6).cast("long").alias("weight")).where("weight > 0")
    weights = weights.withColumn("__b", F.substring(F.md5(F.col("transcript").cast("string")), 1, 2))
    total, rows = weights.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not total:
        return weights.select("transcript", F.lit(0).cast("long").alias("molecule"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
    # Sums before each transcript: within a bucket of names, and of the buckets before it.
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    buckets = weights.groupBy("__b").agg(F.sum("weight").alias("w")).select("__b", F.coalesce(F.sum("w").over(up_to(Window.orderBy("__b"))), F.lit(0)).alias("__below"))
    inside = weights.withColumn("__in", F.coalesce(F.sum("weight").over(up_to(Window.partitionBy("__b").orderBy("transcript"))), F.lit(0)))
    lanes = inside.join(buckets, "__b").select("transcript", "length", F.lit(0).alias("contig"), (F.col("__below") + F.col("__in")).alias("start"), (F.col("__below") + F.col("__in") + F.col("weight")).alias("stop"))
    drawn = expressed.sparkSession.range(molecules).select(F.col("id").alias("molecule"), F.lit(0).alias("contig"), F.floor(uniform(F.lit(seed), F.lit("molecule"), F.col("id")) * float(total)).alias("start"))
    met = overlap_join(drawn.withColumn("stop", F.col("start") + 1), lanes, bin_width=max(1, total // (4 * rows)), levels=4)
    chosen = met.select(F.col("b_transcript").alias("transcript"), F.col("b_length").alias("length"), F.col("a_molecule").alias("molecule"))
    zero = F.lit(0).cast("long")
    inner = F.when(F.col("length") > 1, F.filter(F.sequence(F.lit(1).cast("long"), F.col("length") - 1), lambda p: uniform(F.lit(seed), F.lit("cut"), F.col("molecule"), p) < cut))
    edges = F.concat(F.array(zero), F.coalesce(inner, F.expr("cast(array() as array<bigint>)")), F.array(F.col("length").cast("long")))
    pieces = chosen.withColumn("e", edges).select("transcript", "molecule", F.explode(F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e") - 1), lambda a, z: F.struct(a.alias("start"), z.alias("stop")))).alias("p"))
    return pieces.select("transcript", "molecule", "p.start", "p.stop").where((F.col("stop") - F.col("start")).between(shortest, longest))


def quality_pairs(first: DataFrame, second: DataFrame, least_median: int, offset: int = 33, record: str = "rec_no") -> DataFrame:
    """(pair, q1, q2): quality strings of two files record by record, where at least half of each reach ``least_median``; numbered from 0 without holes."""
    both = first.select(record, F.col("q").alias("q1")).join(second.select(record, F.col("q").alias("q2")), record)
    good = both.where(accept_quality(F.col("q1"), offset + least_median) & accept_quality(F.col("q2"), offset + least_median))
    return ranked(good, [F.floor(F.col(record) / 65536)], [record], "pair").select((F.col("pair") - 1).alias("pair"), "q1", "q2")


def _called(bases: Column, quals: Column, offset: int, *key: Column) -> Column:
    """The bases with errors by quality: a third of the error probability for each other base."""

    def call(b: Column, i: Column) -> Column:
        q = F.substring(quals, i + 1, F.lit(1))
        others = F.array_except(F.array(*[F.lit(x) for x in "ACGT"]), F.array(b))
        other = F.get(others, F.floor(uniform(*key, F.lit("base"), i) * 3).cast("int"))
        return F.when(uniform(*key, F.lit("error"), i) < error_probability(q, offset), other).otherwise(b)

    return F.transform(bases, call)


# Flag bits of the two reads of a fragment, and of the first and last one.
_LEFT_FLAG, _RIGHT_FLAG, _FIRST, _LAST = 0x1 | 0x2 | 0x20, 0x1 | 0x2 | 0x10, 0x40, 0x80


def read_pairs(
    fragments: DataFrame,
    blocks: DataFrame,
    chunks: DataFrame,
    length: int,
    quals: DataFrame | None = None,
    mutations: DataFrame | None = None,
    sense: bool = True,
    blind: bool = False,
    offset: int = 33,
    seed: int = 1,
    width: int = CHUNK,
) -> DataFrame:
    """Alignment records of the two reads at the ends of each fragment (transcript, start, stop), shorter ones left out.

    Reads are cut out of the contig (``dna_chunks``) along the transcript's
    ``blocks``, counted from its left end; both are given as on the contig, left
    and right, the right one on the minus strand. ``mutations`` (contig, pos,
    original, mutated) are put in first. With ``quals`` (pair, q1, q2 of
    ``length``; see ``quality_pairs``) fragments take pairs in turn by their
    number, and bases are miscalled by quality; without, qualities are perfect.
    The left read is the first of its fragment if the transcript's strand is
    plus (with ``sense`` false: minus). Names tell the truth,
    ``number:read1:contig:+:start:cigar:errors:read2:contig:-:start:cigar:errors:fragment_size:n``
    with one-based starts, or only the number if ``blind``.

    Columns: qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual
    (positions from 0). Equal fragments need another column to tell them apart;
    all columns count for the number.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in fragments.columns])), 1, 15), 16, 10).cast("long")
    f = fragments.withColumn("no", number).where(F.col("stop") - F.col("start") >= length)
    f = f.select("no", "transcript", "start", "stop").join(blocks.select("transcript", "contig", "strand", "blocks"), "transcript")
    m = F.array(F.struct(F.lit(length).cast("long").alias("len"), F.lit("M").alias("op")))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), cg.expand(F.col("blocks"), m, at).alias("x")) for i, at in enumerate((F.col("start"), F.col("stop") - length))])
    reads = f.select("no", "contig", (F.col("strand") == "+").alias("plus"), (F.col("stop") - F.col("start")).alias("size"), F.explode(sides).alias("r"))
    reads = reads.select("no", "contig", "plus", "size", "r.side", F.col("r.x.start").alias("pos"), F.col("r.x.units").alias("units"))
    parts = reads.select("no", "side", "contig", F.explode(cg._segments(F.col("units"), F.col("pos"))).alias("g"))
    parts = parts.select(F.concat_ws(":", "no", "side", "g.read").alias("id"), "no", "side", F.col("g.read").alias("read"), "contig", F.col("g.at").alias("start"), (F.col("g.at") + F.col("g.len")).alias("stop"))
    cut = _cut_out(parts, chunks, ["id", "no", "side", "read", "contig", "start"], width)
    if mutations is not None:
        cut = mutated_reads(cut, mutations)
    raw = cut.groupBy("no", "side").agg(F.sort_array(F.collect_list(F.struct("read", "s"))).alias("p")).select("no", "side", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("raw"))
    reads = reads.join(raw, ["no", "side"])
    if quals is None:
        reads = reads.withColumn("qual", F.lit("~" * length)).withColumn("seq", F.col("raw")).withColumn("errors", F.lit(0).cast("long"))
    else:
        count = quals.count()
        q = quals.select(F.col("pair").alias("__pair"), "q1", "q2")
        reads = reads.join(q, F.pmod(F.col("no"), F.lit(count)) == F.col("__pair")).withColumn("qual", F.when(F.col("side") == 0, F.col("q1")).otherwise(F.col("q2")))
        reads = reads.withColumn("bases", F.filter(F.split("raw", ""), lambda b: b != "")).withColumn("called", _called(F.col("bases"), F.col("qual"), offset, F.lit(seed), F.col("no"), F.col("side")))
        wrong = F.aggregate(F.zip_with("called", "bases", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        reads = reads.withColumn("seq", F.array_join("called", "")).withColumn("errors", wrong)
    one = F.struct("contig", "plus", "size", "pos", cg.render(F.col("units")).alias("cigar"), "seq", "qual", "errors")
    pairs = reads.groupBy("no").agg(F.max(F.when(F.col("side") == 0, one)).alias("l"), F.max(F.when(F.col("side") == 1, one)).alias("r"))
    first = F.col("l.plus") if sense else ~F.col("l.plus")
    names = (F.when(first, "read1").otherwise("read2"), F.when(first, "read2").otherwise("read1"))
    told = [x for n, side, strand in ((names[0], "l", "+"), (names[1], "r", "-")) for x in (n, F.col(f"{side}.contig"), F.lit(strand), F.col(f"{side}.pos") + 1, F.col(f"{side}.cigar"), F.col(f"{side}.errors"))]
    qname = F.col("no").cast("string") if blind else F.concat_ws(":", "no", *told, F.lit("fragment_size"), F.col("l.size"))

    def record(own: str, other: str, flag: int, is_first: Column, sign: int) -> Column:
        return F.struct(
            qname.alias("qname"), (F.lit(flag) + F.when(is_first, _FIRST).otherwise(_LAST)).alias("flag"), F.col(f"{own}.contig").cast("string").alias("rname"), F.col(f"{own}.pos").alias("pos"),
            F.lit(255).alias("mapq"), F.col(f"{own}.cigar").alias("cigar"), F.lit("=").alias("rnext"), F.col(f"{other}.pos").alias("pnext"), (F.col("l.size") * sign).alias("tlen"),
            F.col(f"{own}.seq").alias("seq"), F.col(f"{own}.qual").alias("qual"),
        )

    rows = F.array(record("l", "r", _LEFT_FLAG, first, 1), record("r", "l", _RIGHT_FLAG, ~first, -1))
    return pairs.select(F.explode(rows).alias("x")).select("x.*")
