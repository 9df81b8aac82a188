"""Operators on alignment and read records: order, filters, pairs, duplicates, deals and joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.seq import reverse_complement
from ..plans.scan import lagged, ranked, spread

FRAGMENT_ORDER = ("flowcell", "lane", "tile", "x", "y")


# --- order ----------------------------------------------------------------------


def contig_table(contigs: DataFrame) -> DataFrame:
    """(contig, ord, length, offset): lengths before each contig, in order of ``ord``; one row per contig."""
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def flattened(df: DataFrame, contigs: DataFrame, column: str = "pos", to: str = "flat", contig: str = "contig") -> DataFrame:
    """``df`` with the position on the contigs laid end to end; an unknown contig is an error when read."""
    table = contigs.select(F.col("contig").alias("__contig"), F.col("offset").alias("__offset"))
    joined = df.join(table, F.col(contig) == F.col("__contig"), "left")
    known = F.when(F.col("__offset").isNull(), F.raise_error(F.concat(F.lit("unknown contig "), F.col(contig))).cast("long")).otherwise(F.col("__offset"))
    return joined.withColumn(to, known + F.col(column)).drop("__contig", "__offset")


def ordered(df: DataFrame, order: str, contigs: DataFrame | None = None) -> tuple[DataFrame, list[str], list[Column]]:
    """(``df`` with what the order needs, its sort columns, leading expressions that split it into groups of moderate size).

    Orders: FRAGMENT, ALIGN, GUIDE or MIN_ALIGN_GUIDE.
    """
    if order == "FRAGMENT":
        return df, list(FRAGMENT_ORDER), [F.col(c) for c in FRAGMENT_ORDER[:3]]
    guide = "guide_contig" if "guide_contig" in df.columns else "contig"
    if order == "ALIGN":
        flat = flattened(df, contigs)
    elif order == "GUIDE":
        flat = flattened(df, contigs, "guide_pos", "flat", guide)
    elif order == "MIN_ALIGN_GUIDE":
        both = flattened(flattened(df, contigs), contigs, "guide_pos", "guide_flat", guide)
        flat = both.withColumn("flat", F.least("flat", "guide_flat"))
    else:
        raise ValueError(f"no order {order}")
    return flat, ["flat", "fid"], [F.floor(F.col("flat") / 4096)]


def sort_alignments(df: DataFrame, order: str, contigs: DataFrame | None = None, tie: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Globally ordered records (range partitioned), see ``ordered``; ``tie`` columns keep the order stable, ``unique`` drops repeated rows."""
    rows, keys, _ = ordered(df.dropDuplicates() if unique else df, order, contigs)
    return rows.orderBy(*keys, *tie)


def rank_alignments(df: DataFrame, order: str, contigs: DataFrame | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Records with their 1-based ``rank`` in an order."""
    rows, keys, coarse = ordered(df, order, contigs)
    return ranked(rows, coarse, [*keys, *tie])


#: Sort columns of the comparators of records: ``flat`` and ``mate_flat`` are positions on the contigs laid end to end,
#: ``cigar`` is compared with T as N, ``first`` tells the read of a pair.
_POSITION = ("flat", "strand", "cigar", "mate_flat", "space")
_COMPARATORS = {
    "position": _POSITION,
    "fragment_position": ("fragment_flat", "strand", "cigar"),
    "read": ("fid", "first"),
    "read_and_position": ("fid", "first", *_POSITION),
    "position_and_read": (*_POSITION, "fid", "first"),
    "fragment": ("fid",),
    "fragment_and_position": ("fid", *_POSITION),
}


def comparator(name: str) -> list[Column]:
    """The columns by which two records are compared (to sort by them, or to tell equal records)."""
    where = {"cigar": cg.comparable(F.col("cigar")), "fragment_flat": F.when(F.col("mapped"), F.least("flat", "mate_flat")).otherwise(F.col("flat"))}
    return [where.get(c, F.col(c)) for c in _COMPARATORS[name]]


def concatenated(tables: Sequence[DataFrame]) -> DataFrame:
    """Records of several tables, one after the other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def order_violations(df: DataFrame, sequence: str, key: str, group: Sequence[str] = (), width: int = 1 << 16) -> DataFrame:
    """Rows whose ``key`` is below that of the row before, by the numbers in ``sequence``, within ``group``.

    ``width`` consecutive numbers are looked at in one task.
    """
    return lagged(df, key, group, [sequence], F.floor(F.col(sequence) / width)).where(F.col("previous") > F.col(key))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_collisions(df: DataFrame, key: Column) -> DataFrame:
    """(rows, keys, collisions): how many rows share a key with an earlier one."""
    counts = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).select("rows", "keys", (F.col("rows") - F.col("keys")).alias("collisions"))


# --- filters ---------------------------------------------------------------------


def filter_fragments(df: DataFrame, ids: DataFrame, include: bool = False, on: str = "fid") -> DataFrame:
    """Records whose fragment is (``include``) or is not in ``ids``."""
    return df.join(ids.select(on).distinct(), on, "left_semi" if include else "left_anti")


def matching_rows(query: DataFrame, guide: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of ``query`` whose keys, compared as the given types, occur in ``guide``."""
    g = guide.select(*[F.col(k).cast(t).alias(f"__{k}") for k, t in keys.items()]).distinct()
    cond = F.lit(True)
    for k, t in keys.items():
        cond = cond & (F.col(k).cast(t) == F.col(f"__{k}"))
    return query.join(g, cond, "left_semi")


def filter_records(df: DataFrame, flags: Column | None = None, least_mapq: int = 0, most_rank: int | None = None, most_size: int | None = None, spaces: str | None = None) -> DataFrame:
    """Records that pass the flags and the mapping quality; rank, size and space count only where present."""
    keep = F.col("mapq") >= least_mapq
    if flags is not None:
        keep = keep & flags
    if most_rank is not None:
        keep = keep & F.coalesce(F.col("rank") <= most_rank, F.lit(True))
    if most_size is not None:
        keep = keep & F.coalesce(F.col("stratum_size") <= most_size, F.lit(True))
    if spaces is not None:
        keep = keep & F.coalesce(F.col("space").isin(*spaces), F.lit(True))
    return df.where(keep)


def best_score(df: DataFrame, group: str = "fid", score: str = "score", best: bool = True) -> DataFrame:
    """Records with the best score of their group, ties included; or the rest."""
    top = df.groupBy(group).agg(F.max(score).alias("__top"))
    joined = df.join(top, group)
    return joined.where((F.col(score) == F.col("__top")) if best else (F.col(score) < F.col("__top"))).drop("__top")


def pileup_filter(df: DataFrame, chars: str, least: int, column: str = "bases") -> DataFrame:
    """Pileup rows with at least ``least`` bases A, C, G or T in either case, and the counts of ``chars``."""
    count = lambda c: F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))
    total = F.length(F.regexp_replace(F.col(column), "[^ACGTacgt]", ""))
    return df.where(total >= least).select(*df.columns, *[count(c).alias(f"n_{c}") for c in chars])


# --- pairs and duplicates ----------------------------------------------------------


def first_seen(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("fid", "readno")) -> DataFrame:
    """The first record of each fragment and read; records are combined before the shuffle, so a key may have very many."""
    first = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row")))
    return df.groupBy(*keys).agg(first.alias("first")).select("first.row.*")


def with_orphan(df: DataFrame, fragment: str = "fid", read: str = "readno") -> DataFrame:
    """``df`` with ``orphan``: the fragment lacks one of its two reads."""
    alone = df.groupBy(fragment).agg((F.min(read) == F.max(read)).alias("orphan"))
    return df.join(alone, fragment).select(*df.columns, "orphan")


def as_sequenced(df: DataFrame) -> DataFrame:
    """Reads as the machine gave them: ``seq`` reverse complemented and ``qual`` reversed where ``strand`` (minus) is set."""
    return df.withColumn("seq", F.when(F.col("strand"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn(
        "qual", F.when(F.col("strand"), F.reverse("qual")).otherwise(F.col("qual"))
    )


def extract_reads(df: DataFrame, order: Sequence[str], paired: bool = True) -> dict[str, DataFrame]:
    """First-seen reads, as sequenced where they carry seq, qual and strand: read 1, read 2 and orphans; or all in one."""
    kept = first_seen(df, order)
    if {"seq", "qual", "strand"} <= set(df.columns):
        kept = as_sequenced(kept)
    if not paired:
        return {"reads": kept}
    marked = with_orphan(kept)
    return {"first": marked.where("NOT orphan AND readno = 0").drop("orphan"), "second": marked.where("NOT orphan AND readno = 1").drop("orphan"), "orphans": marked.where("orphan").drop("orphan")}


def dedup_best(df: DataFrame, keys: Sequence[str], best: Sequence[Column]) -> DataFrame:
    """Of records with equal keys, the first by ``best``."""
    w = Window.partitionBy(*keys).orderBy(*best)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pair_mates(df: DataFrame, order: Sequence[str], fragment: str = "fid", read: str = "readno") -> DataFrame:
    """Pairs of a fragment's reads 0 and 1: the k-th of one with the k-th of the other (columns ``first``, ``second`` as structs)."""
    w = Window.partitionBy(fragment, read).orderBy(*order)
    numbered = df.withColumn("k", F.row_number().over(w))
    a = numbered.where(F.col(read) == 0).select(fragment, "k", F.struct(*df.columns).alias("first"))
    b = numbered.where(F.col(read) == 1).select(fragment, "k", F.struct(*df.columns).alias("second"))
    return a.join(b, [fragment, "k"])


def mate_pairs(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mates that point to each other: (fid, first, second, left_is_first), the records as structs.

    Needs fid, multi, first (the read of the pair), unmapped, mapped (all of the
    fragment), pos, pnext, strand, next_strand and next_contig (never ``=``).
    Two reads of a fragment are mates if both are unmapped, or if all is mapped,
    each has the other's position and strand as its mate's, and they name the
    same contig. Of several that fit, the k-th first read goes with the k-th
    second by ``order``. A record without a mate stands alone, its mate null.
    """
    rows = df.withColumn("__row", F.struct(*df.columns)).withColumn("__lone", F.expr("NOT multi OR NOT (unmapped OR mapped)"))
    second = ~F.col("first")
    swap = lambda a, b: F.when(second, F.col(b)).otherwise(F.col(a))
    keys = {"__pos": swap("pos", "pnext"), "__pnext": swap("pnext", "pos"), "__strand": swap("strand", "next_strand"), "__next": swap("next_strand", "strand"), "__contig": F.col("next_contig")}
    rows = rows.select("fid", "__row", "__lone", "first", "unmapped", *order, *[F.when(~F.col("unmapped"), c).alias(k) for k, c in keys.items()])
    names = ["fid", "__lone", "unmapped", *keys]
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*names, "first").orderBy(*order)))
    a = numbered.where("first").select(*names, "__k", F.col("__row").alias("first"))
    b = numbered.where("NOT first").select(*[F.col(n).alias(f"{n}_") for n in (*names, "__k")], F.col("__row").alias("second"))
    same = ~F.col("__lone") & ~F.col("__lone_")
    for n in (*names, "__k"):
        same = same & (F.col(n) == F.col(f"{n}_") if n == "fid" else F.col(n).eqNullSafe(F.col(f"{n}_")))
    left = F.when(F.col("first").isNotNull() & F.col("second").isNotNull(), F.col("first.pos") <= F.col("second.pos"))
    return a.join(b, same, "full").select(F.coalesce("fid", "fid_").alias("fid"), "first", "second", left.alias("left_is_first"))


# --- reads -------------------------------------------------------------------------


def deal(reads: DataFrame, n: int, record: str = "rec_no") -> DataFrame:
    """Reads dealt to ``n`` hands: ``hand`` and the number within it."""
    return reads.withColumn("hand", F.pmod(F.col(record), F.lit(n))).withColumn("place", F.floor(F.col(record) / n))


def interleave(first: DataFrame, second: DataFrame, record: str = "rec_no") -> DataFrame:
    """Reads of two files in turn, with their place in the result."""
    return (
        first.withColumn("place", F.col(record) * 2).unionByName(second.withColumn("place", F.col(record) * 2 + 1)).orderBy("place")
    )


def zip_records(files: Sequence[DataFrame], record: str = "rec_no") -> DataFrame:
    """Record i of every file side by side (columns get suffixes 1, 2, ...); a file without it gives nulls."""
    out = None
    for i, f in enumerate(files, 1):
        f = f.select(record, *[F.col(c).alias(f"{c}{i}") for c in f.columns if c != record])
        out = f if out is None else out.join(f, record, "full")
    return out


def merge_orphans(first: DataFrame, second: DataFrame, on: str = "fid") -> DataFrame:
    """Fragments that occur in both files."""
    return first.select(on).distinct().join(second.select(on).distinct(), on)


def multi_join(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Equi-join of several tables on typed keys; other columns get the table's number before them."""
    out = None
    for i, t in enumerate(tables, 1):
        t = t.select(*keys, *[F.col(c).alias(f"t{i}_{c}") for c in t.columns if c not in keys])
        out = t if out is None else out.join(t, list(keys))
    return out


def rejoin(records: DataFrame, sequences: DataFrame, on: str = "fid", keep: Column | None = None) -> DataFrame:
    """Records (of those for which ``keep`` holds) with the sequence and quality of their read, one row per read of the fragment; a missing read is an error when read."""
    if keep is not None:
        records = records.where(keep)
    joined = records.join(sequences.select(on, F.posexplode("reads").alias("readno", "read")), on, "left")
    present = F.when(F.col("read").isNull(), F.raise_error(F.concat(F.lit("no sequence of fragment "), F.col(on).cast("string"))).cast("string")).otherwise(F.col("read.s"))
    return joined.select(*records.columns, "readno", present.alias("s"), F.col("read.q").alias("q"))


def unmapped_reads(records: DataFrame, sequences: DataFrame, on: str = "fid") -> DataFrame:
    """(id, readno, s, q): the reads of fragments whose record of rank 1 is unmapped, for a FASTQ sink."""
    lost = records.where(~F.col("mapped") & (F.coalesce("rank", F.lit(1)) == 1)).select(on).distinct()
    reads = sequences.join(lost, on, "left_semi").select(on, F.posexplode("reads").alias("readno", "read"))
    return reads.select(F.col(on).cast("string").alias("id"), "readno", F.col("read.s").alias("s"), F.col("read.q").alias("q"))


def truncate(df: DataFrame, numbered: str = "fid") -> DataFrame:
    """Records with the name replaced by the number, no sequence or quality, and ``nS`` for an absent CIGAR."""
    return df.select(
        F.col(numbered).cast("string").alias("qname"),
        *[c for c in df.columns if c not in ("qname", "seq", "qual", "cigar", numbered)],
        F.when(F.col("cigar") == "*", F.concat(F.length("seq").cast("string"), F.lit("S"))).otherwise(F.col("cigar")).alias("cigar"),
        F.lit("*").alias("seq"),
        F.lit("*").alias("qual"),
    )


def merge_spaces(df: DataFrame, keys: Sequence[str] = ("fid", "contig", "pos"), space: str = "space") -> DataFrame:
    """One row per placement: its space, or ``M`` where it was found in several; the best mapping quality and the number of rows."""
    return df.groupBy(*keys).agg(
        F.when(F.min(space) == F.max(space), F.min(space)).otherwise("M").alias(space), F.max("mapq").alias("mapq"), F.count(F.lit(1)).alias("n")
    )


def reconcile(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Keys that only one of two tables has: (key, side).

    Keys of both tables meet once, in as many tasks as a shuffle has, so that a
    task's share of them stays small.
    """
    both = a.select(on, F.lit(1).alias("__side")).unionAll(b.select(on, F.lit(2).alias("__side")))
    sides = spread(both, on).groupBy(on).agg(F.bit_or("__side").alias("__sides"))
    # A key that is null is in neither table: it is listed for each that has one.
    named = F.when(F.col(on).isNull() & (F.col("__sides") == 3), F.array(F.lit("first"), F.lit("second"))).when(F.col("__sides") == 1, F.array(F.lit("first"))).when(F.col("__sides") == 2, F.array(F.lit("second")))
    return sides.select(on, F.explode(named).alias("side"))
