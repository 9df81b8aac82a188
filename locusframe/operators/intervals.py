"""Operators on half-open intervals: islands, overlap joins, association, gaps and peaks.

Overlap joins are equi-joins on (contig, bin): each interval is exploded to the
bins it touches and a pair counts only in the bin of the later start, so no
distinct is needed. Sweeps run per contig and coarse bin first and are
stitched over what is left, so a contig with most rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scan import lagged, ranked, spread

#: Width of a join bin, and of the coarse bins of a sweep, in positions.
BIN, SWEEP_BIN = 64, 1 << 14
#: Each level of an overlap join has bins so many times wider.
LEVEL = 16


def _merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Islands of (start, stop) within ``keys``; touching intervals merge. One window over the keys."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("__top", F.max("stop").over(before)).withColumn("__new", (F.col("__top").isNull() | (F.col("__top") < F.col("start"))).cast("int"))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__island")


def islands(df: DataFrame, keys: Sequence[str] = ("contig",), sweep_bin: int = SWEEP_BIN) -> DataFrame:
    """Maximal merged intervals: (keys, start, stop). Touching intervals merge; intervals without a key are left out.

    Intervals are merged within coarse bins of the start. Only pieces that a
    border of bins may join to others, two of a bin at most, meet in one task
    of their key: pieces that what started in earlier bins covers are left out,
    and pieces that nothing can touch stay in their bin.
    """
    binned = df.select(*keys, "start", "stop", F.floor(F.col("start") / sweep_bin).alias("__bin"))
    pieces = _merge(binned, [*keys, "__bin"])
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = pieces.groupBy(*keys, "__bin").agg(F.max("stop").alias("__far")).select(*keys, "__bin", F.max("__far").over(earlier).alias("__reach"))
    marked = pieces.join(reach, [*keys, "__bin"]).where("__reach IS NULL OR stop > __reach")
    joined_up = (F.col("start") <= F.coalesce("__reach", F.col("start") - 1)) | (F.col("stop") >= (F.col("__bin") + 1) * sweep_bin)
    parts = marked.select(*keys, "start", "stop", F.when(~joined_up, F.col("__bin")).alias("__part"))
    return _merge(parts, [*keys, "__part"]).drop("__part")


def with_island(df: DataFrame, keys: Sequence[str] = ("contig",), sweep_bin: int = SWEEP_BIN) -> DataFrame:
    """``df`` with ``union_start``, the start of the island of each interval (islands are found by start)."""
    isl = islands(df, keys, sweep_bin).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("union_start"), F.col("stop").alias("__stop"))
    # An island covers whole coarse bins at worst; each interval meets it in the bin of its own start.
    isl = isl.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("union_start") / sweep_bin), F.floor((F.col("__stop")) / sweep_bin))))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    cond = F.floor(F.col("start") / sweep_bin) == F.col("__bin")
    for c in same:
        cond = cond & c
    cond = cond & (F.col("start") >= F.col("union_start")) & (F.col("start") <= F.col("__stop"))
    # Neighbouring islands do not touch, so a start lies in one island only.
    return df.join(isl, cond).drop(*[f"__{k}" for k in keys], "__stop", "__bin")


def overlap_join(a: DataFrame, b: DataFrame, touching: bool = False, bin_width: int = BIN, levels: int = 1) -> DataFrame:
    """Pairs of overlapping intervals: all columns of ``a`` with prefix ``a_``, of ``b`` with ``b_``.

    ``touching`` also pairs an interval of ``b`` that ends where one of ``a`` starts.
    Each level has bins ``LEVEL`` times wider; an interval belongs to the first
    level at which it touches ``LEVEL`` bins at most (the last takes all), and a
    pair meets at the higher level of its two. So with enough levels an interval
    of any length makes few rows; one level is best where all are short.
    """
    reach = 1 if touching else 0

    def exploded(df: DataFrame, prefix: str, extra: int) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])
        start, last = F.col(f"{prefix}start"), F.greatest(F.col(f"{prefix}start"), F.col(f"{prefix}stop") - 1 + extra)
        if levels > 1:
            own = F.coalesce(*[F.when(last - start < bin_width * LEVEL ** (i + 1), F.lit(i)) for i in range(levels - 1)], F.lit(levels - 1))
            df = df.withColumn(f"{prefix}__own", own).withColumn(f"{prefix}__level", F.explode(F.sequence(own, F.lit(levels - 1))))
            width = F.element_at(F.array(*[F.lit(bin_width * LEVEL**i) for i in range(levels)]), F.col(f"{prefix}__level") + 1)
        else:
            df, width = df.withColumn(f"{prefix}__own", F.lit(0)).withColumn(f"{prefix}__level", F.lit(0)), F.lit(bin_width)
        bins = F.posexplode(F.sequence(F.floor(start / width), F.floor(last / width))).alias(f"{prefix}__at", f"{prefix}__bin")
        return df.select("*", bins).withColumn(f"{prefix}__first", F.col(f"{prefix}__at") == 0).drop(f"{prefix}__at")

    x, y = exploded(a, "a_", 0), exploded(b, "b_", reach)
    cond = (
        (F.col("a_contig") == F.col("b_contig"))
        & (F.col("a___bin") == F.col("b___bin"))
        # The bin of the later start: the first bin of one of the two.
        & (F.col("a___first") | F.col("b___first"))
        & (F.col("a_start") < F.col("b_stop") + reach)
        & (F.col("b_start") < F.col("a_stop"))
    )
    if levels > 1:
        cond = cond & (F.col("a___level") == F.col("b___level")) & (F.col("a___level") == F.greatest("a___own", "b___own"))
    return x.join(y, cond).drop(*[f"{p}___{c}" for p in "ab" for c in ("own", "level", "first", "bin")])


def annotate(
    regions: DataFrame, features: DataFrame, report: str = "intersection", no_orphans: bool = False, one_based: bool = False, strand: bool = False, source: str | None = None
) -> DataFrame:
    """(region id, feature id, contig, start, stop) of overlapping pairs; ``report`` says whose bounds: region, annotation, intersection.

    Starts are given one-based. ``one_based`` tells that those of the regions
    are so too; ``no_orphans`` makes a region without a feature an error when
    read; ``strand`` adds the region's strand and ``source`` a column of that text.
    """
    if one_based:
        regions = regions.withColumn("start", F.col("start") - 1)
    pairs = overlap_join(regions, features)
    start, stop = {
        "region": (F.col("a_start"), F.col("a_stop")),
        "annotation": (F.col("b_start"), F.col("b_stop")),
        "intersection": (F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop")),
    }[report]
    more = ([F.col("a_strand").alias("strand")] if strand else []) + ([F.lit(source).alias("source")] if source is not None else [])
    found = pairs.select(F.col("a_id").alias("region_id"), F.col("b_id").alias("feature_id"), F.col("a_contig").alias("contig"), (start + 1).alias("start"), stop.alias("stop"), *more)
    if no_orphans:
        alone = orphans(regions, features)
        error = F.raise_error(F.concat(F.lit("no annotation overlaps region "), F.col("id").cast("string")))
        found = found.union(alone.select(*[(error if i == 0 else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(found.schema)]))
    return found


def orphans(regions: DataFrame, features: DataFrame) -> DataFrame:
    """Regions that overlap no feature."""
    hit = overlap_join(regions, features).select(F.col("a_id").alias("id")).distinct()
    return regions.join(hit, "id", "left_anti")


def distance(q_start: Column, q_stop: Column, t_start: Column, t_stop: Column) -> Column:
    """Displacement that would make two intervals adjacent: the gap between them, or less their overlap."""
    before, after = q_start - t_stop, t_start - q_stop
    return F.when(F.abs(before) < F.abs(after), before).otherwise(after)


def associate(queries: DataFrame, targets: DataFrame, max_distance: int, max_between: int, min_distance: int | None = None, first_id: int = 0) -> DataFrame:
    """Targets whose distance to a query lies in ``min_distance``..``max_distance``, with at most ``max_between`` nearer distances on their side.

    Columns: assoc (numbered from ``first_id`` in order of query and target), q,
    t, distance, overlap, between and, where both tables have a strand,
    orientation (SAME or OPP). A negative distance is an overlap: a negative
    ``min_distance`` caps it, a negative ``max_distance`` asks for one. Nearer
    are the distinct distances below, among all targets within reach that end
    before the query's end or, if the target does not, begin after its begin.

    Pairs are not shuffled unless queries share ids: queries and the targets in their reach meet in
    cells of a contig, where pairs are first counted, then numbered and given in
    order; a task holds the targets of one cell, and some pairs at a time.
    """
    reach = max(0, max_distance)
    stranded = "strand" in queries.columns and "strand" in targets.columns
    whole = F.col("contig").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull()
    side = F.col("strand").cast("string") if stranded else F.lit(None).cast("string")
    at, end = F.col("start").cast("long").alias("__start"), F.col("stop").cast("long").alias("__stop")
    q, t = queries.where(whole), targets.where(whole)
    longest, rows, ids = q.agg(F.max(F.col("stop") - F.col("start")), F.count(F.lit(1)), F.count_distinct("id")).first()
    if rows != ids:
        return _associate_repeated(queries, targets, max_distance, max_between, min_distance, first_id)
    longest = longest or 0
    width = 1 << max(10, int(longest + reach).bit_length())
    none = lambda df: F.lit(None).cast(df.schema["id"].dataType)
    asking = q.select("contig", F.floor(F.col("start") / width).alias("__cell"), F.lit(1).alias("__kind"), at, end, none(t).alias("t"), F.col("id").alias("q"), side.alias("__side"))
    cells = F.explode(F.sequence(F.floor((F.col("start") - reach - longest) / width), F.floor((F.col("stop") + reach) / width)))
    asked = t.select("contig", cells.alias("__cell"), F.lit(0).alias("__kind"), at, end, F.col("id").alias("t"), none(q).alias("q"), side.alias("__side"))

    def in_cells(rows: DataFrame, schema: T.StructType, base: bool) -> DataFrame:
        sent = spread(rows, "contig", "__cell").sortWithinPartitions("contig", "__cell", "__kind", "__start", "t", "q")
        return sent.mapInArrow(lambda batches: _associated(batches, schema.names, reach, max_between, max_distance, min_distance, stranded, base), schema)

    counts = in_cells(asking.unionByName(asked), T.StructType([queries.schema["contig"], *T.StructType.fromDDL("__cell long, n long")]), False)
    before = Window.orderBy("contig", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("contig", "__cell", (F.coalesce(F.sum("n").over(before), F.lit(0)) + first_id).alias("__base"))
    numbered = asking.join(bases, ["contig", "__cell"]).unionByName(asked.withColumn("__base", F.lit(0).cast("long")))
    names = T.StructType.fromDDL("distance long, overlap long, " + ("orientation string, " if stranded else "") + "between long, assoc long")
    return in_cells(numbered, T.StructType([T.StructField("q", queries.schema["id"].dataType), T.StructField("t", targets.schema["id"].dataType), *names]), True)


def _associate_repeated(queries: DataFrame, targets: DataFrame, max_distance: int, max_between: int, min_distance: int | None, first_id: int) -> DataFrame:
    """``associate`` where queries share ids: nearer distances count over all rows of an id, so pairs are shuffled to it."""
    reach = max(0, max_distance)
    stranded = "strand" in queries.columns and "strand" in targets.columns
    sides = ["strand"] if stranded else []
    padded = queries.select("id", "contig", (F.col("start") - reach).alias("start"), (F.col("stop") + reach + 1).alias("stop"), F.col("start").alias("q_start"), F.col("stop").alias("q_stop"), *sides)
    pairs = overlap_join(padded, targets.select("id", "contig", "start", "stop", *sides), touching=True, bin_width=max(BIN, reach))
    near = pairs.select(
        F.col("a_id").alias("q"),
        F.col("b_id").alias("t"),
        distance(F.col("a_q_start"), F.col("a_q_stop"), F.col("b_start"), F.col("b_stop")).alias("distance"),
        F.greatest(F.lit(0), F.least("a_q_stop", "b_stop") - F.greatest("a_q_start", "b_start")).alias("overlap"),
        (F.col("a_q_stop") > F.col("b_stop")).alias("__ends"),
        (F.col("a_q_start") < F.col("b_start")).alias("__begins"),
        F.col("a_contig").alias("__contig"), F.col("a_q_start").alias("__at"), F.col("b_start").alias("__t_at"),
        *([F.when(F.col("a_strand") == F.col("b_strand"), "SAME").otherwise("OPP").alias("orientation")] if stranded else []),
    ).where(F.col("distance") <= reach)
    nearer = lambda side: (F.dense_rank().over(Window.partitionBy("q", side).orderBy("distance")) - 1).cast("long")
    between = F.when(F.col("__ends"), nearer("__ends")).when(F.col("__begins"), nearer("__begins")).otherwise(0)
    kept = near.withColumn("between", between.cast("long")).where((F.col("between") <= max_between) & (F.col("distance") <= max_distance))
    if min_distance is not None:
        kept = kept.where(F.col("distance") >= min_distance)
    numbered = ranked(kept, [F.col("__contig"), F.floor(F.col("__at") / SWEEP_BIN)], ["__at", "q", "__t_at", "t"], "assoc")
    return numbered.withColumn("assoc", F.col("assoc") - 1 + first_id).drop("__ends", "__begins", "__contig", "__at", "__t_at")


#: Pairs that are looked at together.
PAIRS = 1 << 15


def _dense_rank(d: np.ndarray, side: np.ndarray, qi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(0-based dense rank of ``d`` among the pairs of a query for which ``side`` holds, any number for others; distinct values of each query)."""
    rank, distinct = np.zeros(len(d), np.int64), np.zeros(n, np.int64)
    some, who = d[side], qi[side]
    if not len(some):
        return rank, distinct
    low = int(some.min())
    width = int(some.max()) - low + 1
    if n * width <= 8 * len(d) + PAIRS:
        seen = np.zeros((n, width), bool)
        seen[who, some - low] = True
        order = seen.cumsum(1, dtype=np.int32)
        rank[side] = order[who, some - low] - 1
        return rank, order[:, -1].astype(np.int64)
    order = np.lexsort((some, who))
    w, v = who[order], some[order]
    begins = np.concatenate(([True], w[1:] != w[:-1]))
    steps = np.cumsum(begins | np.concatenate(([True], v[1:] != v[:-1])))
    ranks = steps - np.maximum.accumulate(np.where(begins, steps, 0))
    back = np.empty(len(order), np.int64)
    back[order] = ranks
    rank[side] = back
    np.maximum.at(distinct, w, ranks + 1)
    return rank, distinct


class _Cell:
    """The targets of a cell, by (start, id), with the queries' pairs."""

    def __init__(self, start: np.ndarray, stop: np.ndarray, reach: int, between: int, most: int, least: int | None):
        self.start, self.stop, self.far = start, stop, np.maximum.accumulate(stop)
        self.reach, self.between, self.most, self.least = reach, between, most, least

    def _pairs(self, qs: np.ndarray, qe: np.ndarray, lo: np.ndarray, n: np.ndarray, overlapping: bool):
        """(query, target, distance, overlap, between) of the kept pairs, and whether a query has all its nearer distances already."""
        qi = np.repeat(np.arange(len(qs)), n)
        ti = np.arange(len(qi)) + np.repeat(lo - (np.cumsum(n) - n), n)
        a, z, b, y = qs[qi], qe[qi], self.start[ti], self.stop[ti]
        before, after = a - y, b - z
        d = np.where(np.abs(before) < np.abs(after), before, after)
        inside = (before < 0) & (after < 0) if overlapping else (before <= self.reach) & (after <= self.reach) & (d <= self.reach)
        ends, begins = z > y, a < b
        by_end, ended = _dense_rank(d, inside & ends, qi, len(qs))
        by_begin, begun = _dense_rank(d, inside & begins, qi, len(qs))
        nearer = np.where(ends, by_end, np.where(begins, by_begin, 0))
        keep = inside & (nearer <= self.between) & (d <= self.most)
        if self.least is not None:
            keep &= d >= self.least
        enough = (ended > self.between) & (begun > self.between) & (qe > qs)
        overlap = np.maximum(0, np.minimum(z, y) - np.maximum(a, b))
        return [x[keep] for x in (qi, ti, d, overlap, nearer)], enough

    def chunks(self, qs: np.ndarray, qe: np.ndarray):
        """Kept pairs of the queries in order, some queries at a time."""
        lo, hi = np.searchsorted(self.far, qs - self.reach), np.searchsorted(self.start, qe + self.reach, "right")
        # Distances of overlaps are below all others: a query with enough of them needs no more targets.
        near, last = np.searchsorted(self.far, qs, "right"), np.searchsorted(self.start, qe)
        n, few = np.maximum(hi - lo, 0), np.maximum(last - near, 0)
        work = np.cumsum(n)
        i = 0
        while i < len(qs):
            j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + PAIRS)))
            found, enough = self._pairs(qs[i:j], qe[i:j], near[i:j], few[i:j], True)
            if not enough.all():
                rest = np.flatnonzero(~enough)
                more, _ = self._pairs(qs[i:j][rest], qe[i:j][rest], lo[i:j][rest], n[i:j][rest], False)
                more[0] = rest[more[0]]
                done = enough[found[0]]
                found = [np.concatenate((x[done], y)) for x, y in zip(found, more, strict=True)]
                order = np.argsort(found[0], kind="stable")
                found = [x[order] for x in found]
            found[0] = found[0] + i
            yield found
            i = j


def _associated(batches, names: list[str], reach: int, between: int, most: int, least: int | None, stranded: bool, based: bool):
    """Rows of cells in order, targets first: the number of kept pairs of each cell, or (``based``) the pairs, numbered."""
    key, targets, cell, total, base = None, [], None, 0, 0

    def counted():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([key[1]], pa.int64()), pa.array([total], pa.int64())], names)

    kind = None
    for b in batches:
        kind = b.column("contig").type
        keys = list(zip(b.column("contig").to_pylist(), b.column("__cell").to_pylist(), b.column("__kind").to_pylist(), strict=True))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            if keys[i][:2] != key:
                if key is not None and not based and total:
                    yield counted()
                key, targets, cell, total = keys[i][:2], [], None, 0
            part = b.slice(i, j - i)
            if keys[i][2] == 0:
                targets.append(part)
                continue
            if not targets:
                continue
            if cell is None:
                rows = pa.Table.from_batches(targets).combine_chunks()
                cell = _Cell(rows.column("__start").to_numpy(), rows.column("__stop").to_numpy(), reach, between, most, least)
            for qi, ti, d, overlap, nearer in cell.chunks(part.column("__start").to_numpy(), part.column("__stop").to_numpy()):
                total += len(qi)
                if based and len(qi):
                    base = part.column("__base")[0].as_py()
                    number = np.arange(base + total - len(qi), base + total)
                    qi, ti = pa.array(qi), pa.array(ti)
                    same = []
                    if stranded:
                        alike = pc.fill_null(pc.equal(part.column("__side").take(qi), rows.column("__side").combine_chunks().take(ti)), False)
                        same = [pc.if_else(alike, "SAME", "OPP")]
                    found = [part.column("q").take(qi), rows.column("t").combine_chunks().take(ti), pa.array(d), pa.array(overlap), *same, pa.array(nearer), pa.array(number)]
                    yield pa.RecordBatch.from_arrays(found, names)
    if key is not None and not based and total:
        yield counted()


def gaps(df: DataFrame, lengths: DataFrame, sweep_bin: int = SWEEP_BIN) -> DataFrame:
    """Stretches of each contig of ``lengths`` (contig, length) that no interval covers: (contig, start, stop)."""
    edges = islands(df, sweep_bin=sweep_bin).select("contig", "start", "stop")
    edges = edges.union(lengths.select("contig", F.col("length").alias("start"), F.col("length").alias("stop")))
    before = lagged(edges, "stop", ["contig"], ["start", "stop"], F.floor(F.col("start") / sweep_bin))
    found = before.select("contig", F.coalesce("previous", F.lit(0)).alias("start"), F.col("start").alias("stop"))
    return found.where("stop > start").join(lengths.select("contig"), "contig", "left_semi")


def runs(df: DataFrame, keys: Sequence[str], locus: str, keep: Column, sweep_bin: int = SWEEP_BIN) -> DataFrame:
    """Runs of consecutive loci for which ``keep`` holds: (keys, start, stop), both ends included. A repeated locus counts once."""
    single = df.where(keep).select(*keys, F.col(locus).alias("start"), (F.col(locus) + 1).alias("stop"))
    return islands(single, keys, sweep_bin).withColumn("stop", F.col("stop") - 1)


def peaks(df: DataFrame, threshold: float, keys: Sequence[str] = ("chrom",), locus: str = "locus", value: str = "depth") -> DataFrame:
    """Maximal runs of consecutive loci whose value is at least ``threshold``."""
    return runs(df, keys, locus, F.col(value) >= threshold)


def uncovered(df: DataFrame, least: int, keys: Sequence[str] = ("chrom",), locus: str = "locus", value: str = "depth") -> DataFrame:
    """Runs of loci of value 0, ``least`` long or longer."""
    return runs(df, keys, locus, F.col(value) == 0).where(F.col("stop") - F.col("start") + 1 >= least)


def edge_flags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``leftmost`` and ``rightmost``: first and last interval of each group, by (start, stop, id)."""
    place = F.struct("start", "stop", "id")
    ends = df.groupBy(*keys).agg(F.min(place).alias("__first"), F.max(place).alias("__last")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__first", "__last")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(ends, same).select(*df.columns, (place == F.col("__first")).alias("leftmost"), (place == F.col("__last")).alias("rightmost"))


def flanks(df: DataFrame, five: int, three: int, lengths: DataFrame) -> DataFrame:
    """Intervals widened by 5' and 3' flanks along their strand, clipped to the contig."""
    minus = F.col("strand") == "-"
    left, right = F.when(minus, three).otherwise(five), F.when(minus, five).otherwise(three)
    return (
        df.join(lengths, "contig")
        .withColumn("start", F.greatest(F.lit(0), F.col("start") - left))
        .withColumn("stop", F.least(F.col("length"), F.col("stop") + right))
        .drop("length")
    )
