"""Motif search: weight matrices and consensus sets over windows, score thresholds, clusters of hits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import IUPAC, IUPAC_COMPLEMENT
from ..plans.scan import kept, ranked, spread
from .intervals import SWEEP_BIN, with_island
from .kmers import Letters, scanned

Matrix = Sequence[dict[str, int]]


# --- matrices (small, on the driver) ----------------------------------------------


def expand_matrix(matrix: Matrix) -> list[dict[str, int]]:
    """Columns over A, C, G, T widened to IUPAC codes: a code weighs the least of its members."""
    bases = "ACGT"
    out = []
    for col in matrix:
        wide = {}
        for mask, code in enumerate(IUPAC, 1):
            wide[code] = min(col[b] for i, b in enumerate(bases) if mask >> i & 1)
        out.append(wide)
    return out


def reverse_matrix(matrix: Matrix) -> list[dict[str, int]]:
    swap = dict(zip(IUPAC, IUPAC_COMPLEMENT, strict=True))
    return [{swap[b]: v for b, v in c.items()} for c in reversed(matrix)]


# --- scores ------------------------------------------------------------------------


def matrix_score(window: Column, matrix: Matrix) -> Column:
    """Sum of the weights of a window's bases: one string lookup per column of the matrix, no join."""
    terms = []
    for i, col in enumerate(matrix):
        bases = "".join(col)
        weights = F.array(F.lit(None).cast("long"), *[F.lit(int(v)).cast("long") for v in col.values()])
        terms.append(F.get(weights, F.instr(F.lit(bases), F.substring(window, i + 1, 1))))
    return reduce(lambda a, b: a + b, terms)


def mismatches(window: Column, consensus: str) -> Column:
    """Positions at which a window's base is not among those of the IUPAC consensus."""
    codes = {c: i for i, c in enumerate(IUPAC, 1)}
    terms = []
    for i, c in enumerate(consensus):
        allowed = [b for j, b in enumerate("ACGT") if codes[c] >> j & 1]
        terms.append((~F.substring(window, i + 1, 1).isin(*allowed)).cast("long"))
    return reduce(lambda a, b: a + b, terms)


def _hits(starts: np.ndarray, letters: Letters, k: int, strand: str, *values: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    return starts, [letters.words(starts, k), pa.array([strand]).take(pa.array(np.zeros(len(starts), np.int64))), *values]


def matrix_hits(seqs: DataFrame, matrix: Matrix, least: int, strands: Sequence[str] = "+-", ambiguous: bool = False) -> DataFrame:
    """(id, pos, kmer, strand, score) of the windows that score ``least`` or more on a strand.

    The other strand is scored by the reversed matrix on the same window, so
    sequences are read once and only hits become rows. A window with other
    letters than A, C, G and T has no score, or, if ``ambiguous``, the least
    that its IUPAC codes allow.
    """
    m = expand_matrix(matrix) if ambiguous else matrix
    k, none = len(matrix), -(1 << 50)
    tables = {}
    for strand, columns in (("+", m), ("-", reverse_matrix(m))):
        if strand in strands:
            tables[strand] = np.full((k, 256), none, np.int64)
            for table, column in zip(tables[strand], columns, strict=True):
                for base, weight in column.items():
                    table[ord(base)] = int(weight)

    def find(letters: Letters):
        ok = letters.whole(k)
        for strand, weights in tables.items():
            score = np.zeros(len(ok), np.int64)
            for j in range(k):
                score += letters.looked_up(weights[j])[j : j + len(ok)]
            starts = np.flatnonzero(ok & (score >= max(least, none // 2)))
            yield _hits(starts, letters, k, strand, pa.array(score[starts]))

    return scanned(seqs, k - 1, "kmer string, strand string, score long", find)


def consensus_hits(seqs: DataFrame, consensus: Sequence[str], most: int, strands: Sequence[str] = "+") -> DataFrame:
    """(id, pos, kmer, strand, consensus, mismatches) of the windows within ``most`` mismatches of one of a set; one pass for each length."""
    swap = dict(zip(IUPAC, IUPAC_COMPLEMENT, strict=True))
    codes = {c: i for i, c in enumerate(IUPAC, 1)}
    parts = []
    for k in sorted({len(c) for c in consensus}):
        tables = []
        for c in consensus:
            for t in strands if len(c) == k else ():
                table = np.ones((k, 256), np.int64)
                for column, x in zip(table, c if t == "+" else [swap[x] for x in reversed(c)], strict=True):
                    column[[ord(b) for i, b in enumerate("ACGT") if codes[x] >> i & 1]] = 0
                tables.append((c, t, table))

        def find(letters: Letters, k=k, tables=tables):
            ok = letters.whole(k)
            for c, t, table in tables:
                wrong = np.zeros(len(ok), np.int64)
                for j in range(k):
                    wrong += letters.looked_up(table[j])[j : j + len(ok)]
                starts = np.flatnonzero(ok & (wrong <= most))
                yield _hits(starts, letters, k, t, pa.array([c]).take(pa.array(np.zeros(len(starts), np.int64))), pa.array(wrong[starts]))

        parts.append(scanned(seqs, k - 1, "kmer string, strand string, consensus string, mismatches long", find))
    return reduce(DataFrame.unionByName, parts)


def words_that_reach(matrix: Matrix, least: int, most: int) -> dict[str, int] | None:
    """The words that score ``least`` or more, by branch and bound; None if they, or beginnings of them, are more than ``most``."""
    rest = [sum(max(c.values()) for c in matrix[i:]) for i in range(len(matrix) + 1)]
    found = {"": 0}
    for i, column in enumerate(matrix):
        found = {w + b: n + x for w, n in found.items() for b, x in column.items() if n + x + rest[i + 1] >= least}
        if len(found) > most:
            return None
    return found


def index_hits(index: DataFrame, matrix: Matrix, least: int, strands: Sequence[str] = "+-", most: int = 1 << 16) -> DataFrame:
    """(id, pos, kmer, strand, score) out of a k-mer index whose k-mers are as long as the matrix, or longer.

    The words that score enough are listed first, if they are no more than
    ``most``: the index is read once, and its entries meet them by their first
    letters. Otherwise distinct beginnings are scored: an entry is
    read only if its ``prefix`` can still reach ``least`` with the best weights
    behind it, and each k-mer is scored once, whatever its number of positions.
    """
    back = reverse_matrix(matrix)
    k = len(matrix)
    made = {t: m for t, m in (("+", matrix), ("-", back)) if t in strands}
    lists = {t: words_that_reach(m, least, most) for t, m in made.items()}
    if all(x is not None for x in lists.values()):
        spark = index.sparkSession
        table = spark.createDataFrame([(w, t, int(n)) for t, x in lists.items() for w, n in x.items()], "word string, strand string, score long")
        words = index.withColumn("word", F.left("kmer", F.lit(k)))
        return words.join(F.broadcast(table), "word").select("id", "pos", F.col("word").alias("kmer"), "strand", "score")

    def reach(m: Matrix, width: int) -> Column:
        head = F.col("prefix")
        rest = sum(max(c.values()) for c in m[width:])
        return matrix_score(F.substring(head, 1, min(width, k)), m[:width]) + rest

    width = min(k, 4)
    best = F.greatest(*[reach(m, width) for m in made.values()], F.lit(None).cast("long"))
    words = index.where(best >= least).withColumn("word", F.left("kmer", F.lit(k)))
    each = F.array(*[F.struct(F.lit(t).alias("strand"), matrix_score(F.col("word"), m).alias("score")) for t, m in made.items()])
    scored = words.select("word").distinct().withColumn("m", F.explode(F.filter(each, lambda x: x["score"] >= least)))
    return words.join(scored, "word").select("id", "pos", F.col("word").alias("kmer"), "m.strand", "m.score")


def mutation_path(a: Column, b: Column, k: int) -> Column:
    """Sequences from ``a`` to ``b``, of ``k`` letters, by point mutations from left to right; where they agree nothing is added."""
    steps = [F.concat(F.left(b, F.lit(i)), F.substring(a, i + 1, k)) for i in range(k + 1)]
    return F.array_distinct(F.array(*steps))


def path_similarity(scores: Column) -> Column:
    """Mean absolute change of score along a path of point mutations; 0 for a path without a step."""
    n = F.size(scores) - 1
    steps = F.zip_with(F.slice(scores, 1, F.greatest(n, F.lit(0))), F.slice(scores, 2, F.greatest(n, F.lit(0))), lambda x, y: F.abs(y - x).cast("double"))
    return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda t, x: t + x) / F.nullif(n, F.lit(0))).otherwise(0.0)


def path_scores(path: Column, matrix: Matrix) -> Column:
    return F.transform(path, lambda w: matrix_score(w, matrix))


def top_levels(hits: DataFrame, most: int, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Hits of the best score levels: levels are added until they hold more than ``most`` hits; that level is still kept.

    The window runs over one row per score level.
    """
    levels = hits.groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    kept = levels.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).where(F.col("__above") <= most).select(*by, score)
    return hits.join(kept, [*by, score], "left_semi")


# --- clusters ------------------------------------------------------------------------


def diversity_windows(hits: DataFrame, span: int, needs: dict[str, int], least: int) -> DataFrame:
    """Hits that open a valid window: (contig, id, start, window_stop), where at least ``least`` groups reach their number.

    A window holds the hits from its own on, in (start, stop, id) order, that
    start within ``span``.
    """
    counts = [F.sum((F.col("grp") == g).cast("long")).alias(f"n_{i}") for i, g in enumerate(needs)]
    # Hits of one start see the same later starts: starts meet each other once, by an equi-join on bins of the span.
    places = hits.groupBy("contig", "start").agg(*counts, F.max("stop").alias("top")).withColumn("bin", F.floor(F.col("start") / span))
    a = places.select("contig", "start", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    b = places.select("contig", "bin", F.col("start").alias("o_start"), F.col("top").alias("o_top"), *[f"n_{i}" for i in range(len(needs))])
    near = spread(a, "contig", "bin").join(spread(b, "contig", "bin"), ["contig", "bin"]).where((F.col("o_start") > F.col("start")) & (F.col("o_start") <= F.col("start") + span))
    later = near.groupBy(F.col("contig").alias("__contig"), F.col("start").alias("__start")).agg(*[F.sum(f"n_{i}").alias(f"l_{i}") for i in range(len(needs))], F.max("o_top").alias("l_top"))
    # Of its own start, a hit sees those that come after it, and itself.
    own = Window.partitionBy("contig", "start").orderBy(F.desc("stop"), F.desc("id")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    h = hits.select("contig", "id", "start", "stop", *[F.sum((F.col("grp") == g).cast("long")).over(own).alias(f"s_{i}") for i, g in enumerate(needs)], F.max("stop").over(own).alias("s_top")).distinct()
    seen = h.join(later, (F.col("contig") == F.col("__contig")) & (F.col("start") == F.col("__start")), "left")
    met = reduce(lambda x, y: x + y, [(F.coalesce(f"s_{i}", F.lit(0)) + F.coalesce(f"l_{i}", F.lit(0)) >= n).cast("long") for i, n in enumerate(needs.values())])
    return seen.where(met >= least).select("contig", "id", "start", F.greatest("s_top", "l_top").alias("window_stop"), met.cast("long").alias("met"))


def cluster_members(hits: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """Merged clusters: each hit in some valid window, with the start of the cluster of windows that chain through shared hits, and its number.

    Clusters are numbered from 1 in order of contig and first hit.
    """
    bin_ = F.floor(F.col("start") / span)
    w = windows.select("contig", "start").distinct().select(F.col("contig").alias("c"), F.col("start").alias("w_start"), F.explode(F.array(bin_, bin_ + 1)).alias("w_bin"))
    places = hits.select("contig", "start").distinct().withColumn("bin", bin_)
    # The windows of a start reach from its first to its last one, among those that open in its bin or the bin before.
    within = (F.col("start") >= F.col("w_start")) & (F.col("start") <= F.col("w_start") + span)
    met = spread(places, "contig", "bin").join(spread(w, "c", "w_bin"), (F.col("contig") == F.col("c")) & (F.col("bin") == F.col("w_bin")) & within)
    spans = met.groupBy(F.col("contig").alias("c"), F.col("start").alias("h")).agg(F.min("w_start").alias("first"), F.max("w_start").alias("last"))
    # Hits whose reaches touch are chained.
    joined = hits.join(spans, (F.col("contig") == F.col("c")) & (F.col("start") == F.col("h")))
    reach = joined.select("contig", "id", F.col("start").alias("h_start"), F.col("stop").alias("h_stop"), F.col("first").alias("start"), F.col("last").alias("stop")).distinct()
    reach = kept(reach, "reaches")  # islands, their numbers and the members read them
    chained = with_island(reach, sweep_bin=max(SWEEP_BIN, span))
    first = chained.groupBy("contig", "union_start").agg(F.min("h_start").alias("cluster_start"))
    numbered = ranked(first, [F.col("contig"), F.floor(F.col("cluster_start") / SWEEP_BIN)], ["cluster_start"], "cluster")
    found = chained.join(numbered, ["contig", "union_start"])
    return found.select("contig", "id", F.col("h_start").alias("start"), F.col("h_stop").alias("stop"), "cluster_start", "cluster")
