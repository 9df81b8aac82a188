"""Registered queries over the stand-in views, and the SQL that must agree with them.

Every query runs over its whole tables. Doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import querylang
from ..functions import cigar, readname, seq
from ..operators import conservation as cons
from ..operators import coverage, intervals, kmers, motif, projection, records, scoring, simulate, stats
from ..sources import sequences
from .scan import dealt, ranked
from .standins import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

View = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    """Registers a builder that gets a function from view names to DataFrames."""

    def register(build: Callable[[View], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda v: view(spark, sf_dir, v))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return build

    return register


def _islands(source: str, body: str) -> str:
    """SQL that numbers the islands of ``source`` as isl(contig, start, stop, union_start, ...)."""
    return f"""
    WITH o AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {source}),
    n AS (SELECT *, sum(CASE WHEN top IS NULL OR top < start THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, stop, id) AS island FROM o)
    {body}"""


# --- intervals -------------------------------------------------------------------


def _regions(v: View) -> tuple[DataFrame, DataFrame]:
    """Both tables of regions, dealt out to all cores: each row makes many pairs."""
    return dealt(v("reg_a"), "id"), dealt(v("reg_b"), "id")


@query("union_regions", _islands("reg_a", "SELECT contig, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM n GROUP BY contig, island"))
def _(v):
    return intervals.islands(v("reg_a"))


@query("union_idmap", _islands("reg_a", "SELECT id, contig, (min(start) OVER (PARTITION BY contig, island))::BIGINT AS union_start FROM n"))
def _(v):
    return intervals.with_island(v("reg_a")).select("id", "contig", "union_start")


_PAIRS = "SELECT a.id AS a_id, b.id AS b_id FROM reg_a a JOIN reg_b b ON a.contig = b.contig AND a.start < b.stop{} AND b.start < a.stop"


@query("interval_overlap", _PAIRS.format(""))
def _(v):
    return intervals.overlap_join(*_regions(v)).select("a_id", "b_id")


@query("interval_overlap_touching", _PAIRS.format(" + 1"))
def _(v):
    return intervals.overlap_join(*_regions(v), touching=True).select("a_id", "b_id")


for _report, _bounds in {"region": ("a.start + 1", "a.stop"), "annotation": ("b.start + 1", "b.stop"), "intersection": ("greatest(a.start, b.start) + 1", "least(a.stop, b.stop)")}.items():
    query(
        f"annotate_{_report}",
        f"SELECT a.id AS region_id, b.id AS feature_id, a.contig, {_bounds[0]} AS start, {_bounds[1]} AS stop "
        "FROM reg_a a JOIN reg_b b ON a.contig = b.contig AND a.start < b.stop AND b.start < a.stop",
    )(lambda v, r=_report: intervals.annotate(*_regions(v), r))


@query("orphan_regions", "SELECT id FROM reg_a a WHERE NOT EXISTS (SELECT 1 FROM reg_b b WHERE a.contig = b.contig AND a.start < b.stop AND b.start < a.stop)")
def _(v):
    return intervals.orphans(*_regions(v)).select("id")


@query(
    "associate_regions",
    """WITH p AS (
      SELECT a.contig, a.start AS q_at, b.start AS t_at, a.id AS q, b.id AS t, CASE WHEN abs(a.start - b.stop) < abs(b.start - a.stop) THEN a.start - b.stop ELSE b.start - a.stop END AS distance,
             greatest(0, least(a.stop, b.stop) - greatest(a.start, b.start)) AS overlap, a.stop > b.stop AS ends, a.start < b.start AS begins
      FROM reg_a a JOIN reg_b b ON a.contig = b.contig AND b.start <= a.stop + 100 AND a.start <= b.stop + 100),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY q, ends ORDER BY distance) - 1 AS e, dense_rank() OVER (PARTITION BY q, begins ORDER BY distance) - 1 AS b FROM p),
    k AS (SELECT *, CASE WHEN ends THEN e WHEN begins THEN b ELSE 0 END AS nearer FROM r)
    SELECT row_number() OVER (ORDER BY contig, q_at, q, t_at, t) - 1 AS assoc, q, t, distance, overlap, nearer AS "between" FROM k WHERE nearer <= 2 AND distance >= -30""",
)
def _(v):
    return intervals.associate(*_regions(v), 100, 2, min_distance=-30)


@query(
    "interspersed_regions",
    _islands(
        "reg_a",
        """, i AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM n GROUP BY contig, island),
    e AS (SELECT contig, start, stop FROM i UNION ALL SELECT DISTINCT contig, 250000, 250000 FROM reg_a),
    g AS (SELECT contig, coalesce(lag(stop) OVER (PARTITION BY contig ORDER BY start, stop), 0) AS start, start AS stop FROM e)
    SELECT contig, start::BIGINT AS start, stop::BIGINT AS stop, strand FROM g, (VALUES ('POS'), ('NEG')) s(strand) WHERE stop > start""",
    ),
)
def _(v):
    regions = v("reg_a")
    found = intervals.gaps(regions, regions.select("contig").distinct().withColumn("length", F.lit(250000).cast("long")))
    return found.withColumn("strand", F.explode(F.array(F.lit("POS"), F.lit("NEG"))))


def _runs(keep: str, least: int = 1) -> str:
    return f"""WITH k AS (SELECT chrom, locus, locus - row_number() OVER (PARTITION BY chrom ORDER BY locus) AS run FROM depth WHERE {keep})
    SELECT chrom, min(locus)::BIGINT AS start, max(locus)::BIGINT AS stop FROM k GROUP BY chrom, run HAVING max(locus) - min(locus) + 1 >= {least}"""


@query("peak_regions", _runs("depth >= 2"))
def _(v):
    return intervals.peaks(v("depth"), 2)


@query("uncovered_regions", _runs("depth = 0", 3))
def _(v):
    return intervals.uncovered(v("depth"), 3)


@query(
    "region_edges",
    """SELECT id, contig, row_number() OVER (PARTITION BY contig, grp ORDER BY start, stop, id) = 1 AS leftmost,
      row_number() OVER (PARTITION BY contig, grp ORDER BY start DESC, stop DESC, id DESC) = 1 AS rightmost FROM reg_b""",
)
def _(v):
    return intervals.edge_flags(v("reg_b"), ["contig", "grp"]).select("id", "contig", "leftmost", "rightmost")


# --- genes and transcripts ------------------------------------------------------------

_EXONS = "(SELECT *, transcript AS id FROM exon)"


@query("meta_exons", _islands(_EXONS, "SELECT contig, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM n GROUP BY contig, island"))
def _(v):
    return projection.meta_exons(v("exon"))


@query("gene_bounds", "SELECT contig, gene, min(start) AS start, max(stop) AS stop, count(DISTINCT transcript) AS transcripts FROM exon GROUP BY contig, gene")
def _(v):
    return projection.gene_bounds(v("exon"))


@query("transcript_number", "SELECT gene, transcript, row_number() OVER (PARTITION BY gene ORDER BY transcript DESC) AS number FROM (SELECT DISTINCT gene, transcript FROM exon)")
def _(v):
    return projection.transcript_numbers(v("exon"))


@query("transcript_length", "SELECT contig, transcript, strand, sum(stop - start)::BIGINT AS length FROM exon GROUP BY contig, transcript, strand")
def _(v):
    return projection.transcript_lengths(v("exon"))


@query(
    "overlapping_exons",
    "SELECT transcript, start, stop FROM (SELECT *, max(stop) OVER (PARTITION BY transcript ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b "
    "FROM (SELECT DISTINCT transcript, pos AS start, pos + len AS stop FROM aln)) WHERE b > start",
)
def _(v):
    placed = v("aln").select("transcript", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop")).distinct()
    return projection.overlapping_exons(placed).select("transcript", "start", "stop")


@query(
    "collapse_introns",
    _islands(
        _EXONS,
        """, i AS (SELECT contig, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM n GROUP BY contig, island)
    SELECT contig, start, stop, (coalesce(sum(stop - start) OVER w, 0) + 25 * count(*) OVER w)::BIGINT AS drawn_start
    FROM i WINDOW w AS (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
)
def _(v):
    return projection.collapse_introns(v("exon"))


@query(
    "expanded_position",
    """WITH e AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY transcript ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
      sum(stop - start) OVER (PARTITION BY transcript) AS length FROM exon),
    r AS (SELECT DISTINCT transcript, line AS pos FROM aln),
    p AS (SELECT r.transcript, r.pos, CASE WHEN e.strand = '-' THEN e.length - r.pos - 1 ELSE r.pos END AS att, e.* EXCLUDE (transcript) FROM r JOIN e USING (transcript))
    SELECT transcript, pos::INT AS pos, max(CASE WHEN att >= used AND att < used + stop - start THEN start + att - used END)::BIGINT AS target_pos
    FROM p GROUP BY transcript, pos""",
)
def _(v):
    reads = v("aln").select("transcript", F.col("line").alias("pos"), F.lit(1).alias("reflen")).distinct()
    return projection.expanded_positions(reads, projection.transcript_blocks(v("exon"))).select("transcript", "pos", "target_pos")


@query(
    "projection_header",
    """WITH c AS (SELECT contig, row_number() OVER (ORDER BY contig) AS ord, max(stop) + 1 AS length FROM exon GROUP BY contig),
    o AS (SELECT contig, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c),
    t AS (SELECT contig, transcript, min(start) AS start, sum(stop - start) AS length FROM exon GROUP BY contig, transcript)
    SELECT transcript, (off + start)::BIGINT AS flat, '@SQ' || chr(9) || 'SN:' || transcript || chr(9) || 'LN:' || length AS line FROM t JOIN o USING (contig)""",
)
def _(v):
    exon = v("exon")
    contigs = exon.groupBy("contig").agg((F.max("stop") + 1).alias("length")).withColumn("ord", F.row_number().over(Window.orderBy("contig")))
    return projection.projection_header(projection.transcript_blocks(exon), records.contig_table(contigs))


@query(
    "loci_to_genes",
    """WITH g AS (SELECT contig, gene, min(start) AS start, max(stop) AS stop FROM exon GROUP BY contig, gene)
    SELECT e.transcript AS id, e.start, g.gene, e.start - g.start AS "offset" FROM exon e JOIN g ON e.contig = g.contig AND g.start <= e.start AND e.stop <= g.stop""",
)
def _(v):
    exon = v("exon")
    # The id is the pair itself: a start may have any number of digits.
    loci = exon.select(F.struct("transcript", "start").alias("id"), "contig", "start", "stop")
    found = projection.loci_to_genes(loci, projection.gene_bounds(exon))
    return found.select(F.col("id.transcript").alias("id"), F.col("id.start").alias("start"), "gene", "offset")


@query(
    "transcript_to_gene",
    "SELECT a.fid, a.line, a.price, e.gene FROM aln a JOIN (SELECT DISTINCT transcript, gene FROM exon) e USING (transcript)",
)
def _(v):
    genes = v("exon").select("transcript", "gene").distinct()
    return v("aln").join(genes, "transcript").select("fid", "line", "price", "gene")


@query(
    "uniform_fragments",
    """WITH t AS (SELECT transcript, sum(stop - start) AS length FROM exon GROUP BY transcript)
    SELECT transcript, s AS start, s + z AS stop FROM t, unnest(generate_series(40, 120, 20)) AS q(z), LATERAL (SELECT unnest(generate_series(0, (length - z)::BIGINT, 25)) AS s) WHERE z <= length""",
)
def _(v):
    return simulate.uniform_fragments(projection.transcript_lengths(v("exon")), 25, 40, 20, 120)


# --- depth -----------------------------------------------------------------------

_READS = "(SELECT contig, pos AS start, pos + len AS stop, 1 AS guide, CASE WHEN score < 6 THEN 1 ELSE 0 END AS correct, CASE WHEN score >= 9 THEN 1 ELSE 0 END AS error FROM aln)"
_JUMPS = f"""WITH ev AS (SELECT contig, start AS pos, guide AS g, correct AS c, error AS e FROM {_READS} UNION ALL SELECT contig, stop, -guide, -correct, -error FROM {_READS}),
    j AS (SELECT contig, pos, sum(g)::BIGINT AS guide, sum(c)::BIGINT AS correct, sum(e)::BIGINT AS error FROM ev GROUP BY contig, pos HAVING sum(g) <> 0 OR sum(c) <> 0 OR sum(e) <> 0)"""
_RUNS = f"""{_JUMPS}, runs AS (SELECT contig, pos AS start, lead(pos) OVER w AS stop, (sum(guide) OVER w)::BIGINT AS guide, (sum(correct) OVER w)::BIGINT AS correct, (sum(error) OVER w)::BIGINT AS error
    FROM j WINDOW w AS (PARTITION BY contig ORDER BY pos))"""


def _jumps(v: View) -> DataFrame:
    reads = v("aln").select("contig", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"), F.lit(1).alias("guide"), (F.col("score") < 6).cast("int").alias("correct"), (F.col("score") >= 9).cast("int").alias("error"))
    return coverage.jumps(reads)


@query("jumps", f"{_JUMPS} SELECT * FROM j")
def _(v):
    return _jumps(v)


@query("coverage_runs", f"{_RUNS} SELECT * FROM runs WHERE stop IS NOT NULL AND (guide <> 0 OR correct <> 0 OR error <> 0)")
def _(v):
    return coverage.coverage_runs(coverage.integrate(_jumps(v)))


@query("coverage_bases", f"{_RUNS} SELECT contig, unnest(generate_series(start + 1, stop)) AS pos, guide, correct, error FROM runs WHERE stop IS NOT NULL AND (guide <> 0 OR correct <> 0 OR error <> 0)")
def _(v):
    return coverage.coverage_bases(coverage.integrate(_jumps(v)))


@query(
    "mask_regions",
    f"""{_RUNS}, k AS (SELECT * FROM runs WHERE stop IS NOT NULL AND guide > 0 AND (10 * correct < 4 * guide OR 10 * error > 3 * guide)),
    m AS (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY contig ORDER BY start) = start THEN 0 ELSE 1 END AS new FROM k),
    i AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start) AS island FROM m)
    SELECT contig, min(start) AS start, max(stop) AS stop FROM i GROUP BY contig, island""",
)
def _(v):
    bad = (F.col("guide") > 0) & ((10 * F.col("correct") < 4 * F.col("guide")) | (10 * F.col("error") > 3 * F.col("guide")))
    return coverage.mask_regions(coverage.integrate(_jumps(v)), bad)


@query(
    "depth_stats",
    f"""{_RUNS}, a AS (SELECT start, stop, guide, correct, error FROM runs WHERE stop IS NOT NULL UNION ALL SELECT 0, min(start), 0, 0, 0 FROM runs GROUP BY contig)
    SELECT guide, correct, error, sum(stop - start)::BIGINT AS loci FROM a GROUP BY guide, correct, error HAVING sum(stop - start) > 0""",
)
def _(v):
    return coverage.depth_histogram(coverage.integrate(_jumps(v)))


@query(
    "depth_distribution",
    f"""{_RUNS}, t AS (SELECT *, stop - start AS w FROM runs WHERE stop IS NOT NULL AND guide > 0),
    f AS (SELECT fraction, sum(cl)::BIGINT AS correct_loci, sum(el)::BIGINT AS error_loci FROM (
      SELECT round(correct / guide, 6) AS fraction, w AS cl, 0 AS el FROM t UNION ALL SELECT round(error / guide, 6), 0, w FROM t) GROUP BY fraction)
    SELECT fraction, correct_loci, coalesce(sum(correct_loci) OVER (ORDER BY fraction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS correct_before,
      error_loci, coalesce(sum(error_loci) OVER (ORDER BY fraction ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS error_left FROM f""",
)
def _(v):
    return coverage.guide_fractions(coverage.integrate(_jumps(v)))


@query(
    "accuracy_summary",
    """WITH s AS (SELECT sum(len) AS guide, sum(CASE WHEN score < 6 THEN len ELSE 0 END) AS correct, sum(CASE WHEN score >= 9 THEN len ELSE 0 END) AS error,
      sum(CASE WHEN score BETWEEN 6 AND 8 AND mapq > 0 THEN len ELSE 0 END) AS removed, sum(CASE WHEN score BETWEEN 6 AND 8 AND mapq = 0 THEN len ELSE 0 END) AS skipped FROM aln)
    SELECT guide::BIGINT AS guide, (correct + error + removed)::BIGINT AS used, (correct + error + removed + skipped)::BIGINT AS total, correct::BIGINT AS correct, error::BIGINT AS error,
      removed::BIGINT AS removed, skipped::BIGINT AS skipped, round(100 * correct / (correct + error + removed), 6) AS correct_pct, round(100 * error / (correct + error + removed), 6) AS error_pct FROM s""",
)
def _(v):
    some = lambda c: F.when(c, F.col("len")).otherwise(0)
    score, mapq = F.col("score"), F.col("mapq")
    middle = score.between(6, 8)
    return coverage.accuracy_summary(v("aln").select(F.col("len").alias("guide"), some(score < 6).alias("correct"), some(score >= 9).alias("error"), some(middle & (mapq > 0)).alias("removed"), some(middle & (mapq == 0)).alias("skipped")))


@query(
    "mapq_histogram",
    """SELECT v AS value, n, (sum(n) OVER (ORDER BY v))::BIGINT AS upto FROM (
      SELECT v, count(mapq) AS n FROM unnest(generate_series(0, 255)) AS t(v) LEFT JOIN aln ON mapq = v GROUP BY v)""",
)
def _(v):
    return coverage.quality_histogram(v("aln"), "mapq", 255)


@query(
    "accuracy_full",
    """SELECT c.category, b AS bin, count(r.len) AS n FROM (SELECT DISTINCT contig AS category FROM aln) c CROSS JOIN unnest(generate_series(0, 50)) AS t(b)
      LEFT JOIN aln r ON r.contig = c.category AND r.len = b GROUP BY c.category, b""",
)
def _(v):
    return coverage.accuracy_bins(v("aln").select(F.col("contig").alias("category"), F.col("len").alias("correct")), bins=50)


@query("accuracy_halfs", "SELECT contig AS category, count(*) FILTER (len < 25) AS under, count(*) FILTER (len >= 25) AS over FROM aln GROUP BY contig".replace(" over ", ' "over" '))
def _(v):
    return coverage.accuracy_bins(v("aln").select(F.col("contig").alias("category"), F.col("len").alias("correct")), bins=50, halves=True)


# --- order -----------------------------------------------------------------------

_CONTIGS = """c AS (SELECT contig, row_number() OVER (ORDER BY contig) AS ord, max(pos + len) + 1 AS length FROM aln GROUP BY contig),
    o AS (SELECT contig, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)"""
_TIES = ("fid", "line", "price", "transcript", "len", "score", "mapq")


def _contigs(v: View) -> DataFrame:
    c = v("aln").groupBy("contig").agg((F.max(F.col("pos") + F.col("len")) + 1).alias("length"))
    return records.contig_table(c.withColumn("ord", F.row_number().over(Window.orderBy("contig"))))


@query(
    "sort_align",
    f"""WITH {_CONTIGS} SELECT off + pos AS flat, {", ".join(_TIES)}, row_number() OVER (ORDER BY off + pos, {", ".join(_TIES)}) AS rank
    FROM aln JOIN o USING (contig)""".replace("off + pos AS flat", "(off + pos)::BIGINT AS flat"),
)
def _(v):
    return records.rank_alignments(v("aln"), "ALIGN", _contigs(v), _TIES[1:]).select("flat", *_TIES, "rank")


@query(
    "sort_min_align_guide",
    f"""WITH {_CONTIGS} SELECT least(off + pos, off + transcript * 11)::BIGINT AS flat, {", ".join(_TIES)},
      row_number() OVER (ORDER BY least(off + pos, off + transcript * 11), {", ".join(_TIES)}) AS rank FROM aln JOIN o USING (contig)""",
)
def _(v):
    rows = v("aln").withColumn("guide_pos", F.col("transcript") * 11)
    return records.rank_alignments(rows, "MIN_ALIGN_GUIDE", _contigs(v), _TIES[1:]).select("flat", *_TIES, "rank")


@query(
    "sort_guide",
    f"""WITH {_CONTIGS} SELECT (off + transcript * 11)::BIGINT AS flat, {", ".join(_TIES)}, row_number() OVER (ORDER BY off + transcript * 11, {", ".join(_TIES)}) AS rank
    FROM (SELECT DISTINCT contig, pos, {", ".join(_TIES)} FROM aln) JOIN o USING (contig)""",
)
def _(v):
    rows = v("aln").select("contig", "pos", *_TIES).distinct().withColumn("guide_pos", F.col("transcript") * 11)
    return records.rank_alignments(rows, "GUIDE", _contigs(v), _TIES[1:]).select("flat", *_TIES, "rank")


@query(
    "sort_position_and_read",
    """SELECT ord, row_number() OVER (ORDER BY pos, strand, replace(cigar, 'T', 'N'), pnext, next_contig, fid, first, ord) AS rank
    FROM (SELECT *, (pos % 9 + 1) || 'M' || (fid % 3 + 1) || CASE WHEN first THEN 'T' ELSE 'N' END || '5M' AS cigar FROM pair_rows)""",
)
def _(v):
    s = lambda c: c.cast("string")
    cigars = F.concat(s(F.col("pos") % 9 + 1), F.lit("M"), s(F.col("fid") % 3 + 1), F.when(F.col("first"), "T").otherwise("N"), F.lit("5M"))
    rows = v("pair_rows").select("ord", F.col("pos").alias("flat"), "strand", cigars.alias("cigar"), F.col("pnext").alias("mate_flat"), F.col("next_contig").alias("space"), "fid", "first")
    # Positions are few and crowded here: each of them, by strand, is a group.
    return ranked(rows, [F.col("flat"), F.col("strand")], [*records.comparator("position_and_read"), "ord"]).select("ord", "rank")


_NAMES = r"""p AS (SELECT id, CASE WHEN id % 3 = 0 THEN regexp_extract(name, '^([^:]+):', 1) WHEN id % 3 = 1 THEN regexp_extract(name, '^([^:]+:[^:]+:[^:]+):', 1) END AS flowcell,
      CASE WHEN id % 3 = 2 THEN [0, 0, 0, name::BIGINT] WHEN id % 3 = 0 THEN list_transform(string_split(split_part(name, '#', 1), ':')[2:], lambda x: x::BIGINT)
           ELSE list_transform(string_split(split_part(name, ' ', 1), ':')[4:], lambda x: x::BIGINT) END AS f FROM names)"""


@query("read_name_parse", f"WITH {_NAMES} SELECT id, flowcell, f[1] AS lane, f[2] AS tile, f[3] AS x, f[4] AS y FROM p")
def _(v):
    return v("names").withColumn("f", readname.fragment_id(F.col("name"))).select("id", "f.*")


@query(
    "sort_fragment",
    f"WITH {_NAMES} SELECT id, flowcell, f[1] AS lane, f[2] AS tile, row_number() OVER (ORDER BY flowcell NULLS FIRST, f[1], f[2], f[3], f[4], id) AS rank FROM p",
)
def _(v):
    f = v("names").withColumn("f", readname.fragment_id(F.col("name"))).select("id", "f.*")
    return records.rank_alignments(f, "FRAGMENT", tie=["id"]).select("id", "flowcell", "lane", "tile", "rank")


@query(
    "sort_projections",
    "SELECT transcript, start, row_number() OVER (ORDER BY contig, start, transcript, strand) AS rank FROM (SELECT contig, transcript, strand, min(start) AS start FROM exon GROUP BY contig, transcript, strand)",
)
def _(v):
    return ranked(projection.transcript_blocks(v("exon")), [F.col("contig"), F.floor(F.col("start") / 16384)], ["start", "transcript", "strand"]).select("transcript", "start", "rank")


@query(
    "truncated_records",
    "SELECT fid::VARCHAR AS qname, pos, CASE WHEN len % 3 = 0 THEN (len % 7) || 'S' ELSE len || 'M' END AS cigar, '*' AS seq, '*' AS qual FROM aln",
)
def _(v):
    length = (F.col("len") % 7).cast("int")
    rows = v("aln").select("fid", F.lit("name").alias("qname"), "pos", F.when(F.col("len") % 3 == 0, "*").otherwise(F.concat(F.col("len").cast("string"), F.lit("M"))).alias("cigar"), F.repeat(F.lit("A"), length).alias("seq"), F.lit("I").alias("qual"))
    return records.truncate(rows)


@query("concatenated", "SELECT id, contig, start, stop, strand, coalesce(grp, '') AS grp FROM (SELECT id, contig, start, stop, strand, NULL AS grp FROM reg_a UNION ALL SELECT id, contig, start, stop, 'none', grp FROM reg_b)")
def _(v):
    both = records.concatenated([v("reg_a"), v("reg_b")])
    return both.withColumn("strand", F.coalesce("strand", F.lit("none"))).withColumn("grp", F.coalesce("grp", F.lit("")))


@query("checksort", "SELECT id, start, previous FROM (SELECT id, contig, start, lag(start) OVER (PARTITION BY contig ORDER BY id) AS previous FROM reg_a) WHERE previous > start")
def _(v):
    return records.order_violations(v("reg_a"), "id", "start", ["contig"]).select("id", "start", "previous")


@query("repeated_keys", "SELECT fid, line, count(*) AS n FROM aln GROUP BY fid, line HAVING count(*) > 1")
def _(v):
    return records.repeated_keys(v("aln"), ["fid", "line"])


@query("key_collisions", "SELECT count(*) AS rows, count(DISTINCT pos * 64 + len) AS keys, count(*) - count(DISTINCT pos * 64 + len) AS collisions FROM aln".replace("AS rows", 'AS "rows"'))
def _(v):
    return records.key_collisions(v("aln"), F.col("pos") * 64 + F.col("len"))


# --- records -----------------------------------------------------------------------

_ROW = "fid, line, price, transcript, score"


def _ids(v: View) -> DataFrame:
    return v("reg_a").where("strand = 'F'").select(F.col("id").alias("fid"))


@query("filter_include", f"SELECT {_ROW} FROM aln WHERE fid IN (SELECT id FROM reg_a WHERE strand = 'F')")
def _(v):
    return records.filter_fragments(v("aln"), _ids(v), include=True).select(*_ROW.split(", "))


@query("filter_exclude", f"SELECT {_ROW} FROM aln WHERE fid NOT IN (SELECT id FROM reg_a WHERE strand = 'F')")
def _(v):
    return records.filter_fragments(v("aln"), _ids(v)).select(*_ROW.split(", "))


@query("filter_matching", "SELECT id, contig, start FROM reg_a WHERE EXISTS (SELECT 1 FROM reg_b WHERE reg_b.contig = reg_a.contig AND reg_b.start = reg_a.start)")
def _(v):
    return records.matching_rows(v("reg_a"), v("reg_b"), {"contig": "string", "start": "bigint"}).select("id", "contig", "start")


@query("best_score", f"SELECT {_ROW} FROM (SELECT *, max(score) OVER (PARTITION BY fid) AS top FROM aln) WHERE score = top")
def _(v):
    return records.best_score(v("aln")).select(*_ROW.split(", "))


@query("rest_score", f"SELECT {_ROW} FROM (SELECT *, max(score) OVER (PARTITION BY fid) AS top FROM aln) WHERE score < top")
def _(v):
    return records.best_score(v("aln"), best=False).select(*_ROW.split(", "))


@query("flag_filter", f"SELECT {_ROW} FROM aln WHERE (line * 37) & 1540 = 0 AND mapq >= 2 AND coalesce(CASE WHEN line > 2 THEN line END <= 5, true) AND space = 'T'")
def _(v):
    df = v("aln").withColumn("rank", F.when(F.col("line") > 2, F.col("line")))
    return records.filter_records(df, readname.flag_filter(F.col("line") * 37, "MQd"), 2, 5, None, "T").select(*_ROW.split(", "))


@query(
    "pileup_filter",
    """SELECT id, len(regexp_extract_all(s, 'A'))::INT AS n_A, len(regexp_extract_all(s, 'T'))::INT AS n_T FROM seq WHERE length(s) >= 200""",
)
def _(v):
    return records.pileup_filter(v("seq"), "AT", 200, "s").select("id", "n_A", "n_T")


_MATE_KEYS = "PARTITION BY fid, readno ORDER BY input_seq"


@query(
    "mate_pairs",
    f"""WITH k AS (SELECT *, row_number() OVER ({_MATE_KEYS}) AS k FROM mates)
    SELECT a.fid, a.k::INT AS k, a.input_seq AS first_seq, b.input_seq AS second_seq FROM k a JOIN k b ON a.fid = b.fid AND a.k = b.k AND a.readno = 0 AND b.readno = 1""",
)
def _(v):
    return records.pair_mates(v("mates"), ["input_seq"]).select("fid", "k", F.col("first.input_seq").alias("first_seq"), F.col("second.input_seq").alias("second_seq"))


@query(
    "mate_join",
    """WITH k AS (SELECT *, CASE WHEN unmapped THEN NULL WHEN first THEN pos ELSE pnext END AS p, CASE WHEN unmapped THEN NULL WHEN first THEN pnext ELSE pos END AS q,
        CASE WHEN unmapped THEN NULL WHEN first THEN strand ELSE next_strand END AS s, CASE WHEN unmapped THEN NULL WHEN first THEN next_strand ELSE strand END AS t,
        CASE WHEN unmapped THEN NULL ELSE next_contig END AS c, multi AND (unmapped OR mapped) AS able FROM pair_rows),
    n AS (SELECT *, row_number() OVER (PARTITION BY fid, able, unmapped, p, q, s, t, c, first ORDER BY ord) AS k FROM k)
    SELECT coalesce(a.fid, b.fid) AS fid, coalesce(a.ord, -1) AS first_ord, coalesce(b.ord, -1) AS second_ord, coalesce(a.pos <= b.pos, false) AS left_is_first
    FROM (SELECT * FROM n WHERE first) a FULL JOIN (SELECT * FROM n WHERE NOT first) b ON a.able AND b.able AND a.fid = b.fid AND a.unmapped = b.unmapped AND a.k = b.k
      AND a.p IS NOT DISTINCT FROM b.p AND a.q IS NOT DISTINCT FROM b.q AND a.s IS NOT DISTINCT FROM b.s AND a.t IS NOT DISTINCT FROM b.t AND a.c IS NOT DISTINCT FROM b.c""",
)
def _(v):
    return records.mate_pairs(v("pair_rows"), ["ord"]).select(
        "fid", F.coalesce("first.ord", F.lit(-1)).alias("first_ord"), F.coalesce("second.ord", F.lit(-1)).alias("second_ord"), F.coalesce("left_is_first", F.lit(False)).alias("left_is_first")
    )


@query(
    "extract_fastq",
    f"""WITH k AS (SELECT fid, readno, s, md5(s) AS q, input_seq % 3 = 0 AS minus FROM (SELECT *, row_number() OVER ({_MATE_KEYS}) AS n FROM mates) WHERE n = 1),
    o AS (SELECT *, min(readno) OVER (PARTITION BY fid) = max(readno) OVER (PARTITION BY fid) AS orphan FROM k)
    SELECT CASE WHEN orphan THEN 'orphans' WHEN readno = 0 THEN 'first' ELSE 'second' END AS file,
      '@' || fid || chr(10) || CASE WHEN minus THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END || chr(10) || '+' || chr(10) || CASE WHEN minus THEN reverse(q) ELSE q END AS value FROM o""",
)
def _(v):
    reads = v("mates").select("fid", "readno", "input_seq", F.col("s").alias("seq"), F.md5("s").alias("qual"), (F.col("input_seq") % 3 == 0).alias("strand"))
    sinks = records.extract_reads(reads, ["input_seq"])
    lines = [sequences.fastq_lines(df.select(F.col("fid").cast("string").alias("id"), F.col("seq").alias("s"), F.col("qual").alias("q"))).select(F.lit(name).alias("file"), "value") for name, df in sinks.items()]
    return records.concatenated(lines)


@query("extract_first_seen", f"SELECT fid, readno, input_seq FROM (SELECT *, row_number() OVER ({_MATE_KEYS}) AS n FROM mates) WHERE n = 1")
def _(v):
    return records.first_seen(v("mates"), ["input_seq"]).select("fid", "readno", "input_seq")


@query("orphans", "SELECT fid, line, price, readno FROM (SELECT *, min(readno) OVER w = max(readno) OVER w AS orphan FROM aln WINDOW w AS (PARTITION BY fid)) WHERE orphan")
def _(v):
    return records.with_orphan(v("aln")).where("orphan").select("fid", "line", "price", "readno")


@query("dedup_best_mapq", f"SELECT {_ROW}, mapq FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos, strand, space ORDER BY mapq DESC, fid, line, price, len, score) AS n FROM aln) WHERE n = 1")
def _(v):
    return records.dedup_best(v("aln"), ["contig", "pos", "strand", "space"], [F.desc("mapq"), F.asc("fid"), F.asc("line"), F.asc("price"), F.asc("len"), F.asc("score")]).select(*_ROW.split(", "), "mapq")


@query("deal", "SELECT id, (id % 3)::BIGINT AS hand, id // 3 AS place FROM seq")
def _(v):
    return records.deal(v("seq"), 3, "id").select("id", F.col("hand").cast("long").alias("hand"), "place")


def _halves(v: View) -> tuple[DataFrame, DataFrame]:
    m = v("mates").withColumn("rec_no", F.floor(F.col("input_seq") / 2) + F.col("fid") * 100)
    return m.where("readno = 0").select("rec_no", "s"), m.where("readno = 1").select("rec_no", "s")


@query("shuffle_pairs", "SELECT (fid * 100 + input_seq // 2) * 2 + readno AS place, s FROM mates")
def _(v):
    return records.interleave(*_halves(v)).select("place", "s")


@query(
    "zip_records",
    """WITH h AS (SELECT fid * 100 + input_seq // 2 AS rec_no, readno, s FROM mates)
    SELECT coalesce(a.rec_no, b.rec_no) AS rec_no, a.s AS s1, b.s AS s2 FROM (SELECT * FROM h WHERE readno = 0) a FULL JOIN (SELECT * FROM h WHERE readno = 1) b ON a.rec_no = b.rec_no""",
)
def _(v):
    return records.zip_records(_halves(v))


@query("merge_orphans", "SELECT DISTINCT fid FROM aln WHERE readno = 0 AND fid IN (SELECT fid FROM aln WHERE readno = 1)")
def _(v):
    a = v("aln")
    return records.merge_orphans(a.where("readno = 0"), a.where("readno = 1"))


@query(
    "multi_join",
    "SELECT a.contig, a.start, a.id AS t1_id, a.stop AS t1_stop, b.id AS t2_id, b.grp AS t2_grp, c.id AS t3_id FROM reg_a a JOIN reg_b b USING (contig, start) JOIN reg_a c USING (contig, start)",
)
def _(v):
    a, b = v("reg_a"), v("reg_b")
    return records.multi_join([a.select("contig", "start", "id", "stop"), b.select("contig", "start", "id", "grp"), a.select("contig", "start", "id")], ["contig", "start"])


@query(
    "rejoin",
    "SELECT a.fid, a.line, a.price, t.r::INT AS readno, ['q' || a.fid, 'r' || a.fid][t.r + 1] AS s FROM aln a, (VALUES (0), (1)) t(r)",
)
def _(v):
    reads = F.array(*[F.struct(F.concat(F.lit(p), F.col("id").cast("string")).alias("s"), F.lit("*").alias("q")) for p in "qr"])
    seqs = v("reg_a").select(F.col("id").alias("fid"), reads.alias("reads"))
    return records.rejoin(v("aln").select("fid", "line", "price"), seqs).select("fid", "line", "price", "readno", "s")


@query(
    "rejoin_filtered",
    "SELECT a.fid, a.line, a.price, t.r::INT AS readno, ['q' || a.fid, 'r' || a.fid][t.r + 1] AS s FROM aln a, (VALUES (0), (1)) t(r) WHERE (line * 37) & 1540 = 0 AND mapq >= 2",
)
def _(v):
    reads = F.array(*[F.struct(F.concat(F.lit(p), F.col("id").cast("string")).alias("s"), F.lit("*").alias("q")) for p in "qr"])
    keep = readname.flag_filter(F.col("line") * 37, "MQd") & (F.col("mapq") >= 2)
    return records.rejoin(v("aln").select("fid", "line", "price", "mapq"), v("reg_a").select(F.col("id").alias("fid"), reads.alias("reads")), keep=keep).select("fid", "line", "price", "readno", "s")


@query("unmapped_reads", "SELECT DISTINCT fid::VARCHAR AS id, r::INT AS readno, ['q', 'r'][r + 1] || fid AS s, '*' AS q FROM aln, (VALUES (0), (1)) t(r) WHERE mapq = 0 AND line = 1")
def _(v):
    reads = F.array(*[F.struct(F.concat(F.lit(p), F.col("id").cast("string")).alias("s"), F.lit("*").alias("q")) for p in "qr"])
    rows = v("aln").select("fid", (F.col("mapq") > 0).alias("mapped"), F.col("line").alias("rank"))
    return records.unmapped_reads(rows, v("reg_a").select(F.col("id").alias("fid"), reads.alias("reads")))


@query("merge_spaces", "SELECT fid, contig, pos, CASE WHEN min(space) = max(space) THEN min(space) ELSE 'M' END AS space, max(mapq) AS mapq, count(*) AS n FROM aln GROUP BY fid, contig, pos")
def _(v):
    return records.merge_spaces(v("aln"))


@query(
    "reconcile_keys",
    "SELECT id, 'first' AS side FROM reg_a WHERE id NOT IN (SELECT id FROM reg_b) UNION ALL SELECT id, 'second' FROM reg_b WHERE id NOT IN (SELECT id FROM reg_a)",
)
def _(v):
    return records.reconcile(v("reg_a"), v("reg_b"), "id")


@query(
    "boundary_genes",
    "SELECT contig, pos, array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes FROM (SELECT contig, gene, start AS pos FROM exon UNION ALL SELECT contig, gene, stop FROM exon) GROUP BY contig, pos",
)
def _(v):
    return projection.boundary_genes(v("exon")).withColumn("genes", F.array_join(F.transform("genes", lambda g: g.cast("string")), ","))


@query(
    "sort_projected",
    """WITH e AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY transcript ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
      sum(stop - start) OVER (PARTITION BY transcript) AS length FROM exon),
    r AS (SELECT DISTINCT transcript, line AS pos FROM aln),
    p AS (SELECT r.transcript, r.pos, e.contig, max(CASE WHEN att >= used AND att < used + stop - start THEN start + att - used END) AS target
      FROM r JOIN (SELECT * FROM e) e USING (transcript), LATERAL (SELECT CASE WHEN e.strand = '-' THEN e.length - r.pos - 1 ELSE r.pos END AS att) GROUP BY r.transcript, r.pos, e.contig),
    c AS (SELECT contig, row_number() OVER (ORDER BY contig) AS ord, max(stop) + 1 AS length FROM exon GROUP BY contig),
    o AS (SELECT contig, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
    SELECT transcript, pos::INT AS pos, (off + target)::BIGINT AS flat, row_number() OVER (ORDER BY off + target NULLS FIRST, transcript, pos) AS rank FROM p JOIN o USING (contig)""",
)
def _(v):
    exon = v("exon")
    contigs = exon.groupBy("contig").agg((F.max("stop") + 1).alias("length")).withColumn("ord", F.row_number().over(Window.orderBy("contig")))
    reads = v("aln").select("transcript", F.col("line").alias("pos"), F.lit(1).alias("reflen")).distinct()
    placed = projection.by_projected_start(reads, projection.transcript_blocks(exon), records.contig_table(contigs))
    return ranked(placed.select("transcript", "pos", "flat"), [F.floor(F.col("flat") / 4096)], ["flat", "transcript", "pos"])


@query("two_bit", "SELECT id, p AS pos, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(s, p + 1, 6), ''), lambda c: (strpos('ACGT', c) - 1)::BIGINT)), lambda a, x: a * 4 + x) AS packed "
       "FROM seq, LATERAL (SELECT unnest(range(0, length(s) - 5)) AS p)")
def _(v):
    return kmers.packed(v("seq"), 6).select("id", F.col("pos").cast("long").alias("pos"), "packed")


@query("pack_keys", "SELECT id, (contig::BIGINT << 55) | ((stop - start) << 41) | (start << 20) | id AS packed FROM reg_b")
def _(v):
    return v("reg_b").select("id", readname.pack_key(F.col("contig"), F.col("stop") - F.col("start"), F.col("start"), F.col("id")).alias("packed"))


# --- sequences -----------------------------------------------------------------------


@query("reverse_complement", "SELECT id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc FROM seq")
def _(v):
    return v("seq").select("id", seq.reverse_complement(F.col("s")).alias("rc"))


@query("iupac_complement", "SELECT id, translate(s, 'ACMGRSVTWYHKDBN', 'TGKCYSBAWRDMHVN') AS c FROM seq")
def _(v):
    return v("seq").select("id", seq.iupac_complement(F.col("s")).alias("c"))


@query("quality_shift", "SELECT id, array_to_string(list_transform(string_split(md5(s), ''), lambda c: chr(greatest(ascii(c) - 31, 33))), '') AS q FROM seq")
def _(v):
    return v("seq").select("id", seq.shift_quality(F.md5("s"), -31).alias("q"))


@query("quality_range", "SELECT min(ascii(list_min(string_split(md5(s), ''))))::INT AS lo, max(ascii(list_max(string_split(md5(s), ''))))::INT AS hi FROM seq")
def _(v):
    q = F.md5("s")
    return v("seq").agg(F.min(seq.lowest_quality(q)).alias("lo"), F.max(seq.highest_quality(q)).alias("hi"))


@query("accept_quality", "SELECT id, 2 * len(list_filter(string_split(md5(s), ''), lambda c: ascii(c) >= 55)) >= 32 AS ok FROM seq")
def _(v):
    return v("seq").select("id", seq.accept_quality(F.md5("s"), 55).alias("ok"))


@query("alphabet", "SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS symbol FROM seq) WHERE symbol <> '' GROUP BY symbol")
def _(v):
    return kmers.alphabet(v("seq"))


_KMERS = "(SELECT id, p AS pos, substr(s, p + 1, {k}) AS kmer FROM seq, LATERAL (SELECT unnest(range(0, length(s) - {k} + 1)) AS p))"


@query("kmer_spectrum", f"SELECT kmer, count(*) AS n FROM {_KMERS.format(k=6)} GROUP BY kmer")
def _(v):
    return kmers.kmer_counts(v("seq"), 6)


@query(
    "nmer_pairs",
    """WITH p AS (SELECT substr(s, i + 1, 5) AS a, substr(s, i + d + 1, 5) AS b FROM seq, LATERAL (SELECT unnest(range(0, length(s) - 4)) AS i), (SELECT unnest(range(20, 26)) AS d) WHERE i + d <= length(s) - 5),
    c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b)
    SELECT least(n, 100) AS times, count(*) AS pairs, sum(n)::BIGINT AS total FROM c GROUP BY least(n, 100)""",
)
def _(v):
    return kmers.pair_spectrum(v("seq"), 5, 20, 26)


@query("md5_collisions", f"SELECT substr(md5(kmer), 1, 4) AS digest, count(DISTINCT kmer) AS kmers FROM {_KMERS.format(k=6)} GROUP BY 1 HAVING count(DISTINCT kmer) > 1")
def _(v):
    return kmers.digest_collisions(v("seq"), 6, bits=16)


_CIGAR = "CAST(len AS VARCHAR(9)) || 'M' || CAST(line * 10 AS VARCHAR(9)) || 'N' || CAST(score + 1 AS VARCHAR(9)) || 'I' || CAST(mapq + 5 AS VARCHAR(9)) || 'M3S'"


def _cigars(v: View) -> DataFrame:
    s = lambda c: c.cast("string")
    text = F.concat(s(F.col("len")), F.lit("M"), s(F.col("line") * 10), F.lit("N"), s(F.col("score") + 1), F.lit("I"), s(F.col("mapq") + 5), F.lit("M3S"))
    return v("aln").select("fid", "line", "price", cigar.parse(text).alias("u"))


@query(
    "cigar_lengths",
    "SELECT fid, line, price, (len + line * 10 + mapq + 5)::BIGINT AS reference, (len + score + 1 + mapq + 5 + 3)::BIGINT AS template, (len + mapq + 5)::BIGINT AS aligned, 0::BIGINT AS left_off, 3::BIGINT AS right_off FROM aln",
)
def _(v):
    u = F.col("u")
    return _cigars(v).select("fid", "line", "price", cigar.reference_length(u).alias("reference"), cigar.template_length(u).alias("template"), cigar.aligned_length(u).alias("aligned"), cigar.left_offset(u).alias("left_off"), cigar.right_offset(u).alias("right_off"))


@query("cigar_blocks", "SELECT fid, line, price, (line * 10)::BIGINT AS second_jump, (mapq + 5)::BIGINT AS second_block FROM aln")
def _(v):
    b = F.get(cigar.blocks_of(F.filter("u", lambda x: x["op"].isin("M", "N"))), F.lit(1))
    return _cigars(v).select("fid", "line", "price", b["jump"].alias("second_jump"), b["block"].alias("second_block"))


# --- scores ------------------------------------------------------------------------------


@query(
    "top2_scores",
    """WITH d AS (SELECT DISTINCT fid, score FROM aln), r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY score DESC) AS r FROM d)
    SELECT fid, max(score) FILTER (r = 1) AS top, coalesce(max(score) FILTER (r = 2), 0) AS second FROM r GROUP BY fid""",
)
def _(v):
    return scoring.top_two(v("aln"))


_STRATA = "(SELECT *, dense_rank() OVER (PARTITION BY fid ORDER BY score DESC, CASE space WHEN 'T' THEN 1 ELSE 2 END) AS rank, count(*) OVER (PARTITION BY fid, score, space) AS stratum_size FROM aln)"


@query("strata", f"SELECT fid, line, price, transcript, rank, stratum_size FROM {_STRATA}")
def _(v):
    return scoring.strata(v("aln"), "TG").select("fid", "line", "price", "transcript", "rank", "stratum_size")


@query("primary", f"SELECT fid, line, price, transcript, row_number() OVER (PARTITION BY fid ORDER BY rank, pos, price, line, len, mapq) = 1 AS \"primary\" FROM {_STRATA}")
def _(v):
    return scoring.primary(scoring.strata(v("aln"), "TG"), ["pos", "price", "line", "len", "mapq"]).select("fid", "line", "price", "transcript", "primary")


_TOPS = """d AS (SELECT DISTINCT fid, score FROM aln), r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY score DESC) AS r FROM d),
    t AS (SELECT fid, max(score) FILTER (r = 1) AS top, coalesce(max(score) FILTER (r = 2), 0) AS second FROM r GROUP BY fid),
    q AS (SELECT top, second, score AS given, count(*) FILTER (space = 'T') AS "right", count(*) FILTER (space <> 'T') AS wrong FROM aln JOIN t USING (fid) GROUP BY top, second, score),
    m AS (SELECT *, least(255, round(-10 * log10((wrong + 1) / ("right" + wrong + 2))))::BIGINT AS mapq FROM q)"""


@query("calibration", f"WITH {_TOPS} SELECT * FROM m")
def _(v):
    return scoring.calibrate(v("aln"), F.col("space") == "T")


@query("mapq_lookup", f"WITH {_TOPS} SELECT a.fid, a.line, a.price, t.top, t.second, coalesce(m.mapq, 0) AS mapq FROM aln a JOIN t USING (fid) LEFT JOIN m ON m.top = t.top AND m.second = t.second AND m.given = a.score")
def _(v):
    return scoring.lookup_mapq(v("aln"), scoring.calibrate(v("aln"), F.col("space") == "T")).select("fid", "line", "price", "top", "second", "mapq")


# --- statistics ----------------------------------------------------------------------------

_DIMS = ("contig", "strand", "space", "score", "mapq", "line")


@query("count_cube", f"SELECT {', '.join(_DIMS)}, count(*) AS n FROM aln GROUP BY ALL")
def _(v):
    return stats.count_cube(v("aln"), _DIMS)


@query(
    "marginals",
    f"SELECT {', '.join(f'{d}::VARCHAR AS {d}' for d in _DIMS)}, count(*) AS n FROM aln GROUP BY GROUPING SETS ({', '.join(f'({d})' for d in _DIMS)}, (strand, space, score, mapq))".replace("strand::VARCHAR", "CASE strand WHEN true THEN 'true' WHEN false THEN 'false' END"),
)
def _(v):
    return stats.marginals(stats.count_cube(v("aln"), _DIMS), _DIMS, ("strand", "space", "score", "mapq"))


@query("limits", "SELECT min(score) AS min_score, max(score) AS max_score, count(DISTINCT score) AS n_score, min(pos) AS min_pos, max(pos) AS max_pos, count(DISTINCT pos) AS n_pos FROM aln")
def _(v):
    return stats.limits(v("aln"), ["score", "pos"])


@query("truncated_histogram", "SELECT b AS bin, count(depth) AS n FROM unnest(generate_series(0, 4)) AS t(b) LEFT JOIN depth ON least(depth, 4) = b GROUP BY b")
def _(v):
    return stats.truncated_histogram(v("depth"), "depth", 4)


_SD = """WITH e AS (SELECT contig, start::DOUBLE AS x, (stop - start)::DOUBLE AS v, id FROM reg_b),
    p AS (SELECT a.contig, a.id, a.x, b.v, exp(-0.5 * pow((b.x - a.x) / 200, 2)) AS w FROM e a JOIN e b ON a.contig = b.contig AND abs(b.x - a.x) <= 200),
    s AS (SELECT contig, id, x, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, sum(w * v) AS swv, sum(w * v * v) AS swv2 FROM p GROUP BY contig, id, x)
    SELECT contig, x, n, round(sqrt(greatest(0, sw / (sw * sw - sw2) * (swv2 - swv * swv / sw))), 4) AS sd FROM s WHERE n > 1"""


@query("smoothing_wsd", _SD)
def _(v):
    df = v("reg_b").select("contig", F.col("start").cast("double").alias("x0"), F.col("stop").cast("double").alias("y0"))
    return stats.smooth_sd(df, "x0", "y0", 200, ["contig"]).select("contig", "x", "n", F.round("sd", 4).alias("sd"))


@query(
    "windowed_mode",
    """WITH r AS (SELECT grp, start, row_number() OVER w - 1 AS i, lead(start, 5) OVER w - start AS gap, count(*) OVER (PARTITION BY grp) AS n FROM reg_b WINDOW w AS (PARTITION BY grp ORDER BY start)),
    d AS (SELECT *, CASE WHEN gap = 0 THEN 'infinity'::DOUBLE ELSE 1.0::DOUBLE / gap END AS d FROM r WHERE n > 5),
    e AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ahead, first_value(d) OVER (PARTITION BY grp ORDER BY i) AS head FROM d),
    f AS (SELECT grp, start, i, CASE WHEN i = 0 THEN ahead ELSE ahead + coalesce(lag(ahead, 5) OVER (PARTITION BY grp ORDER BY i), head) END AS density FROM e)
    SELECT grp, start AS mode, round(density, 9) AS density FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY density DESC, i) = 1""",
)
def _(v):
    return stats.windowed_mode(v("reg_b"), "start", 5, ["grp"]).withColumn("density", F.round("density", 9))


@query("dimension_ranks", "SELECT id, start, stop, row_number() OVER (ORDER BY start, id) - 1 AS rank_start, row_number() OVER (ORDER BY stop, id) - 1 AS rank_stop FROM reg_b")
def _(v):
    return stats.dimension_ranks(v("reg_b").select("id", "start", "stop"), ["start", "stop"], "id")


@query("quantiles", "SELECT grp, q AS quantile, round(quantile_cont(start, q), 6) AS value FROM reg_b, (VALUES (0.05), (0.5), (0.95)) t(q) GROUP BY grp, q".replace("quantile_cont(start, q)", "CASE q WHEN 0.05 THEN quantile_cont(start, 0.05) WHEN 0.5 THEN quantile_cont(start, 0.5) ELSE quantile_cont(start, 0.95) END").replace("q AS quantile", "q::DOUBLE AS quantile"))
def _(v):
    return stats.quantiles(v("reg_b"), "start", [0.05, 0.5, 0.95], ["grp"]).withColumn("value", F.round("value", 6))


@query("mean_rank", "SELECT grp, round(m, 6) AS mean, row_number() OVER (ORDER BY m DESC, grp) AS rank FROM (SELECT grp, avg(stop - start) AS m FROM reg_b GROUP BY grp)")
def _(v):
    df = v("reg_b").select("grp", (F.col("stop") - F.col("start")).alias("w"))
    return stats.mean_and_rank(df, "w", ["grp"]).withColumn("mean", F.round("mean", 6))


# --- motifs --------------------------------------------------------------------------------

MATRIX = [{"A": 5, "C": 2, "G": 1, "T": 4}, {"A": 0, "C": 6, "G": 1, "T": 1}, {"A": 7, "C": 0, "G": 2, "T": 0}, {"A": 1, "C": 1, "G": 3, "T": 6}, {"A": 2, "C": 5, "G": 5, "T": 0}]
_SCORE = " + ".join("CASE substr({w}, %d, 1) %s END" % (i + 1, " ".join(f"WHEN '{b}' THEN {n}" for b, n in col.items())) for i, col in enumerate(MATRIX))
_HITS = f"""(SELECT id, pos, kmer, strand, score FROM (
      SELECT *, '+' AS strand, {_SCORE.format(w="kmer")} AS score FROM {_KMERS.format(k=5)}
      UNION ALL SELECT *, '-', {_SCORE.format(w="reverse(translate(kmer, 'ACGT', 'TGCA'))")} FROM {_KMERS.format(k=5)}) WHERE score >= 20)"""


@query("pwm_hits", f"SELECT id, pos::INT AS pos, kmer, strand, score::BIGINT AS score FROM {_HITS}")
def _(v):
    return motif.matrix_hits(v("seq"), MATRIX, 20)


@query(
    "consensus_hits",
    f"""SELECT id, pos::INT AS pos, kmer, '+' AS strand, 'TRCAYC' AS consensus, m::BIGINT AS mismatches FROM (SELECT *,
      (CASE WHEN substr(kmer, 1, 1) <> 'T' THEN 1 ELSE 0 END + CASE WHEN substr(kmer, 2, 1) NOT IN ('A', 'G') THEN 1 ELSE 0 END + CASE WHEN substr(kmer, 3, 1) <> 'C' THEN 1 ELSE 0 END
       + CASE WHEN substr(kmer, 4, 1) <> 'A' THEN 1 ELSE 0 END + CASE WHEN substr(kmer, 5, 1) NOT IN ('C', 'T') THEN 1 ELSE 0 END + CASE WHEN substr(kmer, 6, 1) <> 'C' THEN 1 ELSE 0 END) AS m
      FROM {_KMERS.format(k=6)}) WHERE m <= 1""",
)
def _(v):
    return motif.consensus_hits(v("seq"), ["TRCAYC"], 1)


@query(
    "top_hits_by_level",
    f"""WITH h AS (SELECT * FROM {_HITS}), l AS (SELECT score, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM (SELECT score, count(*) AS n FROM h GROUP BY score))
    SELECT id, pos::INT AS pos, strand, score::BIGINT AS score FROM h JOIN l USING (score) WHERE above <= 500""",
)
def _(v):
    return motif.top_levels(motif.matrix_hits(v("seq"), MATRIX, 20), 500).select("id", "pos", "strand", "score")


_NEEDS = {"click": 1, "view": 1, "purchase": 1}
_SPAN, _LEAST = 300, 2
_WINDOWS = f"""w AS (SELECT a.contig, a.id, a.start, max(b.stop) AS window_stop,
      {" + ".join(f"CASE WHEN count(*) FILTER (b.grp = '{g}') >= {n} THEN 1 ELSE 0 END" for g, n in _NEEDS.items())} AS met
      FROM reg_b a JOIN reg_b b ON a.contig = b.contig AND b.start <= a.start + {_SPAN} AND (b.start, b.stop, b.id) >= (a.start, a.stop, a.id) GROUP BY a.contig, a.id, a.start)"""


@query("diversity_windows", f"WITH {_WINDOWS} SELECT contig, id, start, window_stop, met::BIGINT AS met FROM w WHERE met >= {_LEAST}")
def _(v):
    return motif.diversity_windows(v("reg_b"), _SPAN, _NEEDS, _LEAST)


@query(
    "cluster_members",
    f"""WITH {_WINDOWS}, v AS (SELECT * FROM w WHERE met >= {_LEAST}),
    i AS (SELECT h.contig, h.id, h.start, h.stop, min(v.start) AS f, max(v.start) AS t FROM reg_b h JOIN v ON h.contig = v.contig AND h.start >= v.start AND h.start <= v.start + {_SPAN} GROUP BY h.contig, h.id, h.start, h.stop),
    n AS (SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY contig ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
    c AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start, stop, id) AS k FROM n)
    SELECT contig, id, start, stop, min(start) OVER (PARTITION BY contig, k) AS cluster_start, dense_rank() OVER (ORDER BY contig, k) AS cluster FROM c""",
)
def _(v):
    h = v("reg_b")
    return motif.cluster_members(h, motif.diversity_windows(h, _SPAN, _NEEDS, _LEAST), _SPAN)


# --- sequences of regions and transcripts ------------------------------------------------------


def _chunks(v: View) -> DataFrame:
    return projection.dna_chunks(v("seq").withColumnRenamed("id", "contig"), 512)


# Documents stand for contigs, exons begin where their transcript does.
_PLACED = "p AS (SELECT transcript, strand, transcript % n.n AS contig, start - transcript * 50 AS start, stop - transcript * 50 AS stop FROM exon, (SELECT max(id) + 1 AS n FROM seq) n)"


def _placed_exons(v: View) -> DataFrame:
    shift = F.col("transcript") * 50
    contigs = v("seq").agg((F.max("id") + 1).alias("n"))
    return v("exon").join(F.broadcast(contigs)).select("transcript", "strand", (F.col("transcript") % F.col("n")).alias("contig"), (F.col("start") - shift).alias("start"), (F.col("stop") - shift).alias("stop"))


@query(
    "tx_sequence",
    f"""WITH {_PLACED}, c AS (SELECT transcript, p.strand, string_agg(coalesce(substr(s, start + 1, stop - start), ''), '' ORDER BY start) AS s
      FROM p LEFT JOIN seq ON contig = seq.id GROUP BY transcript, p.strand)
    SELECT transcript, CASE strand WHEN '-' THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s FROM c""",
)
def _(v):
    return projection.transcript_sequences(_placed_exons(v), _chunks(v), width=512)


@query(
    "region_sequences",
    """SELECT p.id, CASE strand WHEN '-' THEN reverse(translate(coalesce(substr(s, start + 1, stop - start), ''), 'ACGT', 'TGCA')) ELSE coalesce(substr(s, start + 1, stop - start), '') END AS s
    FROM place p LEFT JOIN seq ON contig = seq.id WHERE stop - start <= 40""",
)
def _(v):
    return projection.region_sequences(v("place"), _chunks(v), 40, 512)


@query("known_contigs", "SELECT p.id, p.contig FROM place p WHERE contig NOT IN (SELECT id FROM seq WHERE s <> '')")
def _(v):
    return projection.known_contigs(v("place"), _chunks(v))[1].select("id", "contig")


@query("difference_string", "SELECT id, array_to_string(list_transform(list_zip(string_split(md5(id::VARCHAR), ''), string_split(md5((id + 1)::VARCHAR), '')), "
       "lambda z: CASE WHEN z[1] = z[2] THEN CASE WHEN id % 2 = 0 THEN '.' ELSE ',' END WHEN id % 2 = 0 THEN upper(z[2]) ELSE z[2] END), '') AS d FROM seq")
def _(v):
    text = lambda c: F.upper(F.md5(c.cast("string")))
    return v("seq").select("id", seq.difference(text(F.col("id")), text(F.col("id") + 1), F.col("id") % 2 == 0).alias("d"))


@query(
    "strand_names",
    """SELECT id, CASE strand WHEN 'F' THEN 'NEG' WHEN 'O' THEN 'POS' ELSE 'POS_NEG' END AS strand, CASE strand WHEN 'F' THEN 'NEG' WHEN 'O' THEN 'POS' ELSE 'BOTH' END AS printed,
      CASE WHEN id % 2 = 0 THEN 'HEAD' END AS relation FROM reg_a""",
)
def _(v):
    name = seq.strand_name(F.when(F.col("strand") == "F", "-").when(F.col("strand") == "O", "+").otherwise("POS_NEG"))
    return v("reg_a").select("id", name.alias("strand"), seq.strand_print(name).alias("printed"), seq.relation_name(F.when(F.col("id") % 2 == 0, "HEAD").otherwise("HEADS")).alias("relation"))


# --- reads on transcripts -----------------------------------------------------------------------

_BLOCKS = """b AS (SELECT transcript, contig, strand, start AS at, coalesce(sum(stop - start) OVER w, 0) AS used, coalesce(sum(stop - start) OVER w, 0) + stop - start AS ending,
      start - coalesce(max(stop) OVER w, 0) AS jump, sum(stop - start) OVER (PARTITION BY transcript) AS total FROM exon
      WINDOW w AS (PARTITION BY transcript ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
# The walk of a read through the blocks: pieces of its units, and the gaps between the blocks that it passes.
_WALK = """u AS (SELECT rid, transcript, unnest(CASE WHEN strand = '-' THEN list_reverse(lens) ELSE lens END) AS len, unnest(CASE WHEN strand = '-' THEN list_reverse(ops) ELSE ops END) AS op, unnest(range(len(lens))) AS i, begin FROM r),
    c AS (SELECT *, begin + coalesce(sum(len) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at, begin + sum(len) OVER (PARTITION BY rid) AS fin FROM u),
    g AS (SELECT c.rid, greatest(c.at, b.used) AS place, 1 AS kind, least(c.at + c.len, b.ending) - greatest(c.at, b.used) AS len, c.op FROM c JOIN b USING (transcript) WHERE c.len > 0 AND b.used < c.at + c.len AND b.ending > c.at
      UNION ALL SELECT r.rid, b.used, 0, b.jump, 'N' FROM (SELECT DISTINCT rid, transcript, begin, fin FROM c) r JOIN b USING (transcript) WHERE b.used > r.begin AND b.used < r.fin),
    f AS (SELECT *, CASE WHEN lag(op) OVER w = op THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY rid ORDER BY place, kind)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY place, kind) AS run FROM f),
    m AS (SELECT rid, run, any_value(op) AS op, sum(len)::BIGINT AS len FROM h GROUP BY rid, run),
    s AS (SELECT rid, string_agg(len || op, '' ORDER BY run) AS cigar FROM m GROUP BY rid)"""


@query(
    "tx2genome",
    f"""WITH {_BLOCKS}, t AS (SELECT DISTINCT transcript, contig, strand, total FROM b),
    q AS (SELECT *, row_number() OVER () AS rid, [n1, n2, n3, n4, n5, n6] AS lens, ['S', 'M', 'I', 'M', 'D', 'M'] AS ops FROM tx_reads),
    r AS (SELECT q.rid, q.transcript, t.strand, lens, ops, CASE WHEN t.strand = '-' THEN total - (n2 + n4 + n5 + n6) - pos ELSE pos END AS begin, total FROM q JOIN t USING (transcript) WHERE mapped
      AND CASE WHEN t.strand = '-' THEN total - (n2 + n4 + n5 + n6) - pos ELSE pos END BETWEEN 0 AND total - (n1 + n2 + n3 + n4 + n5 + n6)),
    {_WALK},
    z AS (SELECT q.fid, q.readno, q.transcript, b.contig, (b.at + r.begin - b.used)::BIGINT AS pos, s.cigar, q.mapq, CASE r.strand WHEN '-' THEN NOT q.strand ELSE q.strand END AS strand, (CASE r.strand WHEN '-' THEN 1 - layout ELSE layout END)::INT AS layout, r.strand AS xs
      FROM r JOIN q USING (rid) JOIN s USING (rid) JOIN b ON b.transcript = r.transcript AND b.used <= r.begin AND r.begin < b.ending
      UNION ALL SELECT fid, readno, q.transcript, q.transcript::VARCHAR, pos, n1 || 'S' || n2 || 'M' || n3 || 'I' || n4 || 'M' || n5 || 'D' || n6 || 'M', mapq, q.strand, layout, coalesce(t.strand, '.')
      FROM q LEFT JOIN t USING (transcript) WHERE NOT mapped OR t.transcript IS NULL),
    k AS (SELECT *, regexp_replace(regexp_replace(cigar, '(^|[A-Z])0[A-Z]', '\\1', 'g'), '(^|[A-Z])0[A-Z]', '\\1', 'g') AS plain FROM z),
    y AS (SELECT *, regexp_extract_all(plain, '[0-9]+') AS a, regexp_extract_all(plain, '[A-Z]') AS o FROM k),
    x AS (SELECT * EXCLUDE (plain, a, o), list_aggregate(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i > 1 AND o[i] = o[i - 1] THEN '+' ELSE '|' || o[i] END || a[i]), 'string_agg', '') AS seen FROM y)
    SELECT * EXCLUDE (seen) FROM x QUALIFY row_number() OVER (PARTITION BY fid, readno, contig, pos, strand, list_transform(string_split(seen, '|'), lambda p: p[1:1] || list_sum(list_transform(string_split(p[2:], '+'), lambda n: try_cast(n AS BIGINT)))) ORDER BY mapq DESC, transcript, cigar) = 1""",
)
def _(v):
    s = lambda n, op: F.concat(F.col(n).cast("string"), F.lit(op))
    cigars = F.concat(*[s(f"n{i}", op) for i, op in enumerate("SMIMDM", 1)])
    reads = v("tx_reads").select("fid", "readno", "transcript", "pos", cigars.alias("cigar"), "mapq", "strand", "layout", "mapped")
    reads = dealt(reads, "fid", "readno", "transcript", "pos")
    return projection.tx2genome(reads, projection.transcript_blocks(v("exon")), xs_tag=True, strict=False).drop("mapped")


@query(
    "cigar_expand",
    f"""WITH {_BLOCKS}, r AS (SELECT fid * 100 + line AS rid, transcript, '+' AS strand, [len, line, score + 1] AS lens, ['M', 'D', 'M'] AS ops, mapq AS begin FROM aln_one JOIN (SELECT DISTINCT transcript, total FROM b) USING (transcript) WHERE mapq + len + line + score + 1 <= total),
    {_WALK} SELECT rid, cigar FROM s""".replace("aln_one", "(SELECT fid, line, min(transcript) AS transcript, min(len) AS len, min(score) AS score, min(mapq) AS mapq FROM aln GROUP BY fid, line)"),
)
def _(v):
    one = v("aln").groupBy("fid", "line").agg(*[F.min(c).alias(c) for c in ("transcript", "len", "score", "mapq")])
    spans = projection.transcript_blocks(v("exon")).select("transcript", cigar.spans(F.col("blocks")).alias("spans"))
    text = F.concat(F.col("len").cast("string"), F.lit("M"), F.col("line").cast("string"), F.lit("D"), (F.col("score") + 1).cast("string"), F.lit("M"))
    joined = one.join(spans, "transcript").select((F.col("fid") * 100 + F.col("line")).alias("rid"), text.alias("cigar"), "mapq", "spans")
    return cigar.placed(joined, "spans", "cigar", "mapq").where("put IS NOT NULL").select("rid", F.col("put.cigar").alias("cigar"))


@query("cigar_condense", "SELECT fid, line, price, CASE WHEN len > 10 THEN '10M' || least(len - 10, line * 2) || 'I' || CASE WHEN len > 10 + line * 2 THEN (len - 10 - line * 2) || 'M' ELSE '' END ELSE len || 'M' END AS condensed FROM aln")
def _(v):
    # A block of ten, a gap of twice the line number, and a block that goes on.
    pair = lambda j, b: F.struct(j.cast("long").alias("jump"), b.cast("long").alias("block"))
    blocks = F.array(pair(F.lit(0), F.lit(10)), pair(F.col("line") * 2, F.lit(1000)))
    units = cigar.parse(F.concat(F.col("len").cast("string"), F.lit("M")))
    return v("aln").select("fid", "line", "price", cigar.render(cigar.condense(blocks, units, F.lit(0))).alias("condensed"))


@query(
    "cigar_substring",
    """SELECT fid, line, price, array_to_string(list_transform(list_filter([(least(len, stop) - greatest(0, start), 'M'), (least(len + line, stop) - greatest(len, start), 'D'), (least(len + line + 9, stop) - greatest(len + line, start), 'M')], lambda p: p[1] > 0), lambda p: p[1] || p[2]), '') AS part
    FROM (SELECT *, score AS start, score + mapq * 5 AS stop FROM aln)""",
)
def _(v):
    units = cigar.parse(F.concat(F.col("len").cast("string"), F.lit("M"), F.col("line").cast("string"), F.lit("D9M")))
    return v("aln").select("fid", "line", "price", cigar.render(cigar.substring(units, F.col("score"), F.col("score") + F.col("mapq") * 5)).alias("part"))


@query(
    "aligned_positions",
    "SELECT fid, line, price, (len + CASE WHEN line = score THEN mapq ELSE 0 END)::BIGINT AS correct, (len + line + mapq)::BIGINT AS top, (len + score + mapq)::BIGINT AS bottom FROM aln",
)
def _(v):
    part = lambda c, op: F.concat(F.col(c).cast("string"), F.lit(op))
    units = cigar.parse(F.concat(part("len", "M"), part("line", "D"), part("score", "I"), part("mapq", "M")))
    return v("aln").select("fid", "line", "price", cigar.aligned_positions(units).alias("x")).select("fid", "line", "price", "x.*")


# --- simulation -----------------------------------------------------------------------------------


def _draw(*key: str) -> str:
    """SQL of ``simulate.uniform``."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def _levels(expressed: float) -> str:
    u = [_draw("1", str(i), "transcript") for i in (1, 2, 3)]
    return f"""x AS (SELECT contig, transcript, strand, sum(stop - start)::BIGINT AS length FROM exon GROUP BY contig, transcript, strand),
    e AS (SELECT *, CASE WHEN {u[2]} < {expressed} THEN exp(1.0 + 0.5 * sqrt(-2 * ln(1 - {u[0]})) * cos(2 * pi() * {u[1]})) ELSE 0.0 END AS level FROM x)"""


@query("sim_expression", f"WITH {_levels(0.8)} SELECT contig, transcript, strand, length, round(level, 6) AS level FROM e")
def _(v):
    return simulate.expression_levels(projection.transcript_lengths(v("exon")), 1.0, 0.5, 0.8).withColumn("level", F.round("level", 6))


@query(
    "sim_cut_fragments",
    f"""WITH {_levels(1.0)}, w AS (SELECT transcript, length, floor(level * 1000000)::BIGINT AS weight FROM e WHERE floor(level * 1000000) > 0),
    l AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY substr(md5(transcript::VARCHAR), 1, 2), transcript ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(weight) OVER () AS total FROM w),
    d AS (SELECT m, floor({_draw("1", "'molecule'", "m")} * t.total::DOUBLE)::BIGINT AS point FROM unnest(range(3000)) AS q(m), (SELECT max(total) AS total FROM l) t),
    k AS (SELECT m, transcript, length FROM d JOIN l ON point >= lo AND point < lo + weight),
    c AS (SELECT m, transcript, length, list_concat([0], list_filter(range(1, length), lambda p: {_draw("1", "'cut'", "m", "p")} < 0.02), [length]) AS e FROM k),
    f AS (SELECT transcript, m, unnest(list_zip(e[:-2], e[2:])) AS z FROM c)
    SELECT transcript, m AS molecule, z[1]::BIGINT AS start, z[2]::BIGINT AS stop FROM f WHERE z[2] - z[1] BETWEEN 30 AND 150""",
)
def _(v):
    levels = simulate.expression_levels(projection.transcript_lengths(v("exon")), 1.0, 0.5)
    return simulate.cut_fragments(levels, 0.02, 30, 150, 3000)


_LENGTH = 30
_SIM_QUAL = "5I+"  # qualities 20, 40 and 10, repeated


@query(
    "sim_reads",
    f"""WITH {_BLOCKS}, {_PLACED}, t AS (SELECT DISTINCT transcript, strand, total FROM b), hh AS (SELECT max(id) + 1 AS n FROM seq),
    fr AS (SELECT transcript, a AS start, a + 90 AS stop, strand FROM t, LATERAL (SELECT unnest(generate_series(0, (total - 90)::BIGINT, 200)) AS a) WHERE total >= 90),
    n AS (SELECT *, ('0x' || substr(md5(concat_ws(':', transcript, start, stop)), 1, 15))::BIGINT AS no FROM fr),
    rd AS (SELECT no, transcript, strand, 0 AS side, start AS begin FROM n UNION ALL SELECT no, transcript, strand, 1, stop - {_LENGTH} FROM n),
    r AS (SELECT no * 2 + side AS rid, no, side, transcript, '+' AS strand, [{_LENGTH}] AS lens, ['M'] AS ops, begin FROM rd),
    {_WALK},
    bases AS (SELECT r.rid, r.no, r.side, j - 1 AS i, coalesce(nullif(substr(sq.s, (b.at - r.transcript * 50 + r.begin + j - 1 - b.used + 1)::BIGINT, 1), ''), '') AS base, substr(repeat('{_SIM_QUAL}', {_LENGTH}), j, 1) AS qual
      FROM r, unnest(range(1, {_LENGTH} + 1)) AS q(j), hh, b, seq sq WHERE b.transcript = r.transcript AND b.used <= r.begin + j - 1 AND r.begin + j - 1 < b.ending AND sq.id = r.transcript % hh.n),
    raw AS (SELECT rid, any_value(no) AS no, any_value(side) AS side, string_agg(base, '' ORDER BY i) AS raw FROM bases GROUP BY rid),
    cal AS (SELECT rid, no, side, raw, p - 1 AS i, substr(raw, p, 1) AS base, substr(repeat('{_SIM_QUAL}', {_LENGTH}), p, 1) AS qual FROM raw, unnest(range(1, {_LENGTH} + 1)) AS q(p) WHERE p <= length(raw)),
    er AS (SELECT *, CASE WHEN {_draw("1", "no", "side", "'error'", "i")} < pow(10, -(ascii(qual) - 33) / 10.0) THEN list_filter(['A', 'C', 'G', 'T'], lambda x: x <> base)[floor({_draw("1", "no", "side", "'base'", "i")} * 3)::INT + 1] ELSE base END AS called FROM cal),
    sq2 AS (SELECT raw.rid, coalesce(string_agg(called, '' ORDER BY i), '') AS seq, count(*) FILTER (called <> base) AS errors FROM raw LEFT JOIN er USING (rid) GROUP BY raw.rid),
    pl AS (SELECT r.rid, r.no, r.side, b.at + r.begin - b.used - r.transcript * 50 AS pos, s.cigar, sq2.seq, sq2.errors, r.transcript % hh.n AS contig FROM r JOIN s USING (rid) JOIN sq2 USING (rid) JOIN hh ON true JOIN b ON b.transcript = r.transcript AND b.used <= r.begin AND r.begin < b.ending),
    pr AS (SELECT l.no, n.strand = '+' AS plus, l.contig, l.pos AS lp, l.cigar AS lc, l.seq AS ls, l.errors AS le, x.pos AS rp, x.cigar AS rc, x.seq AS rs, x.errors AS re FROM pl l JOIN pl x ON l.no = x.no AND l.side = 0 AND x.side = 1 JOIN n ON n.no = l.no),
    nm AS (SELECT *, concat_ws(':', no, CASE WHEN plus THEN 'read1' ELSE 'read2' END, contig, '+', lp + 1, lc, le, CASE WHEN plus THEN 'read2' ELSE 'read1' END, contig, '-', rp + 1, rc, re, 'fragment_size', 90) AS qname FROM pr)
    SELECT qname, 35 + CASE WHEN plus THEN 64 ELSE 128 END AS flag, contig::VARCHAR AS rname, lp::BIGINT AS pos, lc AS cigar, rp::BIGINT AS pnext, 90::BIGINT AS tlen, ls AS seq FROM nm
    UNION ALL SELECT qname, 19 + CASE WHEN plus THEN 128 ELSE 64 END, contig::VARCHAR, rp::BIGINT, rc, lp::BIGINT, -90::BIGINT, rs FROM nm""",
)
def _(v):
    exons = _placed_exons(v)
    fragments = simulate.uniform_fragments(projection.transcript_lengths(exons), 200, 90, 1, 90)
    blocks, chunks = projection.transcript_blocks(exons), _chunks(v)
    q = (_SIM_QUAL * _LENGTH)[:_LENGTH]
    quals = fragments.sparkSession.range(1).select(F.col("id").alias("pair"), F.lit(q).alias("q1"), F.lit(q).alias("q2"))
    return simulate.read_pairs(fragments, blocks, chunks, _LENGTH, quals, width=512).select("qname", "flag", "rname", "pos", "cigar", "pnext", "tlen", "seq")


# --- searches and conservation ---------------------------------------------------------------------

_TEXT = """matrix: m
A C G T
5 2 1 4
0 6 1 1
7 0 2 0
1 1 3 6
2 5 5 0
min_score: 22
total_hits: 2000
cluster_group: m
collection: box
1 TRCAYC
2 TTGGCA
min_score: 0
cluster_group: box
cluster: both
cluster_type: diversity
cluster_window: 200
cluster_min_requirements: 2
cluster_requirement: m 1
cluster_requirement: box 1"""
_RC = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
_BOX = "({w} SIMILAR TO 'T[AG]CA[CT]C' OR {w} = 'TTGGCA')"
_FOUND = f"""m AS (SELECT id, pos, 'm' AS grp, strand, score::BIGINT AS score, 5 AS k FROM (SELECT *, '+' AS strand, {_SCORE.format(w="kmer")} AS score FROM {_KMERS.format(k=5)} UNION ALL SELECT *, '-', {_SCORE.format(w=_RC)} FROM {_KMERS.format(k=5)}) WHERE score >= 22),
    l AS (SELECT score, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM (SELECT score, count(*) AS n FROM m GROUP BY score)),
    box AS (SELECT id, pos, 'box' AS grp, '+' AS strand, 0::BIGINT AS score, 6 AS k FROM {_KMERS.format(k=6)} WHERE {_BOX.format(w="kmer")} UNION ALL SELECT id, pos, 'box', '-', 0, 6 FROM {_KMERS.format(k=6)} WHERE {_BOX.format(w=_RC)}),
    hits AS (SELECT id AS contig, pos::BIGINT AS start, (pos + k)::BIGINT AS stop, grp, grp AS name, strand, score FROM (SELECT m.* FROM m JOIN l USING (score) WHERE above <= 2000 UNION ALL SELECT * FROM box))"""


@query("motif_search", f"WITH {_FOUND} SELECT * FROM hits")
def _(v):
    return querylang.search(v("seq"), _TEXT)[0].drop("id")


@query(
    "motif_clusters",
    f"""WITH {_FOUND}, w AS (SELECT a.contig, a.start FROM hits a JOIN hits b ON a.contig = b.contig AND b.start >= a.start AND b.start <= a.start + 200 GROUP BY a.contig, a.start HAVING count(DISTINCT b.grp) = 2),
    i AS (SELECT h.contig, h.start, h.stop, h.grp, h.strand, min(w.start) AS f, max(w.start) AS t FROM hits h JOIN w ON h.contig = w.contig AND h.start >= w.start AND h.start <= w.start + 200 GROUP BY ALL),
    n AS (SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY contig ORDER BY start, stop, grp, strand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
    c AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start, stop, grp, strand) AS k FROM n)
    SELECT contig, start, stop, min(start) OVER (PARTITION BY contig, k) AS cluster_start, dense_rank() OVER (ORDER BY contig, k) AS cluster FROM c""",
)
def _(v):
    return querylang.search(v("seq"), _TEXT)[1]["both"].drop("id")


@query("index_hits", f"SELECT id, pos::INT AS pos, kmer, strand, score::BIGINT AS score FROM {_HITS} WHERE pos <= (SELECT length(s) FROM seq q WHERE q.id = h.id) - 8".replace(f"FROM {_HITS}", f"FROM {_HITS} h"))
def _(v):
    return motif.index_hits(kmers.index_entries(v("seq"), 8), MATRIX, 20)


_EIGHT = "(SELECT id, p AS pos, substr(s, p + 1, 8) AS kmer FROM seq, LATERAL (SELECT unnest(range(0, length(s) - 8 + 1)) AS p))"


@query("index_nodes", f"SELECT substr(kmer, 1, d::INT) AS node, count(DISTINCT kmer) AS kmers, count(*)::BIGINT AS positions FROM {_EIGHT}, unnest(range(1, 4)) AS t(d) GROUP BY 1")
def _(v):
    return kmers.index_nodes(kmers.index_entries(v("seq"), 8), 3)


@query("index_faults", f"SELECT id, pos::BIGINT AS pos, kmer || '!' AS indexed, kmer AS found FROM {_EIGHT} WHERE (id + pos) % 1000 = 0")
def _(v):
    index = kmers.index_entries(v("seq"), 8)
    spoilt = index.withColumn("kmer", F.when((F.col("id") + F.col("pos")) % 1000 == 0, F.concat("kmer", F.lit("!"))).otherwise(F.col("kmer")))
    return kmers.index_faults(spoilt, v("seq"), 8)


@query("site_paths", "SELECT id, " + " + ".join(f"abs(x{i + 1} - x{i})" for i in range(5)) + " AS total, steps::INT AS steps FROM (SELECT id, (SELECT len(list_distinct([w0, w1, w2, w3, w4, w5])) - 1) AS steps, "
       + ", ".join(f"{_SCORE.format(w=f'w{i}')} AS x{i}" for i in range(6)) + " FROM (SELECT id, " + ", ".join(f"substr(b, 1, {i}) || substr(a, {i + 1}) AS w{i}" for i in range(6))
       + " FROM (SELECT id, translate(substr(md5(id::VARCHAR), 1, 5), '0123456789abcdef', 'ACGTACGTACGTACGT') AS a, translate(substr(md5((id + 1)::VARCHAR), 1, 5), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM reg_b)))")
def _(v):
    word = lambda c: F.translate(F.substring(F.md5(c.cast("string")), 1, 5), "0123456789abcdef", "ACGTACGTACGTACGT")
    paths = v("reg_b").select("id", motif.mutation_path(word(F.col("id")), word(F.col("id") + 1), 5).alias("p"))
    scores = paths.select("id", motif.path_scores(F.col("p"), MATRIX).alias("s"))
    steps = F.size("s") - 1
    return scores.select("id", F.round(motif.path_similarity(F.col("s")) * steps).cast("int").alias("total"), steps.alias("steps"))


@query("interpolated", "SELECT id, round(CASE WHEN w >= 0 AND w < 10 THEN w * 3.0 WHEN w >= 10 AND w < 40 THEN 30 - (w - 10) * 0.5 WHEN w >= 40 AND w <= 60 THEN 15 + (w - 40) * 2.0 ELSE -1 END, 6)::DOUBLE AS y FROM (SELECT id, stop - start AS w FROM reg_b)")
def _(v):
    return v("reg_b").select("id", F.round(cons.interpolate(F.col("stop") - F.col("start"), [(40, 15), (0, 0), (10, 30), (60, 55)], -1.0), 6).alias("y"))


_PLACES = "h AS (SELECT *, start // 2000 AS place, contig * 1000 + start // 2000 AS cluster FROM reg_b), g AS (SELECT DISTINCT place AS ortholog, contig::VARCHAR AS species, cluster AS gene FROM h)"


def _genes(v: View) -> tuple[DataFrame, DataFrame]:
    h = v("reg_b").withColumn("place", F.floor(F.col("start") / 2000)).withColumn("cluster", F.col("contig") * 1000 + F.col("place"))
    return h, h.select(F.col("place").alias("ortholog"), F.col("contig").cast("string").alias("species"), F.col("cluster").alias("gene")).distinct()


def _modules(v: View) -> DataFrame:
    h, genes = _genes(v)
    hits = h.select("id", F.col("grp").alias("name"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"), "start", F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("stop") - F.col("start")).alias("score"))
    return cons.modules(h.select("cluster", "id"), hits, genes.select(F.col("gene").alias("cluster"), "gene", F.lit("HEAD").alias("relation")))


@query("ortholog_pairs", f"WITH {_PLACES} SELECT q.ortholog, q.gene AS query, t.gene AS target, t.species FROM g q JOIN g t USING (ortholog) WHERE q.species = '0' AND t.species <> '0'")
def _(v):
    return cons.ortholog_pairs(_genes(v)[1], "0")


@query(
    "modules",
    f"WITH {_PLACES} SELECT cluster AS gene, cluster, 'HEAD' AS relation, string_agg(start || ':' || grp || ':' || CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END || ':' || (stop - start), ',' ORDER BY start, grp, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END, "
    "translate(substr(md5(id::VARCHAR), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT'), stop - start) AS hits FROM h GROUP BY cluster",
)
def _(v):
    listed = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["start"].cast("string"), x["name"], x["strand"], x["score"].cast("string"))), ",")
    return _modules(v).withColumn("hits", listed)


@query("conservation")
def _(v):
    return cons.conservation(cons.ortholog_pairs(_genes(v)[1], "0"), _modules(v))
