"""Genes, transcripts and their projection onto contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.seq import reverse_complement, wrap
from .intervals import islands, overlap_join
from .records import flattened


def transcript_lengths(exons: DataFrame) -> DataFrame:
    """(contig, transcript, strand, length): sums of exon lengths."""
    return exons.groupBy("contig", "transcript", "strand").agg(F.sum(F.col("stop") - F.col("start")).alias("length"))


def transcript_blocks(exons: DataFrame) -> DataFrame:
    """(contig, transcript, strand, start, length, blocks): exons as (jump, block) pairs from position 0 of the contig.

    Exons of one transcript are few by nature; they are collected sorted.
    """
    sorted_ = exons.groupBy("contig", "transcript", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("e"))
    previous = F.concat(F.array(F.lit(0).cast("long")), F.transform("e", lambda x: x["stop"]))
    blocks = F.zip_with("e", F.slice(previous, 1, F.size("e")), lambda x, p: F.struct((x["start"] - p).alias("jump"), (x["stop"] - x["start"]).alias("block")))
    total = F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return sorted_.select("contig", "transcript", "strand", F.get(F.col("e"), F.lit(0))["start"].alias("start"), total.alias("length"), blocks.alias("blocks"))


def overlapping_exons(exons: DataFrame) -> DataFrame:
    """Exons that begin before an earlier one of their transcript ends."""
    w = Window.partitionBy("transcript").orderBy("start", "stop")
    return exons.withColumn("before", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before > start")


def meta_exons(exons: DataFrame) -> DataFrame:
    """Union of all exons of a contig."""
    return islands(exons)


def gene_bounds(exons: DataFrame) -> DataFrame:
    return exons.groupBy("contig", "gene").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count_distinct("transcript").alias("transcripts"))


def transcript_numbers(exons: DataFrame) -> DataFrame:
    """Place of each transcript in its gene, counted from the last in order of name."""
    w = Window.partitionBy("gene").orderBy(F.desc("transcript"))
    return exons.select("gene", "transcript").distinct().withColumn("number", F.row_number().over(w).cast("long"))


def expanded_positions(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Reads (transcript, pos, reflen) with ``target_pos``: their start on the contig; minus strands mirror."""
    at = F.when(F.col("strand") == "-", F.col("length") - F.col("pos") - F.col("reflen")).otherwise(F.col("pos"))
    joined = reads.join(blocks.select("transcript", "contig", "strand", "length", "blocks"), "transcript")
    inside = (at >= 0) & (at <= F.col("length"))
    return joined.select(*reads.columns, "contig", "strand", F.when(inside, cg.expanded_start(F.col("blocks"), at)).alias("target_pos"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for a row, however often what follows names it (the planner does not merge a generator)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tx2genome(reads: DataFrame, blocks: DataFrame, introns: bool = True, xs_tag: bool = False, keep_unsequenced: bool = False, strict: bool = True) -> DataFrame:
    """Reads on transcripts (fid, transcript, pos, cigar, mapq) put on contigs, those of a fragment at one place merged to the best mapq.

    Gives the columns of ``reads`` with ``contig``, and ``pos`` and ``cigar`` on
    it (gaps between exons as N, or D). On a transcript of the minus strand a
    read is mirrored: its start counts from the other end, its CIGAR is
    reversed, and ``strand`` (minus) and ``layout`` (0 or 1), where there are
    such columns, are turned. Units at the ends without template are trimmed;
    reads that then align no base are dropped. ``xs`` is the transcript's
    strand, or ``.``.

    Records whose ``mapped`` column, where there is one, is false, and names
    that are no transcript, stay as they are, the name as contig. A read that
    leaves its transcript is an error when read, or dropped if not ``strict``.
    Places are equal in contig, pos, strand, mate (``pnext``), space and CIGAR,
    where unsequenced stretches (T) count as gaps unless ``keep_unsequenced``.
    """
    have = set(reads.columns)
    dims = blocks.select(F.col("transcript").alias("__t"), F.col("contig").alias("__contig"), F.col("strand").alias("__strand"), F.col("length").alias("__length"), cg.spans(F.col("blocks")).alias("__spans"))
    joined = reads.join(dims, F.col("transcript") == F.col("__t"), "left")
    there = F.col("__t").isNotNull() & (F.coalesce("mapped", F.lit(False)) if "mapped" in have else F.lit(True))
    same = F.col("__strand") != "-"
    joined = joined.withColumns({"__there": there, "__turned": ~same, "__spans": F.when(there, F.col("__spans"))})
    joined = cg.placed(joined, "__spans", "cigar", "pos", "N" if introns else "D", "__turned", cg.ON_TEMPLATE, "__put")
    if strict:
        error = F.raise_error(F.concat(F.lit("a read leaves transcript "), F.col("transcript").cast("string"))).cast("boolean")
        joined = joined.where(F.when(F.col("__there") & F.col("__put").isNull(), error).otherwise(F.lit(True)))
    else:
        joined = joined.where(~F.col("__there") | F.col("__put").isNotNull())
    joined = joined.where(~F.col("__there") | (F.col("__put.aligned") > 0))
    turned = F.col("__there") & ~same
    put = {
        "pos": F.when(F.col("__there"), F.col("__put.start")).otherwise(F.col("pos")),
        "cigar": F.when(F.col("__there"), F.col("__put.cigar")).otherwise(F.col("cigar")),
        "strand": F.when(turned, ~F.col("strand")).otherwise(F.col("strand")) if "strand" in have else None,
        "layout": F.when(turned, F.lit(1) - F.col("layout")).otherwise(F.col("layout")) if "layout" in have else None,
    }
    contig = F.when(F.col("__there"), F.col("__contig").cast("string")).otherwise(F.col("transcript").cast("string"))
    xs = F.when(F.col("__t").isNull(), ".").when(same, "+").otherwise("-")
    rows = joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in reads.columns], contig.alias("contig"), *([xs.alias("xs")] if xs_tag else []), F.col("__there"))
    columns = [c for c in rows.columns if c != "__there"]
    place = ["fid", "contig", "pos", *[c for c in ("readno", "strand", "pnext", "space") if c in have]]
    best = F.struct((-F.coalesce("mapq", F.lit(-1))).alias("q"), F.col("transcript").alias("t"), F.col("cigar").alias("c"))
    # What was put on a contig has its neighbours merged already.
    seen = F.col("cigar") if keep_unsequenced else F.when(F.col("__there") & ~F.contains("cigar", F.lit("T")), F.col("cigar")).otherwise(cg.comparable(F.col("cigar")))
    # Records of a place are combined before the shuffle.
    kept = _once(rows, "__seen", seen).groupBy(*place, "__seen").agg(F.min_by(F.struct(*columns), best).alias("__row"))
    return kept.select("__row.*")


# --- sequences out of chunks -----------------------------------------------------------

#: Letters of a chunk of a contig.
CHUNK = 4096


def dna_chunks(dna: DataFrame, width: int = CHUNK) -> DataFrame:
    """(contig, chunk, s): contigs (contig, s) cut into chunks of ``width`` letters, so that no row holds a chromosome."""
    return dna.select("contig", F.posexplode(F.regexp_extract_all("s", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("chunk", "s"))


def known_contigs(df: DataFrame, dna: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows on contigs of ``dna``, rows on others)."""
    names = dna.select("contig").distinct()
    return df.join(names, "contig", "left_semi"), df.join(names, "contig", "left_anti")


def _cut_out(regions: DataFrame, chunks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, s): the letters of each region (keys, contig, start, stop); what lies off the contig is cut off.

    Each region meets the chunks that it touches, in an equi-join.
    """
    first, last = F.floor(F.col("start") / width), F.floor((F.greatest(F.col("stop"), F.col("start") + 1) - 1) / width)
    touched = regions.withColumn("__chunk", F.explode(F.sequence(first, last)))
    pieces = chunks.select(F.col("contig").alias("__contig"), F.col("chunk").cast("long").alias("__at"), F.col("s").alias("__s"))
    met = touched.join(pieces, (F.col("contig") == F.col("__contig")) & (F.col("__chunk") == F.col("__at")), "left")
    begin = F.greatest(F.col("start") - F.col("__chunk") * width, F.lit(0))
    end = F.least(F.col("stop") - F.col("__chunk") * width, F.lit(width))
    part = F.coalesce(F.substring(F.col("__s"), (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), F.lit(""))
    parts = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__chunk").alias("at"), part.alias("s")))).alias("__p"))
    return parts.select(*keys, F.array_join(F.transform("__p", lambda x: x["s"]), "").alias("s"))


def transcript_sequences(exons: DataFrame, chunks: DataFrame, line: int = 0, revcomp: bool = True, width: int = CHUNK) -> DataFrame:
    """(transcript, s): exons (transcript, contig, strand, start, stop) out of ``dna_chunks``, joined in order, minus strands reversed."""
    cut = _cut_out(exons.select("transcript", "strand", "contig", "start", "stop"), chunks, ["transcript", "strand", "contig", "start", "stop"], width)
    whole = cut.groupBy("transcript", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "s"))).alias("e"))
    s = F.array_join(F.transform("e", lambda x: x["s"]), "")
    if revcomp:
        s = F.when(F.col("strand") == "-", reverse_complement(s)).otherwise(s)
    return whole.select("transcript", wrap(s, line).alias("s"))


def region_sequences(regions: DataFrame, chunks: DataFrame, longest: int, width: int = CHUNK) -> DataFrame:
    """(id, s) of regions (id, contig, start, stop, strand) up to ``longest`` out of ``dna_chunks``, minus strands reversed; ids are distinct."""
    short = regions.where(F.col("stop") - F.col("start") <= longest)
    cut = _cut_out(short.select("id", "strand", "contig", "start", "stop"), chunks, ["id", "strand"], width)
    return cut.select("id", F.when(F.col("strand") == "-", reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("s"))


def region_lines(sequences: DataFrame) -> DataFrame:
    """Lines (column ``value``) of region ids and sequences, for a text sink."""
    return sequences.select(F.concat_ws("\t", F.col("id").cast("string"), "s").alias("value"))


def sorted_projections(blocks: DataFrame, by_target: bool = True) -> DataFrame:
    """Transcripts in order of (contig, start, transcript, strand), or of (transcript, start, contig, strand)."""
    keys = ["contig", "start", "transcript", "strand"] if by_target else ["transcript", "start", "contig", "strand"]
    return blocks.orderBy(*keys)


def projection_header(blocks: DataFrame, contigs: DataFrame) -> DataFrame:
    """``@SQ`` lines of transcripts in order of their place on the contigs."""
    placed = flattened(blocks, contigs, "start")
    return placed.orderBy("flat", "transcript").select("transcript", "flat", F.concat(F.lit("@SQ\tSN:"), F.col("transcript").cast("string"), F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))


def collapse_introns(exons: DataFrame, pseudo: int = 25) -> DataFrame:
    """Meta exons with their start on a contig whose introns are ``pseudo`` long."""
    merged = islands(exons)
    w = Window.partitionBy("contig").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("stop") - F.col("start")).over(w), F.lit(0)) + F.count(F.lit(1)).over(w) * pseudo
    return merged.select("contig", "start", "stop", before.cast("long").alias("drawn_start"))


def loci_to_genes(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """(id, gene, offset): genes that contain each locus, and where in them."""
    pairs = overlap_join(loci, genes.select(F.col("gene").alias("id"), "contig", "start", "stop"))
    return pairs.where("b_start <= a_start AND a_stop <= b_stop").select(F.col("a_id").alias("id"), F.col("b_id").alias("gene"), (F.col("a_start") - F.col("b_start")).alias("offset"))


def boundary_genes(exons: DataFrame) -> DataFrame:
    """(contig, pos, genes): the genes with an exon that begins or ends at each boundary, sorted."""
    edges = exons.select("contig", "gene", F.explode(F.array("start", "stop")).alias("pos"))
    return edges.groupBy("contig", "pos").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def by_projected_start(reads: DataFrame, blocks: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads on transcripts with ``flat``, their start on the contigs laid end to end; the order of a projected sort."""
    return flattened(expanded_positions(reads, blocks), contigs, "target_pos")
