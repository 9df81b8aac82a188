"""FASTA, FASTQ, qseq and GTF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import shift_quality
from .lines import lines_with_offsets, numbered_lines


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, s): one row per sequence, its lines joined; the name ends at the first white space."""
    records = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    text = F.regexp_replace("value", "^>", "")
    return records.select(
        F.regexp_extract(text, r"^([^\s]*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"[\r\n]", "").alias("s")
    )


def sequence_header(fasta: DataFrame) -> DataFrame:
    """``@SQ`` lines with the length of each sequence."""
    return fasta.select("name", F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.length("s").cast("string")).alias("value"))


def linear_fasta(fasta: DataFrame) -> DataFrame:
    """Two lines a sequence, as one value."""
    return fasta.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("s")).alias("value"))


def in_contig_order(fasta: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sequences with their contig's ordinal; a sequence that is no contig, or of another length, is an error when read."""
    joined = fasta.join(contigs.withColumnRenamed("contig", "name"), "name", "left")
    good = F.col("ord").isNotNull() & (F.length("s") == F.col("length"))
    return joined.select("name", F.when(good, F.col("ord")).otherwise(F.raise_error(F.concat(F.lit("no such contig: "), F.col("name"))).cast("int")).alias("ord"), "s")


def fasta_index(spark: SparkSession, path: str, species: str) -> DataFrame:
    """(species, contig, start, stop, path): the bytes that each sequence's letters take in its file, behind its header line."""
    lines = lines_with_offsets(spark, path)
    heads = lines.where(F.col("value").startswith(">")).select("file", "start", F.col("stop").alias("begin"), F.regexp_extract("value", r"^>([^\s]*)", 1).alias("contig"))
    ends = lines.groupBy("file").agg(F.max("stop").alias("end"))
    # One row for each sequence.
    following = F.lead("start").over(Window.partitionBy("file").orderBy("start"))
    return heads.withColumn("next", following).join(ends, "file").select(F.lit(species).alias("species"), "contig", F.col("begin").alias("start"), F.coalesce("next", "end").alias("stop"), F.col("file").alias("path"))


def write_contigs(fasta: DataFrame, contigs: DataFrame, path: str) -> None:
    """The sequences as a binary (Parquet) table in the order of the contigs; see ``in_contig_order``."""
    in_contig_order(fasta, contigs).repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(path)


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """Reads (id, s, q) as FASTQ text."""
    fastq_lines(reads).select("value").write.option("compression", compression).text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec_no, id, s, q): four lines a record; an incomplete last record is dropped."""
    lines = numbered_lines(spark, path).withColumn("rec_no", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4)
    pick = lambda i: F.max(F.when(F.col("part") == i, F.col("value")))
    records = lines.groupBy("file", "rec_no").agg(F.count(F.lit(1)).alias("n"), pick(0).alias("id"), pick(1).alias("s"), pick(3).alias("q")).where("n = 4")
    return records.select("file", "rec_no", F.regexp_replace("id", "^@", "").alias("id"), "s", "q")


def fastq_lines(reads: DataFrame) -> DataFrame:
    """Records as one value of four lines; the third is a bare plus."""
    others = [c for c in reads.columns if c not in ("id", "s", "q")]
    return reads.select(*others, F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("s"), F.lit("\n+\n"), F.col("q")).alias("value"))


def read_qseq(spark: SparkSession, path: str, keep_quality: bool = True) -> DataFrame:
    """(id, s, q) of qseq lines; qualities as they are, or lowered by 31."""
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    q = get(9) if keep_quality else shift_quality(get(9), -31)
    name = F.concat(F.concat_ws(":", get(0), get(2), get(3), get(4), get(5)), F.lit("/"), get(7))
    return spark.read.text(path).select(name.alias("id"), F.replace(get(8), F.lit("."), F.lit("N")).alias("s"), q.alias("q"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with half-open bounds, ``gene`` and ``transcript``; comment lines are left out, a ``.`` score is -1."""
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    name = lambda k: F.nullif(F.regexp_extract(get(8), rf'{k} "([^"]*)"', 1), F.lit(""))
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("#") & (F.trim("value") != ""))
        .select(
            get(0).alias("contig"), get(1).alias("origin"), get(2).alias("feature"), (get(3).cast("long") - 1).alias("start"), get(4).cast("long").alias("stop"),
            F.when(get(5) == ".", -1.0).otherwise(get(5).try_cast("double")).alias("score"), get(6).alias("strand"), get(7).alias("frame"),
            name("gene_id").alias("gene"), name("transcript_id").alias("transcript"),
        )
    )


def exons_of(gtf: DataFrame) -> DataFrame:
    """Exons (transcript, contig, strand, gene, start, stop)."""
    return gtf.where("feature = 'exon'").select("transcript", "contig", "strand", "gene", "start", "stop")


def dna_table(fasta: DataFrame, species: str) -> DataFrame:
    """(species, contig, length, s): the dimension that region operators join."""
    return fasta.select(F.lit(species).alias("species"), F.col("name").alias("contig"), F.length("s").cast("long").alias("length"), "s")
