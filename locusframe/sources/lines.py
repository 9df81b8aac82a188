"""Text files as numbered lines and as fixed-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import strand_name
from ..plans.scan import ranked


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines with their file, the byte at which their split begins, and an order within it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered from 0 within their file; no task sees a whole file."""
    lines = read_lines(spark, path)
    numbered = ranked(lines, [F.col("file"), F.col("block")], ["at"], "n")
    first = numbered.groupBy("file").agg(F.min("n").alias("first"))
    return numbered.join(first, "file").select("file", (F.col("n") - F.col("first")).alias("line"), "value")


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, stop, value): lines (without the line feed) with the bytes of the file that they take; no task sees a whole file.

    Lengths are summed within a split and over the splits before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", (F.octet_length("value") + 1).cast("long").alias("size")
    )
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("size"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("size").over(upto(Window.partitionBy("file").orderBy("block"))), F.lit(0)).alias("before"))
    inside = lines.withColumn("within", F.coalesce(F.sum("size").over(upto(Window.partitionBy("file", "block").orderBy("at"))), F.lit(0)))
    start = F.col("before") + F.col("within")
    return inside.join(blocks, ["file", "block"]).select("file", start.alias("start"), (start + F.col("size")).alias("stop"), "value")


def line_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, chunk, start, stop, lines): stretches of whole lines of about ``size`` bytes; a chunk has the lines that start in its stretch."""
    lines = lines_with_offsets(spark, path).withColumn("chunk", F.floor(F.col("start") / size))
    return lines.groupBy("file", "chunk").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("lines"))


def chunk_lines(spark: SparkSession, path: str, size: int, chunk: int) -> DataFrame:
    """(file, start, value): the lines of one chunk of ``line_chunks``."""
    return lines_with_offsets(spark, path).where(F.floor(F.col("start") / size) == chunk).select("file", "start", "value")


def line_groups(spark: SparkSession, path: str, n: int, first: int = 0) -> DataFrame:
    """(file, group, lines): every ``n`` lines from line ``first`` on, as one array; plain or compressed text."""
    lines = numbered_lines(spark, path).where(F.col("line") >= first).withColumn("group", F.floor((F.col("line") - first) / n))
    listed = lines.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l"))
    return listed.select("file", "group", F.transform("l", lambda x: x["value"]).alias("lines"))


def read_regions(spark: SparkSession, path: str, lengths: DataFrame, five: int = 0, three: int = 0, grouped: bool = False) -> DataFrame:
    """Regions (id, [group_id,] species, contig, start, stop, strand) of a region table, bounds in order, with flanks, clipped to their contig.

    ``lengths`` has (contig, length); regions on other contigs are left out (see ``known_contigs``).
    """
    from ..operators.intervals import flanks

    rows = read_named(spark, path, "grouped_region" if grouped else "region")
    bounds = rows.withColumns({"start": F.least("start", "stop"), "stop": F.greatest("start", "stop")})
    plain = bounds.withColumn("strand", strand_name(F.col("strand"))).drop("_corrupt")
    signed = plain.withColumn("__name", F.col("strand")).withColumn("strand", F.when(F.col("strand") == "NEG", "-").otherwise("+"))
    return flanks(signed, five, three, lengths).withColumn("strand", F.col("__name")).select(*plain.columns)


def read_table(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    """A tab-separated table without header; rows that do not fit the schema have nulls and ``_corrupt``."""
    fields = spark.createDataFrame([], schema).schema
    return (
        spark.read.schema(fields.add("_corrupt", "string"))
        .option("sep", "\t").option("comment", comment).option("quote", "").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE")
        .csv(path)
    )


# Columns of the small tables.
SCHEMAS = {
    "jumps": "contig string, pos long, guide long, correct long, error long",
    "expression": "transcript string, contig string, strand string, length long, level double",
    "mutations": "species string, contig string, pos long, original string, mutated string",
    "union_regions": "id long, contig string, start long, stop long",
    "locus_values": "chrom string, locus long, value double",
    "depth": "chrom string, locus long, depth int",
    "pileup": "contig string, pos long, consensus string, depth int, bases string",
    "region": "id long, species string, contig string, start long, stop long, strand string",
    "grouped_region": "id long, group_id long, species string, contig string, start long, stop long, strand string",
    "dna_index": "species string, contig string, start long, stop long, path string",
    "hits": "hit_id long, name string, variant string, sequence string, score int, start long, stop long, contig string, species string, strand string",
    "calibration": "top int, second int, given int, mapq int",
}


def read_named(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_table(spark, path, SCHEMAS[kind])


def read_calibration(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(score tag, table) of a calibration file, whose first line names the tag."""
    tag = spark.read.text(path).where("value LIKE 'score_tag:%'").select(F.trim(F.split("value", ":")[1])).first()[0]
    rows = spark.read.text(path).where("value NOT LIKE 'score_tag:%' AND trim(value) != ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return tag, rows.select(*[F.get("f", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("top", "second", "given", "mapq"))])


def read_contig_spaces(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(preference of spaces, table of contig and space)."""
    lines = numbered_lines(spark, path).where("value NOT LIKE '#%' AND trim(value) != ''").orderBy("line")
    preference = lines.first()["value"].strip()
    return preference, lines.where(F.instr("value", "\t") > 0).select(F.split("value", "\t")[0].alias("contig"), F.split("value", "\t")[1].alias("space"))


def write_gzip(df: DataFrame, path: str) -> None:
    """Lines (column ``value``) as gzip text, one member per part, compressed in parallel."""
    df.select("value").write.option("compression", "gzip").text(path)


def tail(path: str, size: int) -> str:
    """The whole lines within the last ``size`` bytes of a local file."""
    with open(path, "rb") as f:
        end = f.seek(0, 2)
        f.seek(max(0, end - size))
        data = f.read()
    if end > size:
        data = data.partition(b"\n")[2]
    return data.decode()
