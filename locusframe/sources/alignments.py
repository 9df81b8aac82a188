"""SAM text: headers, records, tags, fragments, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.readname import FLAGS, pack_flags
from ..functions.seq import reverse_complement
from .lines import read_lines

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
#: Line breaks of the tag list: TAG:TYPE:VALUE.
_TAG = r"^([A-Za-z][A-Za-z0-9]):([AifZHB]):(.*)$"


def header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines in order."""
    return read_lines(spark, path).where(F.col("value").startswith("@")).select("file", "block", "at", "value")


def contigs(head: DataFrame) -> DataFrame:
    """(contig, ord, length) of ``@SQ`` lines in order, and the contig ``*`` last; one row per contig."""
    sq = head.where(F.col("value").rlike(r"^@SQ\tSN:[^\t]+\tLN:[0-9]+"))
    order = Window.orderBy("file", "block", "at")
    named = sq.select(F.regexp_extract("value", r"SN:([^\t]+)", 1).alias("contig"), F.row_number().over(order).alias("ord"), F.regexp_extract("value", r"LN:([0-9]+)", 1).cast("long").alias("length"))
    last = named.agg(F.lit("*").alias("contig"), (F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"), F.lit(0).cast("long").alias("length"))
    return named.union(last)


def parse(lines: DataFrame) -> DataFrame:
    """Records of lines (column ``value`` and whatever else): the eleven fields, zero-based positions, ``tags`` by name.

    A mapped position is lowered by one, an absent CIGAR becomes ``nS``; lines
    with fewer than eleven fields have ``_corrupt`` set and nulls elsewhere.
    """
    f = F.split("value", "\t")
    ok = F.size(f) >= len(FIELDS)
    get = lambda i: F.when(ok, F.get(f, F.lit(i)))
    flag = get(1).cast("int")
    mapped = flag.bitwiseAND(F.lit(FLAGS["unmapped"])) == 0
    next_mapped = flag.bitwiseAND(F.lit(FLAGS["next_unmapped"])) == 0
    tags = F.filter(F.slice(f, len(FIELDS) + 1, F.greatest(F.size(f) - len(FIELDS), F.lit(0))), lambda t: t.rlike(_TAG))
    entries = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, _TAG, 1).alias("key"), F.struct(F.regexp_extract(t, _TAG, 2).alias("type"), F.regexp_extract(t, _TAG, 3).alias("value")).alias("value")))
    others = [c for c in lines.columns if c != "value"]
    pos, pnext = get(3).cast("long"), get(7).cast("long")
    return lines.where(~F.col("value").startswith("@")).select(
        *others,
        get(0).alias("qname"), flag.alias("flag"), get(2).alias("rname"),
        F.when(mapped, pos - 1).otherwise(pos).alias("pos"), get(4).cast("int").alias("mapq"),
        F.when(get(5) == "*", F.concat(F.length(get(9)).cast("string"), F.lit("S"))).otherwise(get(5)).alias("cigar"),
        get(6).alias("rnext"), F.when(next_mapped, pnext - 1).otherwise(pnext).alias("pnext"), get(8).cast("int").alias("tlen"),
        get(9).alias("seq"), get(10).alias("qual"), F.when(ok, F.map_from_entries(entries)).alias("tags"), F.when(~ok, F.col("value")).alias("_corrupt"),
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Records with their input order (file, block, at)."""
    return parse(read_lines(spark, path))


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))["value"]


def with_tag(df: DataFrame, name: str, kind: str, value: Column) -> DataFrame:
    """``df`` with the tag added or replaced."""
    one = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    rest = F.map_filter(F.coalesce("tags", F.expr("cast(map() as map<string,struct<type:string,value:string>>)")), lambda k, _: k != name)
    return df.withColumn("tags", F.map_concat(rest, one))


def render(df: DataFrame) -> DataFrame:
    """Lines (column ``value``) of records, one-based again; tags in order of name."""
    mapped = F.col("flag").bitwiseAND(F.lit(FLAGS["unmapped"])) == 0
    next_mapped = F.col("flag").bitwiseAND(F.lit(FLAGS["next_unmapped"])) == 0
    columns = {"pos": F.when(mapped, F.col("pos") + 1).otherwise(F.col("pos")), "pnext": F.when(next_mapped, F.col("pnext") + 1).otherwise(F.col("pnext"))}
    fields = [columns.get(c, F.col(c)).cast("string") for c in FIELDS]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat_ws(":", t["key"], t["value"]["type"], t["value"]["value"]))
    others = [c for c in df.columns if c not in (*FIELDS, "tags", "_corrupt")]
    return df.select(*others, F.concat_ws("\t", *fields, F.when(F.size(tags) > 0, F.array_join(tags, "\t"))).alias("value"))


def fragments(df: DataFrame) -> DataFrame:
    """One row per fragment: mates of a reference joined into one CIGAR with the gap between them as a signed ``T``.

    Needs ``fid``, ``rname``, ``pos``, ``cigar``, ``reflen`` and ``flag`` of the primary records.
    """
    first = F.col("flag").bitwiseAND(F.lit(FLAGS["first"])) != 0
    grouped = df.groupBy("fid", "rname").agg(F.sort_array(F.collect_list(F.struct("pos", "reflen", "cigar", first.alias("first")))).alias("r"), F.min("mapq").alias("mapq"))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    gap = b["pos"] - (a["pos"] + a["reflen"])
    joined = F.when(b.isNull(), a["cigar"]).otherwise(F.concat(a["cigar"], gap.cast("string"), F.lit("T"), b["cigar"]))
    return grouped.select("fid", "rname", a["pos"].alias("pos"), "mapq", joined.alias("cigar"), a["first"].alias("left_is_first"), F.size("r").alias("reads"))


def split_fragments(df: DataFrame, layout: str = "fr") -> DataFrame:
    """Records of the reads of fragments: the inverse of ``fragments``.

    ``df`` has fid, rname, pos, mapq, cigar (mates around a signed ``T``, or one
    read), ``left_is_first``, ``mapped`` and ``reads``, an array of (seq, qual) as
    sequenced, first read first. ``layout`` tells how each read lies on the
    fragment (f or r). Reads on the minus strand are turned; ``tlen`` is positive
    for the left read. Of an unmapped fragment places are 0 and CIGARs ``*``.
    """
    units = cg.parse(F.col("cigar"))
    split = df.withColumn("__u", units).withColumn("__t", F.array_position(F.transform("__u", lambda u: u["op"]), "T").cast("int"))
    left = F.when(F.col("__t") > 0, F.slice("__u", 1, F.greatest(F.col("__t") - 1, F.lit(0)))).otherwise(F.col("__u"))
    right = F.when(F.col("__t") > 0, F.slice("__u", F.greatest(F.col("__t") + 1, F.lit(1)), F.size("__u")))
    split = split.withColumn("__l", left).withColumn("__r", right).withColumn("__paired", F.size("reads") > 1)
    next_pos = F.col("pos") + cg.reference_length(F.col("__l")) + F.get("__u", F.col("__t") - 1)["len"]
    split = split.withColumn("__next", next_pos).withColumn("__span", F.col("__next") + cg.reference_length(F.col("__r")) - F.col("pos"))
    forward = F.col("left_is_first")

    def record(is_left: bool) -> Column:
        first = forward if is_left else ~forward
        own_layout = lambda is_first: F.when(is_first, layout[0] == "f").otherwise(layout[1] == "f")
        plus = lambda is_first: own_layout(is_first) == forward
        read = F.get("reads", F.when(first, 0).otherwise(1))
        minus, next_minus = ~plus(first), ~plus(~first)
        flag = pack_flags(
            multi_fragment=F.col("__paired"), all_mapped=F.col("mapped"), unmapped=~F.col("mapped"), next_unmapped=F.col("__paired") & ~F.col("mapped"),
            reverse=minus, next_reverse=F.col("__paired") & next_minus, first=F.col("__paired") & first, last=F.col("__paired") & ~first,
        )
        at, other = (F.col("pos"), F.col("__next")) if is_left else (F.col("__next"), F.col("pos"))
        sign = 1 if is_left else -1
        return F.struct(
            F.col("fid").cast("string").alias("qname"), flag.alias("flag"), "rname", F.when(F.col("mapped"), at).otherwise(0).alias("pos"), "mapq",
            F.when(F.col("mapped"), cg.render(cg.trim(F.col("__l" if is_left else "__r"), cg.ON_TEMPLATE))).otherwise("*").alias("cigar"),
            F.when(F.col("__paired"), "=").otherwise("*").alias("rnext"), F.when(F.col("mapped") & F.col("__paired"), other).otherwise(0).alias("pnext"),
            F.when(F.col("mapped") & F.col("__paired"), F.col("__span") * sign).otherwise(0).cast("int").alias("tlen"),
            F.when(minus, reverse_complement(read["seq"])).otherwise(read["seq"]).alias("seq"), F.when(minus, F.reverse(read["qual"])).otherwise(read["qual"]).alias("qual"),
        )

    rows = F.when(F.col("__paired"), F.array(record(True), record(False))).otherwise(F.array(record(True)))
    return split.select(F.explode(rows).alias("x")).select("x.*")


def write_alignments(df: DataFrame, path: str) -> None:
    """Records as SAM text, see ``render``."""
    render(df if "tags" in df.columns else df.withColumn("tags", F.expr("cast(map() as map<string,struct<type:string,value:string>>)"))).select("value").write.text(path)
