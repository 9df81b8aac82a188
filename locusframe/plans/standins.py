"""Alignments, regions, depths, exons, sequences and reads read out of the driver's tables.

Each view is one SQL text for Spark and DuckDB alike; ``//`` stands for integer
division, which Spark spells ``div``. Whole tables and whole texts are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .scan import dealt

VIEWS = {
    # Alignments: a fragment has two reads; the input order is the full row.
    "aln": """
        SELECT l_orderkey AS fid, CAST(l_linenumber % 2 AS INT) AS readno, 'c' || CAST(l_suppkey % 7 AS VARCHAR(9)) AS contig,
               l_partkey * 10 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS len, l_returnflag = 'R' AS strand,
               CAST(round(l_discount * 100) AS BIGINT) AS score, CASE l_linestatus WHEN 'O' THEN 'T' ELSE 'G' END AS space,
               CAST(round(l_tax * 100) AS BIGINT) AS mapq, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
               l_partkey AS transcript
        FROM lineitem""",
    "reg_a": """
        SELECT o_orderkey AS id, CAST(o_custkey % 7 AS INT) AS contig,
               (o_orderkey * 7919 + CAST(floor(o_totalprice) AS BIGINT)) % 200000 AS start,
               (o_orderkey * 7919 + CAST(floor(o_totalprice) AS BIGINT)) % 200000 + 1 + o_custkey % 50 AS stop, o_orderstatus AS strand
        FROM orders""",
    "reg_b": """
        SELECT event_id AS id, CAST(user_id % 7 AS INT) AS contig,
               (event_id * 7919 + CAST(floor(value * 100) AS BIGINT)) % 200000 AS start,
               (event_id * 7919 + CAST(floor(value * 100) AS BIGINT)) % 200000 + 1 + user_id % 80 AS stop, event_type AS grp
        FROM events""",
    # Exons: the widest of each slot of a transcript; slots are disjoint.
    "exon": """
        SELECT l_partkey AS transcript, 'c' || CAST(l_partkey % 5 AS VARCHAR(9)) AS contig,
               CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey // 4 AS gene,
               l_partkey * 50 + CAST(l_linenumber AS BIGINT) * 100 AS start,
               l_partkey * 50 + CAST(l_linenumber AS BIGINT) * 100 + max(CAST(l_quantity AS BIGINT)) AS stop
        FROM lineitem GROUP BY l_partkey, l_linenumber""",
    # The letters A, C, G and T of every document; a document may have none.
    "seq": """
        SELECT doc_id AS id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS s
        FROM documents""",
    # Regions on documents as contigs; what lies off a document is cut off.
    "place": """
        SELECT o_orderkey AS id, o_orderkey % n.n AS contig, (o_orderkey * 7919) % 700 AS start, (o_orderkey * 7919) % 700 + 1 + o_custkey % 60 AS stop,
               CASE o_orderstatus WHEN 'F' THEN '-' ELSE '+' END AS strand
        FROM orders CROSS JOIN (SELECT max(doc_id) + 1 AS n FROM documents) n""",
    # Reads on transcripts; one in fifty is on no transcript.
    "tx_reads": """
        SELECT l_orderkey AS fid, CAST(l_linenumber % 2 AS INT) AS readno, CASE WHEN CAST(round(l_extendedprice * 100) AS BIGINT) % 50 = 0 THEN -1 ELSE l_partkey END AS transcript,
               CAST(round(l_extendedprice * 100) AS BIGINT) % 150 AS pos, CAST(l_linenumber % 3 AS BIGINT) AS n1, 5 + CAST(l_quantity AS BIGINT) % 30 AS n2, CAST(round(l_discount * 100) AS BIGINT) % 4 AS n3,
               3 + CAST(round(l_tax * 100) AS BIGINT) AS n4, CAST(l_linenumber % 5 AS BIGINT) AS n5, CAST(8 AS BIGINT) AS n6, CAST(round(l_tax * 100) AS BIGINT) AS mapq,
               l_returnflag = 'R' AS strand, CAST(l_linenumber % 2 AS INT) AS layout, l_discount > 0.005 AS mapped
        FROM lineitem""",
    # Records of pairs that point to each other; a fifth of the mates are missing.
    "pair_rows": """
        SELECT (l_orderkey * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) * 2 + side AS ord, l_orderkey % 500 AS fid, l_tax < 0.075 AS multi, (l_linenumber + side) % 2 = 0 AS first,
               l_tax < 0.005 AS unmapped, l_tax > 0.015 AS mapped, CASE side WHEN 0 THEN p ELSE q END AS pos, CASE side WHEN 0 THEN q ELSE p END AS pnext,
               CASE side WHEN 0 THEN s ELSE t END AS strand, CASE side WHEN 0 THEN t ELSE s END AS next_strand, 'c' || CAST(l_suppkey % 2 AS VARCHAR(9)) AS next_contig
        FROM (SELECT *, l_partkey % 40 * 10 AS p, l_partkey % 40 * 10 + CAST(l_quantity AS BIGINT) % 5 * 10 AS q, l_returnflag = 'R' AS s, l_linestatus = 'O' AS t FROM lineitem) l
        CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) m WHERE side = 0 OR CAST(round(l_discount * 100) AS BIGINT) % 5 <> 0""",
    "mates": """
        SELECT conv_id AS fid, CAST(turn % 2 AS INT) AS readno, turn AS input_seq, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s
        FROM conversations""",
    "names": """
        SELECT o_orderkey AS id, CASE o_orderkey % 3
          WHEN 0 THEN 'FC' || CAST(o_custkey % 9 AS VARCHAR(9)) || ':' || CAST(o_orderkey % 8 AS VARCHAR(9)) || ':' || CAST(o_custkey AS VARCHAR(20)) || ':' || CAST(o_orderkey AS VARCHAR(20)) || ':7#0/1'
          WHEN 1 THEN 'INST:' || CAST(o_custkey % 5 AS VARCHAR(9)) || ':FC' || CAST(o_custkey % 9 AS VARCHAR(9)) || ':' || CAST(o_orderkey % 8 AS VARCHAR(9)) || ':' || CAST(o_custkey AS VARCHAR(20)) || ':' || CAST(o_orderkey AS VARCHAR(20)) || ':9 1:N:0'
          ELSE CAST(o_orderkey AS VARCHAR(20)) END AS name
        FROM orders""",
    # Event counts in ten-minute slots, with empty slots.
    "depth": """
        SELECT k.chrom, l.locus, coalesce(d.depth, 0) AS depth
        FROM (SELECT DISTINCT event_type AS chrom FROM events) k
        CROSS JOIN (SELECT unnest(generate_series(a, b)) AS locus FROM (SELECT min(epoch_s(ts) // 600) AS a, max(epoch_s(ts) // 600) AS b FROM events) e) l
        LEFT JOIN (SELECT event_type AS chrom, epoch_s(ts) // 600 AS locus, count(*) AS depth FROM events GROUP BY 1, 2) d
          ON k.chrom = d.chrom AND l.locus = d.locus""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def for_spark(sql: str) -> str:
    sql = re.sub(r"epoch_s\((\w+)\)", r"unix_seconds(CAST(\1 AS TIMESTAMP))", sql)
    sql = sql.replace("//", "div").replace("unnest(generate_series(a, b))", "explode(sequence(a, b))").replace(", 'g')", ")")
    return re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", sql)


def for_duckdb(sql: str) -> str:
    return re.sub(r"epoch_s\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of ``sf_dir``."""
    sql = for_spark(VIEWS[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "seq":
        # Texts make much work each: they are dealt out before the first of it.
        tables["documents"] = dealt(tables["documents"].select("doc_id", "text"), "doc_id")
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that ``sql`` names before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({for_duckdb(VIEWS[n])})" for n in used)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
