"""Queries on tables whose keys, or rows at one place, are many more than in the test data, against the SQL."""

import math
import os
import random
import shutil
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from locusframe.functions import cigar
from locusframe.operators import conservation, intervals, kmers, motif, records, stats
from locusframe.plans import catalog, standins

from .compare import DATA, TABLES, assert_same

#: Keys, and by how much they are shifted for each copy of a table.
KEYS = {
    "orders": {"o_orderkey": 1500, "o_custkey": 150},
    "lineitem": {"l_orderkey": 1500, "l_partkey": 30_000, "l_suppkey": 10},
    "events": {"event_id": 1000, "user_id": 15},
    "documents": {"doc_id": 1000},
}


def grown(folder, copies, **more):
    """The test data with some tables repeated under shifted keys."""
    con = duckdb.connect()
    for t in TABLES:
        if t in copies:
            keys = ", ".join(f"({c} + k * {n})::BIGINT AS {c}" for c, n in KEYS[t].items())
            con.execute(f"COPY (SELECT s.* REPLACE ({keys}) FROM '{DATA}/{t}.parquet' s, range({copies[t]}) r(k)) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{DATA}/{t}.parquet", os.path.join(folder, f"{t}.parquet"))
    return str(folder)


def check(spark, name, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], con=con)


def most_rows_of_a_join(df):
    """The most rows that one join of an executed plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    most, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Transcripts that start beyond a million."""
    return grown(tmp_path_factory.mktemp("far"), {"lineitem": 2})


def test_loci_beyond_a_million(spark, far):
    check(spark, "loci_to_genes", far)


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """Many regions at each place."""
    return grown(tmp_path_factory.mktemp("dense"), {"orders": 4, "events": 10})


def test_smoothing_makes_a_pair_of_places_once(spark):
    """Rows of one place are combined: the pairs grow with the places, not with the square of the rows."""
    rows = [(1, float(x), float(x + (i * x) % 7)) for x in range(0, 40, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "c int, x double, y double").repartition(3)
    got = stats.smooth_sd(df, "x", "y", 6.0, ["c"])
    found = got.collect()
    assert len(found) == len(rows) and sum(r.x == 10.0 for r in found) == 50
    near = [(math.exp(-0.5 * ((x - 10) / 6) ** 2), y - x) for _, x, y in rows if abs(x - 10) <= 6]
    sw, sw2, swv, swv2 = (sum(f(w, v) for w, v in near) for f in (lambda w, v: w, lambda w, v: w * w, lambda w, v: w * v, lambda w, v: w * v * v))
    row = next(r for r in found if r.x == 10.0)
    assert row.n == len(near) and abs(row.sd - math.sqrt(sw / (sw * sw - sw2) * (swv2 - swv * swv / sw))) < 1e-9
    assert most_rows_of_a_join(got) <= len({r[1] for r in rows}) ** 2


def test_smoothing_at_crowded_places(spark, dense):
    check(spark, "smoothing_wsd", dense)


def test_texts_are_dealt_out(spark):
    """A file of texts that is one split is work for all cores."""
    assert standins.view(spark, DATA, "seq").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_index_is_read_once_for_hits(spark):
    plan = catalog.QUERIES["index_hits"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    wide = [{"A": 1, "C": 0, "G": 0, "T": 0}] * 9
    index = kmers.index_entries(spark.createDataFrame([(1, "CAAAAAAAAAAAACTTTTTTTTTT")], "id int, s string"), 9)
    few, many = (sorted(map(tuple, motif.index_hits(index, wide, 8, most=m).collect())) for m in (1 << 16, 2))
    assert few == many and len(few) == 9


def test_scans_of_any_letters(spark):
    """Windows, numbers and pairs of texts with letters that are no bases, lower case and beyond ASCII, across pieces."""
    rng = random.Random(7)
    texts = {1: "".join(rng.choice("ACGTNacgt") for _ in range(700)), 2: "".join(rng.choice("ACGTé€") for _ in range(300)), 3: "", 4: "ACG"}
    df = spark.createDataFrame(list(texts.items()), "id int, s string")
    want = {(i, p): s[p : p + 6] for i, s in texts.items() for p in range(len(s) - 5)}
    value = lambda w: sum("ACGT".find(c.upper()) * 4 ** (5 - j) for j, c in enumerate(w) if c.upper() in "ACGT")
    assert {(r.id, r.pos): r.packed for r in kmers.packed(df, 6).collect()} == {at: value(w) for at, w in want.items()}
    assert {(r.id, r.pos): r.kmer for r in kmers.exploded(df, 6).collect()} == want
    hits = {(r.id, r.pos): r.kmer for r in motif.consensus_hits(df, ["TRCAYC"], 3).collect()}
    assert hits == {at: w for at, w in want.items() if sum(c not in a for c, a in zip(w, ("T", "AG", "C", "A", "CT", "C"), strict=True)) <= 3}
    pairs = Counter((s[i : i + 2], s[i + d : i + d + 2]) for s in texts.values() for d in (3, 4) for i in range(len(s) - d - 1))
    times = Counter(min(n, 100) for n in pairs.values())
    got = {r.times: (r.pairs, r.total) for r in kmers.pair_spectrum(df, 2, 3, 5).collect()}
    assert got == {t: (n, sum(x for x in pairs.values() if min(x, 100) == t)) for t, n in times.items()}


def test_placed_like_the_column_walk(spark):
    """Strings put through spans in batches, against the lambdas: forwards, backwards, turned, empty units, off the end."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        blocks = [(rng.randrange(4), rng.choice([0, 1, 3, 9])) for _ in range(rng.randrange(1, 6))]
        text = "".join(f"{rng.choice([-3, -1, 0, 1, 2, 5, 8]) if i % 3 == 0 else rng.randrange(6)}{rng.choice('MIDNST')}" for _ in range(rng.randrange(6)))
        rows.append((i, blocks, text, rng.randrange(12), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "i int, b array<struct<jump:bigint,block:bigint>>, c string, start long, turn boolean").withColumn("spans", cigar.spans(F.col("b")))
    put = cigar.placed(df.drop("b"), "spans", "c", "start", "D", "turn", cigar.ON_TEMPLATE)
    got = {r.i: r.put for r in put.collect()}
    u = cigar.parse(F.col("c"))
    length = F.element_at("spans", -1)["stop"]
    start = F.when(F.col("turn"), length - cigar.reference_length(u) - F.col("start")).otherwise(F.col("start"))
    x = df.select("i", cigar.expand_spans(F.col("spans"), F.when(F.col("turn"), F.reverse(u)).otherwise(u), start, "D").alias("x"))
    trimmed = cigar.trim(F.col("x.units"), cigar.ON_TEMPLATE)
    want = {r.i: r for r in x.select("i", "x.start", cigar.render(trimmed).alias("cigar"), cigar.aligned_length(trimmed).alias("aligned"), F.col("x").isNull().alias("off")).collect()}
    assert sum(r.off for r in want.values()) > 20 and sum(not r.off for r in want.values()) > 60
    for i, r in want.items():
        assert (got[i] is None) == r.off and (r.off or tuple(got[i]) == (r.start, r.cigar, r.aligned)), rows[i]


def test_plain_cigars_are_compared_as_they_are(spark):
    texts = ["5M3T2T4N6M", "3M2N5M", "3M0I2M", "03M", "3T5M", "*", "", "4M4M", "1M2N3N", "2S10M", "5M-2N1M"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    full = cigar.render(cigar.consolidate(cigar.parse(F.translate(F.col("c"), "T", "N"))))
    assert all(a == b for a, b in df.select(cigar.comparable(F.col("c")), full).collect())
    assert df.where(F.translate("c", "T", "N").rlike(cigar._PLAIN)).count() == 3


def test_keys_of_both_tables_meet_once(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "k int")
    got = records.reconcile(left, right, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "first"), (None, "first"), (3, "second"), (None, "second")], key=str)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_weights_of_a_table_and_of_a_pair(spark):
    rng = random.Random(2)
    make = lambda n: [{"start": rng.randrange(500), "name": "a", "s": "".join(rng.choice("ACGT") for _ in range(rng.randrange(9))), "strand": rng.choice("+-")} for _ in range(n)]
    q, t = make(30), make(40)
    table = conservation._weights(q, t, 12.3, 100.0)
    assert all(table[i, j] == conservation._pair(x, y, 12.3, 100.0)[0] for i, x in enumerate(q) for j, y in enumerate(t))
    plan = catalog.QUERIES["conservation"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # a few pairs are not one task


def test_association_among_crowds(spark, dense):
    check(spark, "associate_regions", dense)


@pytest.mark.parametrize(("reach", "between", "least"), [(100, 2, -30), (0, 5, None), (-3, 1, None), (5000, 40, -10)])
def test_association_like_all_pairs(spark, reach, between, least):
    """Short and long queries and targets, empty ones too, in many cells."""
    rng = random.Random(reach)
    make = lambda n: [(i, rng.randrange(2), s := rng.randrange(-3000, 20_000), s + rng.choice([0, 1, 7, 30, 400]), rng.choice("+-")) for i in range(n)]
    q, t = make(60), [*make(300), (900, 0, -100, 15_000, "+")]
    columns = "id long, contig int, start long, stop long, strand string"
    df = intervals.associate(spark.createDataFrame(q, columns), spark.createDataFrame(t, columns), reach, between, least)
    r, rows = max(0, reach), []
    for i, c, a, z, s in sorted(q, key=lambda x: (x[1], x[2], x[0])):
        near = [(b, j, y, d) for j, k, b, y, _ in t if k == c and b <= z + r and a <= y + r and (d := a - y if abs(a - y) < abs(b - z) else b - z) <= r]
        nearer = lambda side, d: len({x[3] for x in near if side(x) and x[3] < d})  # noqa: B023, E731
        for b, j, y, d in sorted(near):
            n = nearer(lambda x: z > x[2], d) if z > y else nearer(lambda x: a < x[0], d) if a < b else 0  # noqa: B023
            if n <= between and d <= reach and (least is None or d >= least):
                rows.append((i, j, d, max(0, min(z, y) - max(a, b)), "SAME" if s == next(x[4] for x in t if x[0] == j) else "OPP", n, len(rows)))
    assert rows and df.columns == ["q", "t", "distance", "overlap", "orientation", "between", "assoc"]
    assert sorted(map(tuple, df.collect()), key=lambda x: x[6]) == rows


def test_windows_and_clusters_at_crowded_places(spark, dense):
    check(spark, "diversity_windows", dense)
    check(spark, "cluster_members", dense)


def test_starts_meet_once_in_windows(spark):
    """A thousand hits at each of ten starts make no more pairs than the starts."""
    rows = [(0, x * 1000 + i, x * 3, x * 3 + 5, "ab"[i % 2]) for x in range(10) for i in range(1000)]
    hits = spark.createDataFrame(rows, "contig int, id long, start long, stop long, grp string")
    windows = motif.diversity_windows(hits, 20, {"a": 600, "b": 600}, 2)
    assert {(r.id // 1000) for r in windows.collect()} == set(range(9))
    assert most_rows_of_a_join(windows) <= 3 * len(rows)


def test_hits_of_a_search_are_found_once_for_their_clusters(spark):
    plan = catalog.QUERIES["motif_clusters"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "documents.parquet" not in plan


def test_association_of_queries_that_share_an_id(spark):
    """Nearer distances count over all rows of an id."""
    columns = "id long, contig int, start long, stop long"
    q = spark.createDataFrame([(1, 0, 100, 110), (1, 0, 300, 310)], columns)
    t = spark.createDataFrame([(5, 0, 115, 120), (6, 0, 312, 330)], columns)
    got = {(r.q, r.t): r["between"] for r in intervals.associate(q, t, 20, 5).collect()}
    assert got == {(1, 6): 0, (1, 5): 1}
