import itertools

import numpy as np
from pyspark.sql import functions as F

from locusframe import api
from locusframe.operators import conservation as c
from locusframe.operators import motif


def hit(start, name, s, strand="+", score=1):
    return {"start": start, "name": name, "s": s, "strand": strand, "score": score}


def test_mapping_finds_the_turned_module():
    q = [hit(10, "a", "ACGTT"), hit(40, "b", "GGGTA")]
    same, _ = c.best_mapping(q, [hit(1010, "a", "ACGTT"), hit(1040, "b", "GGGTA")])
    assert same == 2 + 0.25 + 0.5
    turned, parts = c.best_mapping(q, c._flipped(q))
    assert turned == same and parts["offset"] == 0
    worse, parts = c.best_mapping(q, [hit(1010, "a", "ACGTA"), hit(1140, "b", "GGGTA")])
    assert worse < same and parts["offset"] == 100
    assert c.best_mapping(q, [hit(1, "z", "A")])[0] == 0 and c.best_mapping([], q)[0] == 0


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 5), (5, 3), (6, 6), (4, 7)):
        for _ in range(20):
            w = np.round(rng.normal(0.2, 1, (n, m)), 2)
            got = c.assigned(w)
            assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
            small, large = (w, m) if n <= m else (w.T, n)
            best = max(sum(max(0.0, small[i, p[i]]) for i in range(small.shape[0])) for p in itertools.permutations(range(large), small.shape[0]))
            assert abs(sum(w[a, b] for a, b in got) - best) < 1e-9


def test_all_hits_of_a_large_module_count():
    rng = np.random.default_rng(5)
    q = [hit(int(p), "ab"[i % 2], "".join(rng.choice(list("ACGT"), 8)), score=i) for i, p in enumerate(rng.permutation(4000)[:120])]
    moved = [h | {"start": h["start"] + 500} for h in q]
    score, parts = c.best_mapping(q, moved)
    assert parts == {"similarity": 120.0, "order": 119.0, "orientation": 120.0, "offset": 0.0} and score == 120 + 119 / 4 + 30


def test_conservation_end_to_end(spark):
    hits = spark.createDataFrame([(1, "a", "ACGTT", 10, "+", 5), (2, "b", "GGGTA", 40, "+", 5), (3, "a", "ACGTT", 510, "+", 5), (4, "b", "GGGTA", 540, "+", 5), (5, "a", "TTTTT", 5, "-", 1)], "id long, name string, s string, start long, strand string, score long")
    clusters = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)], "cluster long, id long")
    relations = spark.createDataFrame([(1, "g1", "HEAD"), (2, "g2", "HEAD"), (3, "g3", "TAIL")], "cluster long, gene string, relation string")
    genes = spark.createDataFrame([(1, "x", "g1"), (1, "y", "g2"), (1, "y", "g3")], "ortholog long, species string, gene string")
    scores = c.conservation(c.ortholog_pairs(genes, "x"), c.modules(clusters, hits, relations))
    assert scores.count() == 2
    best = c.best_supports(scores).collect()
    assert [(r.query, r.target) for r in best] == [("g1", "g2")]


def test_interpolate_and_mutations(spark):
    curve = [(10.0, 100.0), (0.0, 0.0), (20.0, 0.0)]
    got = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 10.0, 15.0, 20.0, 21.0)], "v double").withColumn("y", c.interpolate(F.col("v"), curve, -9.0)).collect()
    assert [r.y for r in sorted(got)] == [-9.0, 0.0, 50.0, 100.0, 50.0, 0.0, -9.0]
    paths = spark.createDataFrame([([1, 3, 2],), ([1],)], "s array<int>").select(motif.path_similarity(F.col("s")).alias("p")).collect()
    assert [r.p for r in paths] == [1.5, 0]
    assert spark.range(1).select(motif.mutation_path(F.lit("ACG"), F.lit("TCA"), 3).alias("p")).first().p == ["ACG", "TCG", "TCA"]
    reads = spark.createDataFrame([(1, "c", 100, "ACGT"), (2, "c", 126, "ACGT"), (3, "d", 100, "ACGT")], "id long, contig string, start long, s string")
    mut = spark.createDataFrame([("c", 101, "C", "T"), ("c", 103, "A", "G"), ("c", 129, "T", "A")], "contig string, pos long, original string, mutated string")
    assert {r.id: r.s for r in c.mutated_reads(reads, mut).collect()} == {1: "ATGT", 2: "ACGA", 3: "ACGT"}


def test_api_of_commands(spark):
    iv = spark.createDataFrame([(1, "c", 0, 5), (2, "c", 5, 9), (3, "c", 20, 30)], "id long, contig string, start long, stop long")
    islands, members = api.union_regions(iv)
    assert sorted((r.start, r.stop) for r in islands.collect()) == [(0, 9), (20, 30)] and {r.id: r.union_start for r in members.collect()} == {1: 0, 2: 0, 3: 20}
    reads = iv.select("contig", "start", "stop", F.lit(1).alias("guide"), (F.col("id") == 1).cast("int").alias("correct"), (F.col("id") == 3).cast("int").alias("error"))
    j = api.jumps(reads)
    assert sorted((r.start, r.stop) for r in api.mask(j).collect()) == [(5, 9), (20, 30)]
    assert api.mask(j, 0, 1e9).count() == 0 and sorted((r.start, r.stop) for r in api.mask(j, 1.01, -0.01).collect()) == [(0, 9), (20, 30)]
    assert api.coverage(j, assert_unique=True).count() == 19
    fq = spark.createDataFrame([("a", "AC", "hI"), ("b", "AC", "gB")], "id string, s string, q string")
    assert [r.q for r in api.fastq2fastq(fq, 33).orderBy("id").collect()] == ["I*", "H#"]
    assert tuple(api.fastq_type(fq).first()) == (66, 104, 64)


def test_strata_of_the_documented_examples(spark):
    rows = [(1, s, sp) for s, sp in ((0, "M"), (2, "G"), (3, "T"), (2, "T"), (0, "G"), (2, "M"))]
    df = spark.createDataFrame(rows, "fid long, score long, space string").withColumn("space", F.when(F.col("space") == "M", "T").otherwise(F.col("space")))
    got = {(r.score, r.space): r["rank"] for r in api.strata(df, "TG", larger_better=False).collect()}
    assert sorted(got, key=got.get) == [(0, "T"), (0, "G"), (2, "T"), (2, "G"), (3, "T")]
