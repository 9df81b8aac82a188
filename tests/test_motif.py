import random

import pytest
from pyspark.sql import functions as F

from locusframe import querylang
from locusframe.operators import kmers, motif

TEXT = """
# two patterns
species: demo
matrix: m
A C G T
2 0 0 0
0 2 0 0
0 0 2 0
strand: POS_NEG
min_score: 6
cluster_group: a
collection: box
1 TTRC
min_score: 0
strand: POS
cluster: both
cluster_type: diversity
cluster_window: 20
cluster_min_requirements: 2
cluster_requirement: a 1
cluster_requirement: box 1
"""


def test_parse():
    s = querylang.parse(TEXT)
    assert [p.name for p in s.patterns] == ["m", "box"] and s.patterns[0].matrix[1]["C"] == 2 and s.patterns[1].consensus == [("1", "TTRC")]
    assert s.clusters[0].needs == {"a": 1, "box": 1} and s.settings["species"] == "demo"
    assert querylang.parse("matrix: h\nA: 1 2\nC: 3 4\nG: 5 6\nT: 7 8\nstrand: POS").patterns[0].matrix == [{"A": 1, "C": 3, "G": 5, "T": 7}, {"A": 2, "C": 4, "G": 6, "T": 8}]
    with pytest.raises(ValueError, match="line 1"):
        querylang.parse("nonsense: 1")


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(200)) for i in range(4)}
    hits, clusters = querylang.search(spark.createDataFrame(list(seqs.items()), "id long, s string"), TEXT)
    comp = str.maketrans("ACGT", "TGCA")
    want = set()
    for i, s in seqs.items():
        for p in range(198):
            w = s[p : p + 3]
            want |= {(i, p, "+", "m")} if w == "ACG" else set()
            want |= {(i, p, "-", "m")} if w.translate(comp)[::-1] == "ACG" else set()
        want |= {(i, p, "+", "box") for p in range(197) if s[p : p + 2] == "TT" and s[p + 2] in "AG" and s[p + 3] == "C"}
    rows = hits.collect()
    assert {(r.contig, r.start, r.strand, r.name) for r in rows} == want
    members = {(r.contig, r.id) for r in clusters["both"].collect()}
    ordered = sorted(rows, key=lambda r: (r.contig, r.start, r.stop, r.id))
    expect = set()
    for k, r in enumerate(ordered):
        near = [o for o in ordered[k:] if o.contig == r.contig and o.start <= r.start + 20]
        if {o.grp for o in near} >= {"a", "box"}:
            expect |= {(o.contig, o.id) for o in ordered if o.contig == r.contig and r.start <= o.start <= r.start + 20}
    assert members == expect


def test_matrix_helpers():
    wide = motif.expand_matrix([{"A": 5, "C": 2, "G": 1, "T": 4}])[0]
    assert wide["M"] == 2 and wide["N"] == 1 and wide["A"] == 5
    assert motif.reverse_matrix([{"A": 1, "C": 2, "G": 3, "T": 4}, {"A": 5, "C": 6, "G": 7, "T": 8}])[0] == {"T": 5, "G": 6, "C": 7, "A": 8}


def test_ambiguous_letters_and_strands(spark):
    m = [{"A": 5, "C": 2, "G": 1, "T": 4}, {"A": 0, "C": 6, "G": 1, "T": 1}]
    df = spark.createDataFrame([(1, "ANCMC"), (2, "A"), (3, "")], "id int, s string")
    plain = {(r.pos, r.strand): r.score for r in motif.matrix_hits(df, m, -99).collect()}
    assert plain == {}  # every window has a letter that is no base
    wide = {(r.pos, r.strand): r.score for r in motif.matrix_hits(df, m, -99, ambiguous=True).collect()}
    assert wide[(0, "+")] == 5 + 0 and wide[(2, "+")] == 2 + 0 and wide[(3, "+")] == 2 + 6 and len(wide) == 8


def test_windows_across_pieces(spark):
    rng = random.Random(5)
    s = "".join(rng.choice("ACGT") for _ in range(1111))
    df = spark.createDataFrame([(1, s)], "id int, s string")
    for k in (1, 7, 300):
        assert [r.kmer for r in kmers.exploded(df, k).orderBy("pos").collect()] == [s[i : i + k] for i in range(len(s) - k + 1)]
    want = {}
    for i in range(len(s)):
        for d in range(20, 26):
            if i + d + 5 <= len(s):
                pair = s[i : i + 5], s[i + d : i + d + 5]
                want[pair] = want.get(pair, 0) + 1
    got = {r.times: (r.pairs, r.total) for r in kmers.pair_spectrum(df, 5, 20, 26).collect()}
    assert sum(t for _, t in got.values()) == sum(want.values()) and sum(p for p, _ in got.values()) == len(want)


def test_a_written_index_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGTTGCAACGTTA"), (2, "TTTTACGTTG")], "id int, s string")
    spark.sql("DROP TABLE IF EXISTS kmer_index_of_a_test")
    try:
        kmers.write_index(df, 6, "kmer_index_of_a_test", 4)
        index = kmers.read_index(spark, "kmer_index_of_a_test")
        assert kmers.index_faults(index, df, 6).count() == 0
        assert {(r.id, r.pos) for r in kmers.read_index(spark, "kmer_index_of_a_test", F.col("prefix") == "ACGT").collect()} == {(1, 0), (1, 8), (2, 4)}
        m = [{"A": int(b == "A"), "C": int(b == "C"), "G": int(b == "G"), "T": int(b == "T")} for b in "ACG"]
        got = {(r.id, r.pos, r.strand) for r in motif.index_hits(index, m, 3).collect()}
        want = {(i, p, t) for i, s in ((1, "ACGTTGCAACGTTA"), (2, "TTTTACGTTG")) for p in range(len(s) - 5) for t, w in (("+", "ACG"), ("-", "CGT")) if s[p : p + 3] == w}
        assert got == want
    finally:
        spark.sql("DROP TABLE IF EXISTS kmer_index_of_a_test")
