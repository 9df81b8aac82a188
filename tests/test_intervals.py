import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import intervals

SCHEMA = "id long, contig int, start long, stop long"


def table(rng, n, longest):
    out = []
    for i in range(n):
        start = rng.randrange(200_000)
        out.append((i, rng.randrange(2), start, start + 1 + int(longest ** rng.random())))
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("touching", [False, True])
def test_overlaps_of_short_and_long_intervals(spark, levels, touching):
    rng = random.Random(levels)
    a, b = table(rng, 150, 30_000), table(rng, 150, 100_000)
    got = intervals.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), touching, levels=levels)
    assert got.columns == [f"{p}_{c}" for p in "ab" for c in ("id", "contig", "start", "stop")]
    extra = int(touching)
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] + extra and y[2] < x[3]}
    pairs = [(r.a_id, r.b_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_islands_across_coarse_bins(spark):
    rng = random.Random(1)
    rows = table(rng, 300, 2000)
    df = spark.createDataFrame(rows, SCHEMA)
    covered = {}
    for _, c, s, e in sorted(rows, key=lambda r: (r[1], r[2])):
        last = covered.setdefault(c, [])
        if last and s <= last[-1][1]:
            last[-1][1] = max(last[-1][1], e)
        else:
            last.append([s, e])
    want = {(c, s, e) for c, x in covered.items() for s, e in x}
    for width in (64, 1 << 14, 1 << 20):
        assert {tuple(r) for r in intervals.islands(df, sweep_bin=width).collect()} == want
        members = intervals.with_island(df, sweep_bin=width).collect()
        assert len(members) == len(rows) and all(any(c == r.contig and s == r.union_start and s <= r.start and r.stop <= e for c, s, e in want) for r in members)


def test_flanks_follow_the_strand(spark):
    df = spark.createDataFrame([(1, "c", 100, 200, "+"), (2, "c", 100, 200, "-"), (3, "c", 5, 990, "+")], "id long, contig string, start long, stop long, strand string")
    got = {r.id: (r.start, r.stop) for r in intervals.flanks(df, 10, 20, spark.createDataFrame([("c", 1000)], "contig string, length long")).collect()}
    assert got == {1: (90, 220), 2: (80, 210), 3: (0, 1000)}


def test_sweeps_like_a_walk_over_positions(spark):
    """Runs, gaps and masks over many small bins, with intervals that cover whole bins and others."""
    rng = random.Random(8)
    rows = table(rng, 200, 5000) + [(900, 0, 1000, 90_000), (901, 1, 0, 64), (902, 1, 64, 128), (903, 1, 128, 129)]
    df = spark.createDataFrame(rows, SCHEMA)
    lengths = spark.createDataFrame([(0, 250_000), (1, 250_000)], "contig int, length long")
    for width in (64, 1 << 12):
        want = set()
        for c in (0, 1):
            covered = bytearray(250_000)
            for _, contig, s, e in rows:
                if contig == c:
                    covered[s:e] = b"\1" * (min(e, 250_000) - s)
            text = bytes(covered)
            at = 0
            while (at := text.find(0, at)) >= 0:
                end = text.find(1, at)
                want.add((c, at, 250_000 if end < 0 else end))
                at = end if end >= 0 else 250_000
        short = df.withColumn("stop", F.least("stop", F.lit(250_000)))
        assert {tuple(r) for r in intervals.gaps(short, lengths, width).collect()} == want
        loci = [(0, x) for x in rng.sample(range(2000), 900)] + [(1, x) for x in range(500)]
        got = {tuple(r) for r in intervals.runs(spark.createDataFrame([*loci, (1, 7)], "k int, at long"), ["k"], "at", F.lit(True), width).collect()}
        seen = set(loci)
        starts = sorted(x for x in seen if (x[0], x[1] - 1) not in seen)
        ends = sorted(x for x in seen if (x[0], x[1] + 1) not in seen)
        assert got == {(a[0], a[1], z[1]) for a, z in zip(starts, ends, strict=True)}


def test_association_by_distance_side_and_orientation(spark):
    q = spark.createDataFrame([(1, "c", 100, 200, "+")], "id long, contig string, start long, stop long, strand string")
    t = spark.createDataFrame(
        [(10, "c", 50, 90, "+"), (11, "c", 80, 95, "-"), (12, "c", 90, 150, "+"), (13, "c", 120, 130, "-"), (14, "c", 210, 220, "+"), (15, "c", 50, 400, "+"), (16, "d", 100, 200, "+")],
        "id long, contig string, start long, stop long, strand string",
    )
    got = {r.t: (r.distance, r.overlap, r.between, r.orientation) for r in intervals.associate(q, t, 20, 9).collect()}
    # The smaller move to adjacency counts: 12 overlaps by 50, 13 ends 30 after the query's start; 15 holds the query.
    assert got == {10: (10, 0, 3, "SAME"), 11: (5, 0, 2, "OPP"), 12: (-50, 50, 0, "SAME"), 13: (-30, 10, 1, "OPP"), 14: (10, 0, 1, "SAME"), 15: (-150, 100, 0, "SAME")}
    assert {r.t for r in intervals.associate(q, t, 20, 2).collect()} == {11, 12, 13, 14, 15}
    assert {r.t for r in intervals.associate(q, t, 20, 9, min_distance=-40).collect()} == {10, 11, 13, 14}
    assert {r.t for r in intervals.associate(q, t, -1, 9).collect()} == {12, 13, 15}
    assert sorted(r.assoc for r in intervals.associate(q, t, 20, 9, first_id=5).collect()) == [5, 6, 7, 8, 9, 10]


def test_annotation_options(spark):
    r = spark.createDataFrame([(1, "c", 11, 20, "+"), (2, "c", 91, 95, "-")], "id long, contig string, start long, stop long, strand string")
    f = spark.createDataFrame([(7, "c", 15, 40)], "id long, contig string, start long, stop long")
    got = intervals.annotate(r, f, "region", one_based=True, strand=True, source="mine").collect()
    assert [tuple(x) for x in got] == [(1, 7, "c", 11, 20, "+", "mine")]
    with pytest.raises(Exception, match="no annotation overlaps region 2"):
        intervals.annotate(r, f, no_orphans=True).collect()
    assert intervals.annotate(r.where("id = 1"), f, no_orphans=True).count() == 1
