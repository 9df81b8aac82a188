import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import projection, records, simulate, stats


def test_orders(spark):
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(9):02d}", rng.choice("ab"), rng.randrange(50), rng.choice("ab"), rng.randrange(50), i) for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:5]], "fid string, contig string, pos long, guide_contig string, guide_pos long, n int")
    contigs = records.contig_table(spark.createDataFrame([("a", 1, 100), ("b", 2, 100)], "contig string, ord int, length long"))
    place = {"a": 0, "b": 100}
    keys = {"ALIGN": lambda r: place[r.contig] + r.pos, "GUIDE": lambda r: place[r.guide_contig] + r.guide_pos}
    keys["MIN_ALIGN_GUIDE"] = lambda r: min(keys["ALIGN"](r), keys["GUIDE"](r))
    for order, key in keys.items():
        got = records.sort_alignments(df, order, contigs, ["n"]).collect()
        assert len(got) == 65 and [(key(r), r.fid, r.n) for r in got] == sorted((key(r), r.fid, r.n) for r in got) and all(r.flat == key(r) for r in got)
        assert records.sort_alignments(df, order, contigs, ["n"], unique=True).count() == 60
        ranks = sorted(records.rank_alignments(df, order, contigs, ["n"]).collect(), key=lambda r: r["rank"])
        assert [(r.flat, r.fid, r.n) for r in ranks] == [(r.flat, r.fid, r.n) for r in got]
    names = spark.createDataFrame([("b", 1, 2, 3, 4), ("a", 2, 1, 1, 1), ("a", 1, 9, 9, 9)], "flowcell string, lane int, tile int, x int, y int")
    assert [tuple(r) for r in records.sort_alignments(names, "FRAGMENT").collect()] == [("a", 1, 9, 9, 9), ("a", 2, 1, 1, 1), ("b", 1, 2, 3, 4)]
    with pytest.raises(ValueError, match="no order"):
        records.sort_alignments(df, "SIDEWAYS")
    with pytest.raises(Exception, match="unknown contig"):
        records.sort_alignments(df.withColumn("contig", F.lit("z")), "ALIGN", contigs).collect()


def test_comparators(spark):
    rows = [(1, False, "5M2T3M", 9, "T", 7, True, True), (1, False, "5M2N3M", 9, "T", 8, False, True), (1, True, "5M", 0, "T", 7, False, False)]
    df = spark.createDataFrame(rows, "flat int, strand boolean, cigar string, mate_flat int, space string, fid int, first boolean, mapped boolean")
    groups = {n: df.groupBy(*records.comparator(n)).count().count() for n in records._COMPARATORS}
    assert groups == {"position": 2, "fragment_position": 2, "read": 3, "read_and_position": 3, "position_and_read": 3, "fragment": 2, "fragment_and_position": 3}


def test_order_violations_across_bins(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(100)) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "i long, g int, v int")
    for group in ([], ["g"]):
        last, want = {}, set()
        for i, g, v in sorted(rows):
            k = g if group else 0
            if k in last and last[k] > v:
                want.add((i, last[k]))
            last[k] = v
        assert {(r.i, r.previous) for r in records.order_violations(df, "i", "v", group, 64).collect()} == want
    plan = records.order_violations(df, "i", "v")._jdf.queryExecution().executedPlan().toString()
    assert "single" not in plan.lower() or "hashpartitioning" in plan


def test_mates(spark):
    def row(n, first, pos, pnext, strand=False, next_strand=True, fid=1, multi=True, unmapped=False, mapped=True, contig="c"):
        return (n, fid, multi, first, unmapped, mapped, pos, pnext, strand, next_strand, contig)

    rows = [
        row(1, True, 10, 50), row(2, False, 50, 10, True, False),  # a pair
        row(3, True, 10, 50), row(4, False, 50, 10, True, True),  # strands that do not fit
        row(5, True, 60, 60), row(6, False, 60, 60, True, False), row(7, False, 60, 60, True, False),  # at one place, a second mate too many
        row(8, True, 0, 0, unmapped=True, mapped=False), row(9, False, 0, 0, unmapped=True, mapped=False),  # both unmapped
        row(10, True, 10, 50, fid=2, multi=False), row(11, False, 50, 10, True, False, fid=2, multi=False),  # no pairs
        row(12, True, 10, 50, fid=3), row(13, False, 50, 10, True, False, fid=3, contig="d"),  # on different contigs
        row(14, True, 90, 20, True, False, fid=4), row(15, False, 20, 90, False, True, fid=4),  # the second read lies left
    ]
    df = spark.createDataFrame(rows, "n int, fid int, multi boolean, first boolean, unmapped boolean, mapped boolean, pos int, pnext int, strand boolean, next_strand boolean, next_contig string")
    got = records.mate_pairs(df, ["n"]).collect()
    pairs = {(r.first.n, r.second.n): r.left_is_first for r in got if r.first and r.second}
    assert pairs == {(1, 2): True, (5, 6): True, (8, 9): True, (14, 15): False}
    assert {(r.first or r.second).n for r in got if not (r.first and r.second)} == {3, 4, 7, 10, 11, 12, 13}


def test_extracted_reads_are_as_sequenced(spark):
    df = spark.createDataFrame([(1, 0, 1, "AACG", "abcd", False), (1, 1, 2, "AACG", "abcd", True), (2, 1, 3, "GGT", "xyz", True), (1, 0, 4, "TTTT", "zzzz", False)], "fid int, readno int, n int, seq string, qual string, strand boolean")
    got = {k: [(r.fid, r.seq, r.qual) for r in v.collect()] for k, v in records.extract_reads(df, ["n"]).items()}
    assert got == {"first": [(1, "AACG", "abcd")], "second": [(1, "CGTT", "dcba")], "orphans": [(2, "ACC", "zyx")]}


def test_tx2genome_against_a_map_of_bases(spark):
    """Every aligned base of a read lies where the transcript's base does, on both strands."""
    rng = random.Random(3)
    exons, place = [], {}
    for t in range(6):
        at, strand, bases = 100 * t, "+-"[t % 2], []
        for _ in range(4):
            at += rng.randint(5, 30)
            n = rng.randint(3, 20)
            exons.append((t, "c", strand, at, at + n))
            bases += range(at, at + n)
            at += n
        place[t] = bases
    reads = []
    for i in range(200):
        t = rng.randrange(6)
        n, m = rng.randint(1, 12), rng.randint(1, 12)
        pos = rng.randrange(max(1, len(place[t]) - n - m - 2))
        reads.append((i, t, pos, f"{n}M2D{m}M", 5, False, True))
    df = spark.createDataFrame([*reads, (900, 1, 3, "4M", 0, False, False), (901, 77, 3, "4M", 0, False, True)], "fid int, transcript int, pos long, cigar string, mapq int, strand boolean, mapped boolean")
    blocks = projection.transcript_blocks(spark.createDataFrame(exons, "transcript int, contig string, strand string, start long, stop long"))
    got = {r.fid: r for r in projection.tx2genome(df, blocks, xs_tag=True, strict=False).collect()}
    assert (got[900].contig, got[900].pos, got[900].xs) == ("1", 3, "-") and (got[901].contig, got[901].xs) == ("77", ".")
    for i, t, pos, cigar, *_ in reads:
        n, m = (int(x[:-1]) for x in cigar.replace("2D", " ").split())
        if pos + n + 2 + m > len(place[t]):
            assert i not in got
            continue
        on_read = [*range(pos, pos + n), *range(pos + n + 2, pos + n + 2 + m)]
        minus = t % 2 == 1
        want = sorted(place[t][len(place[t]) - 1 - p] if minus else place[t][p] for p in on_read)
        at, have = got[i].pos, []
        import re

        for k, op in re.findall("([0-9]+)([MDN])", got[i].cigar):
            have += range(at, at + int(k)) if op == "M" else []
            at += int(k)
        assert have == want and got[i].strand == minus and got[i].xs == "+-"[minus]
    with pytest.raises(Exception, match="a read leaves transcript"):
        projection.tx2genome(df.where("fid = 1").withColumn("pos", F.lit(10_000).cast("long")), blocks).collect()
    same = spark.createDataFrame([(1, 0, 0, "2M3T2M", 3), (1, 0, 0, "2M3N2M", 9), (1, 0, 0, "2M3T2M", 9)], "fid int, transcript int, pos long, cigar string, mapq int")
    merged = projection.tx2genome(same, projection.transcript_blocks(spark.createDataFrame([(0, "c", "+", 10, 90)], "transcript int, contig string, strand string, start long, stop long")))
    assert [(r.pos, r.cigar, r.mapq) for r in merged.collect()] == [(10, "2M3N2M", 9)]


def test_simulated_reads_against_the_contig(spark):
    rng = random.Random(6)
    dna = "".join(rng.choice("ACGT") for _ in range(3000))
    exons = [(1, "c", "+", 100, 140), (1, "c", "+", 200, 300), (1, "c", "+", 700, 760), (2, "c", "-", 1000, 1150)]
    ex = spark.createDataFrame(exons, "transcript int, contig string, strand string, start long, stop long")
    blocks = projection.transcript_blocks(ex)
    chunks = projection.dna_chunks(spark.createDataFrame([("c", dna)], "contig string, s string"), 64)
    frags = spark.createDataFrame([(t, s, s + n) for t, total in ((1, 200), (2, 150)) for n in (40, 90) for s in range(0, total - n, 17)], "transcript int, start long, stop long")
    mut = spark.createDataFrame([("c", 120, dna[120], "ACGT"["TACG".index(dna[120])]), ("c", 205, "Z", "A")], "contig string, pos long, original string, mutated string")
    changed = dna[:120] + "ACGT"["TACG".index(dna[120])] + dna[121:]
    place = {1: [*range(100, 140), *range(200, 300), *range(700, 760)], 2: [*range(1000, 1150)]}
    rows = simulate.read_pairs(frags, blocks, chunks, 36, mutations=mut, width=64).collect()
    assert len(rows) == 2 * frags.count()
    spelled = {t: "".join(changed[p] for p in at) for t, at in place.items()}
    by_name = {}
    for r in rows:
        by_name.setdefault(r.qname, []).append(r)
    want = sorted((spelled[f.transcript][f.start : f.start + 36], spelled[f.transcript][f.stop - 36 : f.stop]) for f in frags.collect())
    have = []
    for left, right in by_name.values():
        left, right = (left, right) if left.tlen > 0 else (right, left)
        have.append((left.seq, right.seq))
        assert left.pnext == right.pos and right.pnext == left.pos and left.tlen == -right.tlen and left.qual == "~" * 36
        plus = left.pos < 900
        assert (left.flag, right.flag) == ((99, 147) if plus else (163, 83))
    assert sorted(have) == want
    quals = simulate.quality_pairs(*[spark.createDataFrame([(0, "5" * 36), (1, "!" * 36), (2, "+" * 36)], "rec_no long, q string")] * 2, 10)
    assert sorted((r.pair, r.q1[0]) for r in quals.collect()) == [(0, "5"), (1, "+")]
    noisy = {r.qname.split(":")[0] + str(r.tlen > 0): r for r in simulate.read_pairs(frags, blocks, chunks, 36, quals, mut, width=64).collect()}
    clean = {r.qname.split(":")[0] + str(r.tlen > 0): r for r in rows}
    wrong = 0
    for k, r in noisy.items():
        told = r.qname.split(":")
        n = sum(a != b for a, b in zip(r.seq, clean[k].seq, strict=True))
        assert n == int(told[6 if r.tlen > 0 else 12])
        wrong += n
    assert 0 < wrong < 36 * len(noisy) * 0.15


def test_windowed_mode_and_quantiles_like_sorted_lists(spark):
    rng = random.Random(9)
    rows = [(g, v) for g, n in (("a", 60), ("b", 7), ("c", 3), ("d", 40)) for v in ([rng.randrange(500) for _ in range(n)] if g != "d" else [5] * 20 + list(range(20)))]
    df = spark.createDataFrame(rows, "g string, v long")

    def mode(x, w):
        x, n = sorted(x), len(x)
        gap = [x[i + w] - x[i] for i in range(n - w)]
        d = [1 / k if k else float("inf") for k in gap]
        d += [d[-1]] * w
        dens = [d[0], *[d[i] + d[max(0, i - w)] for i in range(1, n)]]
        return x[dens.index(max(dens))]

    for pieces in (4, 128):
        got = {r.g: r.mode for r in stats.windowed_mode(df, "v", 5, ["g"], pieces).collect()}
        assert got == {g: mode([v for h, v in rows if h == g], 5) for g in "abd"}
        quart = {(r.g, r.quantile): r.value for r in stats.quantiles(df, "v", [0.0, 0.3, 1.0], ["g"], pieces).collect()}
        for g in "abcd":
            x = sorted(v for h, v in rows if h == g)
            for q in (0.0, 0.3, 1.0):
                at = q * (len(x) - 1)
                lo, hi = x[int(at)], x[min(len(x) - 1, int(at) + (at > int(at)))]
                assert abs(quart[g, q] - (lo + (hi - lo) * (at - int(at)))) < 1e-9
