import itertools
import random
from collections import defaultdict

import pytest

from locusframe.llm import decontamination, jaccard_join
from locusframe.llm._shingles import shingle_set, words_of
from locusframe.llm.components import components
from locusframe.llm._common import work_dir

from .common import AWKWARD, DATA, awkward, empty, rows


def tuples(text):
    w = words_of(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(docs, percent=80):
    """doc_id -> smallest id reachable over links; every pair with a shingle in common is compared."""
    sets = {i: tuples(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for a, b in {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, docs, hot=jaccard_join.HOT):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df, hot=hot).collect()}
    assert got == brute(docs)


def test_words_are_lowered_in_ascii_only_and_split_at_six_characters():
    assert words_of("AÉ b c\x0bD\x1ce\x85f") == ["aÉ".encode(), "b c".encode(), "d\x1ce\x85f".encode()]
    assert len(shingle_set("a b c")) == 1 and len(shingle_set(" ")) == 0 and len(shingle_set(None)) == 0


def test_driver_documents(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in rows("documents", "/root/testdata/sf0.01")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_copies_of_all_sizes(spark, seed):
    """Edited copies around the threshold, sizes around the edges of bands, shared passages, chains of edits."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    docs = []
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 12, 19, 20, 28, 34, 35, 36, 60, 67, 68, 69, 130, 131, 140, 260, 300, 520, 1030]:
        base = [word() for _ in range(size)]
        docs.append(base)
        for edits in (0, 1, 1, 2, max(1, size // 60), max(1, size // 45), max(1, size // 40)):
            copy = list(base)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(1, 3)
            docs.append(copy)
        docs.append(base + [word() for _ in range(size // 5)])
        docs.append(base + passage + [word() for _ in range(size)])
        step = list(base)
        for _ in range(4):
            step = step[max(1, len(step) // 30) :] + [word() for _ in range(max(1, len(step) // 30))]
            docs.append(step)
    rng.shuffle(docs)
    check(spark, [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)])


@pytest.mark.parametrize("hot", [2, 5, 12])
def test_hot_buckets_lose_no_link(spark, hot):
    """Many texts share passages, some are little else; links between them are found past the hot buckets."""
    rng = random.Random(hot)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (6, 9, 25)]
    docs = []
    for i in range(120):
        base = [word() for _ in range(rng.choice((2, 5, 12, 40, 90)))] + rng.choice(passages) + ([word() for _ in range(rng.randrange(8))] if i % 3 else rng.choice(passages))
        docs.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
        docs.append([*base, word()])
    rng.shuffle(docs)
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], hot)


def test_very_many_short_texts_with_one_shingle_in_common(spark):
    import time

    rng = random.Random(2)
    docs = [(i, f"a{rng.randrange(10**9)} b{i} one two three four five") for i in range(20_000)]
    docs += [(30_000 + i, " ".join(f"l{i}x{j}" for j in range(12)) + " one two three four five") for i in range(3)]
    docs += [(40_000 + i, " ".join(f"l{i}x{j}" for j in range(11)) + " y one two three four five") for i in range(3)]
    began = time.time()
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert time.time() - began < 120 and len(got) == len(docs)
    sets = {i: tuples(t) for i, t in docs if i >= 30_000}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert all(got[i] == i for i in range(20_000)) and {(a, b) for a in sets for b in sets if a < b and got[a] == got[b]} == linked


def test_large_group_of_near_copies_and_a_stray(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(300):
        d = list(base)
        d[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(d)))
    docs.append((900, " ".join([f"b{i}" for i in range(60)] + [f"c{i}" for i in range(70)])))
    check(spark, docs)


def test_similar_groups_awkward_rows(spark):
    got = jaccard_join.similar_groups(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    seen = defaultdict(set)
    for r in got:
        seen[r.doc_id].add((r.n_shingles, r.component_id))
    assert seen[1] == {(0, 1)} and seen[2] == {(0, 2)} and seen[4] == {(11, 4)} and seen[5] == {(11, 4)} and seen[None] == {(11, None)} and seen[6] == {(1, 6)} and seen[8] == {(2, 8)}
    assert jaccard_join.similar_groups(empty(spark)).count() == 0
    kept = jaccard_join.representatives(awkward(spark))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, 10]


def test_rows_that_share_an_id_link_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = [(5, a), (5, b), (7, a), (9, b)]
    got = jaccard_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {5}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, 1000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), work_dir(spark, "cc")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and got[1049] == 500


def test_leaks_awkward_rows(spark):
    items = [(1, "the cat sat on the mat"), (2, "WORD"), (3, None), (4, " "), (5, "ipsum lorem ipsum"), (5, "ipsum lorem ipsum"), (None, "ran away from the big dog"), (6, "not there at all in any text")]
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.n_item, r.n_common) for r in decontamination.leaks(awkward(spark), items).collect()))
    cat = [(4, 1, 2, 2)] * 2 + [(5, 1, 2, 2), (0, 1, 2, 2)]
    dog = [(4, 0, 2, 2)] * 2 + [(5, 0, 2, 2), (0, 0, 2, 2)]
    assert got == sorted(cat + dog + [(6, 2, 1, 1)] + [(8, 5, 1, 1)] * 2)
    blocks = sorted(((r.doc_id or 0, r.item_id or 0, r.n_item, r.n_common) for r in decontamination.leaks(awkward(spark), items, block_chars=20).collect()))
    assert blocks == got
    assert decontamination.leaks(empty(spark), items).count() == 0 and decontamination.leaks(awkward(spark), items.where("false")).count() == 0
    clean = decontamination.clean_documents(awkward(spark), items)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 7, 9, 10]


def test_items_with_one_text_or_passage_in_common(spark):
    """Very many items with one text are one query each; items that share a passage are found by the rest of theirs."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    own = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    items = [(i, f"{shared} {t}") for i, t in enumerate(own)] + [(1000 + i, "one text that is repeated for very many of the items here") for i in range(300)]
    docs = [(1, f"intro {shared} outro"), (2, f"x {shared} {own[4]} y"), (3, "so one text that is repeated for very many of the items here it is"), (4, own[7])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(2, 4), *((3, 1000 + i) for i in range(300))}
    for chars in (50_000_000, 2000):
        got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), table, block_chars=chars).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
    index = decontamination.ItemIndex(items, 5, 80)
    assert [m[0] for m in index.matches(docs[1][1], 80)] == [4] and not list(index.matches(docs[0][1], 80))


def test_clean_rows_stay_beside_leaks_of_the_same_id(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "uno due tre quattro cinque sei")], "item_id long, text string")
    data = [(None, "one two three four five six", 1), (None, "a clean text", 2), (None, None, 3), (7, "so uno due tre quattro cinque sei", 4), (7, "another clean text", 5), (8, "", 6), (8, "", 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, clean long")
    for blocks in ({}, {"block_chars": 20}):
        got = decontamination.clean_documents(docs, items, **blocks)
        assert got.columns == docs.columns and sorted(r.clean for r in got.collect()) == [2, 3, 5, 6, 6]


def test_leaks_at_the_threshold_against_brute_force(spark):
    rng = random.Random(4)
    items = {i: [f"q{i}_{k}" for k in range(n)] for i, n in enumerate([3, 5, 6, 9, 14, 24, 44, 104, 204])}
    docs = []
    for d in range(200):
        words = [f"z{rng.randrange(99)}" for _ in range(rng.randrange(300))]
        i = rng.randrange(len(items))
        part = list(items[i])
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "edit"
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + part + words[at:])))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_common) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    want = set()
    for d, text in docs:
        for i, w in items.items():
            n = min(5, len(w))
            wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            t = text.split()
            common = len(wanted & {tuple(t[k : k + n]) for k in range(len(t) - n + 1)})
            if 100 * common >= 80 * len(wanted):
                want.add((d, i, common))
    assert got == want and want


def test_planted_passages_of_the_driver_are_found(spark):
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    want = {(d["doc_id"], i["item_id"]) for d in rows("documents") for i in rows("benchmark") if " ".join(words_of(i["text"])[k].decode() for k in range(len(words_of(i["text"])))) in " ".join(w.decode() for w in words_of(d["text"]))}
    assert want <= got
