import hashlib
import re

import pytest

from locusframe.llm import exact_dedup, mixing
from locusframe.llm._common import work_dir

from .common import AWKWARD, awkward, empty


def index(spark):
    return exact_dedup.DigestIndex(spark, work_dir(spark, "test-index"), 4)


def test_dedup_awkward_rows(spark):
    got = exact_dedup.dedup(awkward(spark), index(spark)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].keep_id for i in (1, 2, 3)} == {3} and by_id[3].group_size == 3  # null, empty and white are equal; the longest stays
    assert by_id[5].keep_id == 5 and by_id[5].group_size == 4 and by_id[None].keep_id == 5 and not by_id[None].kept
    assert by_id[4].keep_id == 5 and by_id[6].kept and by_id[9].kept
    assert by_id[6].text_sha256 == hashlib.sha256(b"word").hexdigest()


def test_dedup_ties_and_empty(spark):
    df = spark.createDataFrame([(3, "a b"), (2, "b a"), (9, "a\tb"), (1, "ab"), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.dedup(df, index(spark)).collect()}
    assert got == {3: 3, 9: 3, 1: 3, None: 3, 2: 2}
    assert exact_dedup.dedup(empty(spark), index(spark)).count() == 0


def test_index_keeps_earlier_batches(spark):
    ix = index(spark)
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "a  b  "), (4, "d"), (5, "d ")], "doc_id long, text string")
    exact_dedup.dedup(one, ix).collect()
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.dedup(two, ix).collect()}
    assert got == {3: (1, False, 2), 4: (5, False, 2), 5: (5, True, 2)}
    assert ix.table().where("named").count() == 3 and ix.table().count() == 4  # the text that came again has a row for its count
    again = exact_dedup.DigestIndex(spark, ix.path, 4)
    small = ix.compact(work_dir(spark, "compact"))
    assert again.table().count() == 4 and sorted((r.keep_id, r.seen) for r in small.table().collect()) == [(1, 2), (2, 1), (5, 2)]
    third = spark.createDataFrame([(7, "ab"), (8, "e")], "doc_id long, text string")
    for which in (ix, small):
        assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.dedup(third, which).collect()} == {7: (1, False, 3), 8: (8, True, 1)}
    plan = again.missing(two.selectExpr("sha2(text, 256) AS digest"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the bucketed side is not shuffled


def test_a_batch_run_again_gives_the_same(spark):
    ix = index(spark)
    one = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "ab"), (4, "d"), (None, "e")], "doc_id long, text string")
    result = lambda df: sorted(map(str, exact_dedup.dedup(df, ix).collect()))
    first, second = result(one), result(two)
    count = ix.table().count()
    assert result(two) == second and ix.table().count() == count  # the driver was lost after appending
    # Lost half way: part of the batch's rows are not there.
    half = exact_dedup.DigestIndex(spark, work_dir(spark, "half-index"), 4)
    half.append(ix.table().where("batch IN (SELECT batch FROM VALUES (0L) AS t(batch)) OR keep_id IS NULL OR keep_id < 4"))
    got = sorted(map(str, exact_dedup.dedup(two, half).collect()))
    assert got == second and half.table().count() == count
    # An earlier batch run again names the same documents, and counts the later one too.
    assert [s.replace("group_size=2", "group_size=1") for s in result(one) if "doc_id=1" in s] == [s for s in first if "doc_id=1" in s]
    half.drop()
    assert not spark.catalog.tableExists(half.name)


def test_dedup_leaves_no_index_behind(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.query(spark, str(tmp_path)).count() == len(AWKWARD)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_deduplicated_keeps_columns(spark):
    df = awkward(spark)
    kept = exact_dedup.deduplicated(df, index(spark))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8, 9, 10]


def brute_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        out = {s: cap * sizes[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 1, None: 400}, {"a": 1}, {"a": 0, "b": 10}, {"b": 7, "a": 7, "c": 7, "d": 7000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes, (1, 2, 3), 3))


def test_mix_awkward_rows(spark):
    got = mixing.mix(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    for r, (i, text, *_rest) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.size)), sorted(AWKWARD, key=lambda r: (r[0] or 0, len(r[1] or ""))), strict=True):
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r.taken <= 3 * r.size
    assert mixing.mix(empty(spark)).count() == 0
    twins = {r.taken for r in got if r.doc_id == 4}
    assert len(twins) == 1
    only_white = spark.createDataFrame([(1, " ", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(only_white).collect()} == {(0.0, 0)}


def test_mix_comes_near_its_targets_and_is_nested(spark):
    docs = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 4}" if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for s in {r.source for r in got}:
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 50
        order = sorted(rows, key=lambda r: r.h)
        copies = [r.copies for r in order]
        assert copies == sorted(copies, reverse=True)  # a threshold on the hash
    assert sorted(got) == sorted(mixing.mix(df.repartition(7)).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_mixed_keeps_repeated_rows_and_clashing_columns(spark):
    df = awkward(spark)
    copies = sum(r.copies for r in mixing.mix(df).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == copies
