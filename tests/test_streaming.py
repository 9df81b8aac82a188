import pytest
from pyspark.sql import functions as F

from locusframe.streaming import fragments

SCHEMA = "fid long, readno int, at timestamp"


def write(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "fid long, readno int, s long").select("fid", "readno", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    return spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_first_seen_and_whole_fragments(spark, tmp_path):
    batches = [[(1, 0, 10), (1, 1, 11), (2, 0, 12)], [(1, 0, 13), (3, 0, 14), (3, 1, 15)], [(9, 0, 1000)], [(9, 1, 2000)]]
    stream = write(spark, tmp_path, batches)
    drain(fragments.first_seen(stream, "at", "1 minute").select("fid", "readno"), "seen", tmp_path)
    assert sorted(map(tuple, spark.table("seen").collect())) == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (9, 0), (9, 1)]
    drain(fragments.whole_fragments(stream, "at", "1 minute").select("fid", "reads", "orphan"), "whole", tmp_path)
    got = {r.fid: (r.reads, r.orphan) for r in spark.table("whole").collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: (3, False), 2: (1, True), 3: (2, False)}


def test_depth_by_window(spark, tmp_path):
    stream = write(spark, tmp_path, [[(1, 0, 10), (1, 1, 20)], [(1, 0, 70)], [(1, 0, 5000)], [(1, 0, 5001)]])
    drain(fragments.depth_by_window(stream, "at", "1 minute", "1 minute", "fid"), "depth_w", tmp_path)
    assert sorted(r.n for r in spark.table("depth_w").collect()) == [1, 2]


def test_monotone_sink_fails_on_a_late_row(spark):
    seen = []
    sink = fragments.MonotoneSink("id", lambda df, e: seen.append(df.count()))
    sink(spark.range(5, 10), 0)
    sink(spark.range(9, 12), 1)
    with pytest.raises(ValueError):
        sink(spark.range(3, 4), 2)
    assert seen == [5, 3]


def test_monotone_sink_with_policies_and_a_kept_bound(spark, tmp_path):
    seen, late = [], []
    write = lambda df, e: seen.append(sorted(r[0] for r in df.collect()))
    sink = fragments.MonotoneSink("id", write, "drop", store=str(tmp_path / "bounds"))
    sink(spark.range(5, 8), 0)
    sink = fragments.MonotoneSink("id", write, "drop", store=str(tmp_path / "bounds"))  # the driver was lost
    sink(spark.range(6, 10), 1)
    sink(spark.range(6, 10), 1)  # the epoch comes again
    assert seen == [[5, 6, 7], [7, 8, 9], [7, 8, 9]]
    aside = fragments.MonotoneSink("id", write, lambda df, e: late.append(df.count()), store=str(tmp_path / "bounds"))
    aside(spark.range(0, 12), 2)
    assert late == [9] and seen[-1] == [9, 10, 11]
    with pytest.raises(ValueError, match="after everything"):
        fragments.MonotoneSink("id", write, store=str(tmp_path / "bounds"))(spark.range(1), 3)
    with pytest.raises(ValueError, match="within a batch"):
        fragments.MonotoneSink("v", write, sequence="id")(spark.range(5).withColumn("v", 5 - F.col("id")), 0)


def test_pending_mates(spark, tmp_path):
    batches = [[(1, 0, 10), (2, 0, 11), (3, 1, 12)], [(1, 1, 13), (1, 0, 14), (3, 0, 15)], [(9, 0, 1000)], [(9, 1, 2000)], [(8, 0, 2100)]]
    stream = write(spark, tmp_path, batches)
    drain(fragments.pending_mates(stream, "at", "1 minute"), "mates_p", tmp_path)
    second = lambda t: None if t is None else int(t.timestamp())
    got = {(r.fid, r.k): (second(r.first), second(r.second)) for r in spark.table("mates_p").collect()}
    assert {k: v for k, v in got.items() if k[0] < 4} == {(1, 1): (10, 13), (1, 2): (14, None), (2, 1): (11, None), (3, 1): (15, 12)}
    assert len(got) == spark.table("mates_p").count()


def test_sliding_consensus(spark, tmp_path):
    piles = [[(5, "A"), (5, "a"), (5, "C"), (6, "T")], [(6, "G"), (6, "G"), (9, "C")], [(500, "A")], [(900, "A")], [(901, "A")]]
    for i, rows in enumerate(piles):
        spark.createDataFrame([("c", p, b) for p, b in rows], "contig string, pos long, base string").coalesce(1).write.parquet(str(tmp_path / f"p/b={i}"))
    stream = spark.readStream.schema("contig string, pos long, base string, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    drain(fragments.sliding_consensus(stream, 50), "consensus_p", tmp_path)
    got = {r.pos: (r.depth, r.base, r.score) for r in spark.table("consensus_p").collect()}
    assert {p: got[p] for p in (5, 6, 9)} == {5: (3, "A", 1), 6: (3, "G", 1), 9: (1, "C", 1)}
