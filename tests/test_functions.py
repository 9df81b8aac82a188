import random

from pyspark.sql import functions as F

from locusframe.functions import readname, seq
from locusframe.sources import lines


def test_two_bit_round_trip(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1, 6, 20, 31) for _ in range(5)]
    df = spark.createDataFrame([(w, len(w)) for w in words], "s string, n int")
    for n in (1, 6, 20, 31):
        got = df.where(F.col("n") == n).select("s", seq.from_two_bit(seq.two_bit(F.col("s")), n).alias("back")).collect()
        assert got and all(r.s == r.back for r in got)


def test_packed_keys_order_and_unpack(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randrange(1 << b) for b in (7, 14, 21, 20)) for _ in range(50)]
    df = spark.createDataFrame(rows, "lane long, tile long, x long, y long").withColumn("key", readname.pack_key(*map(F.col, readname.FIELDS[1:])))
    got = df.orderBy("key").select("lane", "tile", "x", "y", F.struct(*readname.unpack_key(F.col("key"))).alias("u")).collect()
    assert [tuple(r)[:4] for r in got] == sorted(rows) and all(tuple(r.u) == tuple(r)[:4] for r in got)


def test_read_names(spark):
    names = ["FC:1:2:3:4#0/1", "FC:1:2:3:4 x", "I:7:FC:1:2:3:4 1:N:0", "42/1", "42", "odd name:1"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(readname.fragment_id(F.col("n")).alias("f")).collect()
    assert [tuple(r.f) if r.f else None for r in got] == [("FC", 1, 2, 3, 4), ("FC", 1, 2, 3, 4), ("I:7:FC", 1, 2, 3, 4), (None, 0, 0, 0, 42), (None, 0, 0, 0, 42), None]


def test_flags(spark):
    df = spark.createDataFrame([(99,), (4,), (1024,), (515,)], "f int")
    row = df.select(*readname.flag_columns(F.col("f"))).first()
    assert row.multi_fragment and row.all_mapped and row.first and row.next_reverse and not row.reverse
    back = df.select("f", readname.pack_flags(**{k: F.col("f").bitwiseAND(F.lit(b)) != 0 for k, b in readname.FLAGS.items()}).alias("g")).collect()
    assert all(r.f == r.g for r in back)
    kept = lambda t: [r.f for r in df.where(readname.flag_filter(F.col("f"), t)).collect()]
    assert kept("Mp") == [1024] and kept("m") == [4] and kept("d") == [99, 4, 515] and kept("q") == [515]


def test_sequences(spark):
    row = spark.range(1).select(
        seq.reverse_complement(F.lit("ACGTNacgtnRx")), seq.iupac_reverse_complement(F.lit("ACMGRSVTWYHKDBN")), seq.difference(F.lit("ACGT"), F.lit("ACCT")),
        seq.wrap(F.lit("ACGTACG"), 3), seq.wrap(F.lit("ACGTAC"), 3), seq.iupac_mask(F.lit("n")), seq.shift_quality(F.lit("h!"), -31), seq.accept_quality(F.lit("II!!"), 40),
    ).first()
    assert tuple(row) == ("XXnacgtNACGT", "NVHMDRWABSYCKGT", "..C.", "ACG\nTAC\nG", "ACG\nTAC", 15, "I!", True)


def test_tail(tmp_path):
    p = tmp_path / "t"
    p.write_text("one\ntwo\nthree\n")
    assert lines.tail(str(p), 8) == "three\n" and lines.tail(str(p), 100) == "one\ntwo\nthree\n"


def test_dealt_scans_keep_their_rows(spark, tmp_path):
    from locusframe.plans.scan import dealt

    spark.range(1000).selectExpr("id", "id % 3 AS k").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    many = dealt(one, "id")
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(many.collect()) == sorted(one.collect())
    wide = one.repartition(16)
    assert dealt(wide, "id") is wide
    assert dealt(one.limit(0), "id").collect() == []
