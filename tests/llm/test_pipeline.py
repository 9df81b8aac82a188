import re
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from locusframe.llm import language_id, token_files
from locusframe.llm._common import slices, small_batches, work_dir, write_shared
from locusframe.llm._shingles import words_of

from .common import DATA, awkward, empty, rows
from .test_similarity import brute, tuples


def test_stages_against_brute_force(spark):
    """Each stage on its own input: what goes, goes by its rule; what stays keeps its columns."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, states = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        states.append(docs.collect())
        docs = write_shared(stage(spark, docs, DATA), f"{work_dir(spark, 'stage')}/{name}")
        if name != "tokens":
            assert docs.columns == columns
    first, known, alone, clean, mixed = states
    kept = {r.doc_id for r in known}
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in known) and len(kept) > 0.95 * len(first)
    groups = brute([(r.doc_id, r.text) for r in known])
    assert {r.doc_id for r in alone} == {i for i in groups if groups[i][1] == i}
    items = [tuples(i["text"]) for i in rows("benchmark")]
    leaky = {r.doc_id for r in alone if any(100 * len(x & tuples(r.text)) >= 80 * len(x) for x in items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in alone} - leaky
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    copies = {i: sum(r.doc_id == i for r in mixed) for i in {r.doc_id for r in clean}}
    assert max(copies.values()) <= 3 and sum(len(words_of(r.text)) for r in mixed) > 0
    tok, start, want = token_files.encoder(token_files.default_tokenizer()).tokenizer, 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[1]) == want


def test_stages_take_awkward_and_empty_tables(spark):
    for table in (awkward(spark), empty(spark)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "tokens":
                assert out.columns == docs.columns
                docs = write_shared(out, f"{work_dir(spark, 'stage')}/{name}")
            else:
                assert out.count() == docs.count()


def test_run_gives_the_same_again(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) for _ in range(2))
    assert a == b and a
    assert corpus_pipeline.ORACLE_SQL is None and language_id.UNKNOWN == "und"


def _full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_each_stage_gives_back_the_heap_before_it(spark):
    """Executors live on, so a heap that one stage has grown would stand beside the workers of the next."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = _full_collections(spark)
        stage(spark, docs.limit(20), DATA)
        assert _full_collections(spark) > before, name


def _memo_sizes(spark):
    def run(batches):
        import importlib

        encoders = importlib.import_module("locusframe.llm.token_files")._encoders  # the worker's own
        for _ in batches:
            yield pa.RecordBatch.from_pylist([{"n": sum(len(e.parts) for e in encoders.values())}])

    return [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(run, "n long").collect()]


def test_workers_let_go_of_the_memo_once_the_files_are_read(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    uri = work_dir(spark, "memo")
    token_files.write_tokens(docs, uri, token_files.default_tokenizer(), 1)
    assert max(_memo_sizes(spark)) > 1000
    # As many tasks as it takes for each worker to have had one.
    for _ in range(20):
        assert token_files.read_tokens(spark, uri).count() == docs.count()
        if not any(_memo_sizes(spark)):
            break
    assert not any(_memo_sizes(spark))


def test_batches_are_bounded_in_bytes(spark):
    texts = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"bytes": b.nbytes}])

    with small_batches(spark, 10_000, 2 << 20):
        sizes = [r.bytes for r in texts.mapInArrow(run, "bytes long").collect()]
    assert sum(sizes) > 18 << 20 and max(sizes) < 3 << 20
    assert spark.conf.get(name) == before


def test_slices_keep_every_text_in_order():
    texts = pa.array([None, "", "abc", None, "d" * 50, "e", "f" * 9, "g"])
    parts = list(slices(texts, 10))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert len(parts) > 2 and list(slices(pa.array([], pa.string()), 10)) == []
