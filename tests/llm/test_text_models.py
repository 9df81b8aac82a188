import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import language_id, pii, toxicity

from .common import AWKWARD, awkward, empty, rows

# --- language -----------------------------------------------------------------


def labelled(n=60):
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["öße", "schön", "über"], "zz": ["ñoño", "que", "llama"]}
    return [(i, " ".join(words[k][(i * j) % 3] for j in range(30)), k) for i, k in enumerate([*words] * n)]


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.createDataFrame(labelled(), "doc_id long, text string, lang string"))


def test_every_window_is_seen():
    x = language_id.windows_of("A" * 500)
    assert x.shape == (3, language_id.WINDOW) and (x[0] == ord("a")).all() and x[2, -1] == 32
    assert language_id.windows_of("").shape == (1, language_id.WINDOW)


def test_inference_equals_the_plain_convolution(model):
    x = np.concatenate([language_id.windows_of(t) for _, t, _ in labelled(2)])
    tops = np.concatenate([v.max(axis=1) for v in model._conv(x)], 1)
    plain = language_id._softmax(np.maximum(tops + model.bias, 0) @ model.out + model.out_bias)
    assert np.allclose(model.probabilities(x), plain, atol=1e-5)


def test_languages_of_awkward_rows(spark, model):
    got = language_id.identify(awkward(spark), model).collect()
    assert len(got) == len(AWKWARD)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3, 7} and all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.doc_id in und)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1
    assert language_id.identify(empty(spark), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(awkward(spark), None).collect()} == {"und"}
    assert language_id.fit(empty(spark)) is None and language_id.fit(awkward(spark).where("lang IS NULL")) is None
    seen = language_id.predict_rows(awkward(spark), model)
    assert seen.select("row.*").columns == awkward(spark).columns and seen.count() == len(AWKWARD)


def test_the_end_of_a_text_counts(model):
    a, b = labelled(1)[0][1] + " ", labelled(1)[1][1] + " "
    assert model.predict([a * 2 + b * 20])[0][0] == "yy" and model.predict([a * 20 + b * 2])[0][0] == "xx"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in language_id.query(spark, "/root/testdata/sf0.01").collect()}
    docs = {r["doc_id"]: r for r in rows("documents", "/root/testdata/sf0.01")}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items()) and len(got) == len(docs)
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == docs[i]["lang"] for i in held]) > 0.97


def test_the_sample_does_not_depend_on_copies_or_layout(spark):
    """A text that fills a third of the table neither takes places of others nor leaves a language out."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(labelled(100), "doc_id long, text string, lang string").withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(labelled(1)[0][1] + " 0").alias("text"), F.lit("xx").alias("lang"))
    plain = language_id.fit(base, sample_docs=40, steps=30)
    for table in (base.union(copies), base.union(copies).repartition(7, "lang"), base.orderBy(F.desc("doc_id"))):
        again = language_id.fit(table, sample_docs=40, steps=30)
        assert again.langs == plain.langs == ["xx", "yy", "zz"]
        assert all(np.array_equal(a, b) for a, b in zip(again.params(), plain.params(), strict=True))


def test_more_than_two_hundred_labels_are_learned(spark):
    rows_ = [(k * 10 + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * 7 % 26)} " * 40, f"l{k:03d}") for k in range(230) for j in range(3)]
    model = language_id.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), steps=60)
    assert len(model.langs) == 230


def test_predictions_of_the_query_against_brute_force(spark, tmp_path):
    """Window by window, filter by filter, over whole texts."""
    table = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in labelled(30)] + [(500, None, "xx", "s", 0), (501, "12 34", "xx", "s", 0), (502, labelled(1)[1][1] * 30, None, "s", 0), (503, "Öße", "", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit_unheld(docs)
    got = {r.doc_id: r for r in language_id.query(spark, str(tmp_path)).collect()}
    assert len(got) == table.count()
    for r in table.collect():
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in r.text.encode())
        total, weight = 0, 0
        for i in range(0, len(data), language_id.WINDOW):
            own = data[i : i + language_id.WINDOW]
            x = own + b" " * (language_id.WINDOW - len(own))
            hidden = []
            for w, tables in zip(language_id.WIDTHS, model.tables, strict=True):
                hidden += [max(sum(float(tables[k][x[p + k], f]) for k in range(w)) for p in range(len(x) - w + 1)) for f in range(language_id.FILTERS)]
            z = np.maximum(np.array(hidden) + model.bias, 0) @ model.out + model.out_bias
            p = np.exp(z - z.max())
            total, weight = total + len(own) * p / p.sum(), weight + len(own)
        mean = total / weight
        assert got[r.doc_id].lang_pred == model.langs[int(mean.argmax())] and abs(got[r.doc_id].score - mean.max()) < 1e-4


# --- toxicity -----------------------------------------------------------------


def test_chain_learns_words_and_earlier_categories():
    texts, a, b = [], [], []
    for i in range(400):
        rude, vile = i % 3 == 0, i % 6 == 0
        word = f"{chr(97 + i % 26)}{chr(97 + i // 26)}zz"
        texts.append(f"some plain words {word} q{word[::-1]} " + ("grubbly " if rude else "") + ("snarkfish" if vile else ""))
        a.append(int(rude) if i % 11 else None)
        b.append(int(vile))
    chain = toxicity.train_chain(texts, {"rude": a, "vile": b})
    names = [x.name for x in chain.links]
    assert names == ["rude", "vile"] and len(chain.links[1].earlier) == 1 and chain.links[1].earlier[0] != 0
    p = chain.probabilities(texts)
    cut = np.array([x.threshold for x in chain.links])
    assert ((p >= cut)[:, 1] == np.array(b, bool)).all() and ((p >= cut)[:, 0] == np.array([i % 3 == 0 for i in range(400)])).all()
    assert (chain.probabilities(["grubblies"])[0] >= cut)[0]  # inflected


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None), (4, 1, 1), (9, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    chain = toxicity.fit(awkward(spark), labels, {"toxic": F.col("toxic")})
    got = toxicity.score(awkward(spark), chain).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.p_toxic <= 1 for r in got)
    assert not any(r.is_toxic for r in got if r.doc_id in (1, 2, 3, 7))
    none = toxicity.fit(awkward(spark), labels.where("false"), {"toxic": F.col("toxic")})
    assert not any(r.is_toxic for r in toxicity.score(awkward(spark), none).collect())
    assert toxicity.score(empty(spark), chain).count() == 0


def test_scores_of_the_query_against_brute_force(spark, tmp_path):
    """Word by word and link by link, over whole texts; labels that contradict each other give the same chain each time."""
    import math

    from pyspark.sql import functions as F

    texts = [(i, " ".join([f"plain w{i % 7}ord", "grubbly grubblish" if i % 3 == 0 else "fine", "Snarkfish!" if i % 6 == 0 else ""])) for i in range(120)] + [(200, None), (201, " 12 "), (None, "grubbly snarkfish"), (3, "grubbly")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int(i % 3 > 0), int(i % 6 == 0)) for i in range(120)] + [(5, 0, 0), (5, 1, 1), (200, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").repartition(5).write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    cats = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.fit(docs, labels, cats)
    assert toxicity.fit(docs.repartition(3), labels.repartition(2), cats).links == chain.links
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    want = {}
    for i, text in texts:
        words = set(re.findall(r"[^\W\d_]+", text.lower())) if text else set()
        seen = [f for w in words for f in [w, *(f"{w[:k]}-" for k in (4, 5, 6, 7) if len(w) > k)]]
        own = set(seen) | {f"{f}2" for f in set(seen) if seen.count(f) > 1 and f.endswith("-")}
        p = []
        for link in chain.links:
            z = link.bias + sum(link.weights.get(f, 0) for f in own) + sum(a * b for a, b in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        want.setdefault(i, []).append((p, [q >= link.threshold and bool(words) for q, link in zip(p, chain.links, strict=True)]))
    for r in got:
        assert any(np.allclose([r.p_low_quality, r.p_toxic], p, atol=1e-9) and [r.is_low_quality, r.is_toxic] == flags for p, flags in want[r.doc_id])
    assert sum(r.is_toxic for r in got) >= 15


def test_training_text_is_bounded_in_characters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "nice ") + f"w{i} " * 50) for i in range(60)] + [(99, "x" * 300_000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    small = toxicity.fit(docs, labels, {"toxic": F.col("toxic")}, sample_chars=6000)
    assert small.links[0].name == "toxic"


def test_toxicity_held_out(spark):
    """Learned on half of the labels, tried on the other half."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    chain = toxicity.fit(docs, labels.where(half), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    held = toxicity.score(docs.join(labels.where(~half).select("doc_id"), "doc_id", "left_semi"), chain).join(labels, "doc_id").select("is_toxic", "toxic").collect()
    hit = sum(r.is_toxic and r.toxic for r in held)
    assert hit / sum(r.toxic for r in held) > 0.85 and hit / sum(r.is_toxic for r in held) > 0.8


# --- personal data ---------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out, n = [], dict.fromkeys(PATTERNS, 0)
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and pii._luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15)
            if good:
                out.append((m.start(), order, m.end(), kind))
                n[kind] += 1
    return n, ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def check_base(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        n, listed = base(texts[r.doc_id])
        assert {k: r[f"n_{k}"] for k in n} == n, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    return {r.doc_id: r.spans for r in got}


def test_base_on_awkward_texts(spark, tmp_path):
    # The plain patterns that results are held against take n * n steps on long runs, so runs are short here.
    texts = [r[1] for r in AWKWARD if r[0] != 9] + [
        "a@b.c_d@e.f x@y.z+g@h.ii", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3.00000256", "+1 (017) 555-7713 +++49 30 1234567890 +1234567890123456", "4111-1111-1111-1111 4111 1111 1111 1111 12",
        "é🤦 a@b.co 🤦🏼 1.2.3.4", "@@@@", "1 " * 3000, "a" * 3000 + "@b.c", "9" * 3000, "x" * 3000, "1.1.1.1 " * 1000, "+" * 5000 + "1" * 12, "a.b@c" * 1000, "4111 1111  1111 1111", "..@.. a@-.-",
    ]
    check_base(spark, texts, tmp_path)


def test_long_runs(spark):
    texts = {1: "a" * 300_000 + "@b.c", 2: "9" * 300_000, 3: "x" * 300_000, 4: "1.1.1.1 " * 20_000, 5: "1 " * 100_000}
    got = pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, len(r.added)) for r in got} == {1: (1, 0, 0, 0, 0), 2: (0,) * 5, 3: (0,) * 5, 4: (0, 20_000, 0, 0, 0), 5: (0,) * 5}
    spans = next(r.base for r in got if r.doc_id == 4)
    assert all((x.s, x.e) == (8 * i, 8 * i + 7) for i, x in enumerate(sorted(spans)))


alphabet = st.text(st.sampled_from("aZ9.@+-% ()_1204é\n"), max_size=60)


@settings(max_examples=6, deadline=None)
@given(st.lists(alphabet, min_size=150, max_size=150))
def test_base_on_random_texts(spark, tmp_path_factory, texts):
    check_base(spark, texts, tmp_path_factory.mktemp("pii"))


def test_base_on_the_drivers_documents(spark, tmp_path):
    check_base(spark, [r["text"] for r in rows("documents")], tmp_path)


def test_added_spans(spark, tmp_path):
    texts = ["mail: john [at] example [dot] com", "call me: (555) 123-4567", "order no 4111.1111.1111.1112", "credit card 4111.1111.1111.1111", "plain words, version 555-123-4567", "a +1 (826) 555-4081 19090. b", "meet at example and dot the i"]
    spans = check_base(spark, texts, tmp_path)
    found = {i: [texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in v.split(",") if s] for i, v in spans.items()}
    assert found == {0: ["john [at] example [dot] com"], 1: ["(555) 123-4567"], 2: [], 3: ["4111.1111.1111.1111"], 4: [], 5: ["(826) 555-4081"], 6: []}
    red = pii.redact(spark.createDataFrame([(1, "a@b.c and 1.2.3.4!"), (2, None), (3, "none"), (4, "é token = '0123456789abcdef0123456789abcdef' x")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in red} == {1: "[EMAIL] and [IP]!", 2: "", 3: "none", 4: "é token = '[SECRET]' x"}


def test_many_spans_of_all_kinds_like_a_plain_sweep(spark):
    """Overlaps, rivals and redactions against the definition, span by span; and a text with very many within a bounded time."""
    import random
    import time

    rng = random.Random(3)
    parts = ["mail john [at] example [dot] com ", "x@b.co ", "(555) 123-4567 ", "call 555-123-4567.", "4111.1111.1111.1111 ", "1.2.3.4", "secret=abcdef0123456789abcdef99 ", "+1 (017) 555-7713 ", "é🤦 ", "pay 4111 1111 1111 1111, "]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {r.doc_id: r for r in pii.find(df).collect()}
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    some = 0
    for i, text in texts:
        r = whole[i]
        base_, added = [(x.s, x.e) for x in r.base], sorted((x.s, x.e) for x in r.added)
        assert all(not (a < e and s < z) for s, e in added for a, z in base_) and all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))
        some += len(added)
        spans = sorted((x.s, x.k, x.e) for x in [*r.base, *r.added, *r.secrets])
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"[{pii._ALL[k].upper()}]"]
            at = max(at, e)
        assert red[i] == "".join(out) + text[at:]
    assert some > 100
    long = " ".join(f"mail john{i} [at] example [dot] com or x{i}@b.co, call (555) 123-4567 or 1.2.3.4;" for i in range(8000))
    began = time.time()
    r = pii.redact(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert time.time() - began < 60 and r.text.count("[EMAIL]") == 16_000 and r.text.count("[PHONE]") == 8000


def test_ranks_among_points(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    for n in (0, 1, 5, 40):
        points, marks = [rng.randrange(20) for _ in range(n)], [rng.randrange(20) for _ in range(n // 2 + 1)]
        df = spark.createDataFrame([(points, marks)], "p array<int>, m array<int>")
        row = df.select(pii.counts_below(F.col("p"), F.col("m"), True), pii.counts_below(F.col("p"), F.col("m"), False)).first()
        assert row[0] == [sum(p < m for p in points) for m in marks] and row[1] == [sum(p <= m for p in points) for m in marks]


def test_model_learns_from_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weak = pii.weak_examples(docs)
    assert {(f["kind"], y) for f, y, _ in weak} >= {(0, 1), (1, 1), (2, 0), (2, 1), (3, 1)} and len(weak) <= pii.SAMPLE_ROWS
    assert pii.weak_examples(docs.union(docs).repartition(5)) == weak  # copies and layout do not count
    for held in (weak[1::2], [(f, y, 1.0) for f, y in pii.generated(2000, 99)]):
        assert all(p > 0.9 and r > 0.9 for p, r in pii.quality(pii.train(weak), held).values())
    assert pii.weak_examples(empty(spark)) == [] and len(pii.train([])[1]) == len(pii._ALL)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 3, 10, 17, 100):
        values = list(range(1, n + 1))
        df = spark.createDataFrame([(values,)], "a array<int>")
        assert df.select(pii.running(F.col("a"))).first()[0] == [sum(values[:i]) for i in range(n)]


def test_pii_plan_is_native(spark):
    plan = pii.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert pii.find(empty(spark)).count() == 0 and pii.find(awkward(spark)).count() == len(AWKWARD)
