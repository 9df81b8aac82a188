import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.llm import chat_format, html_text, token_files
from locusframe.llm._common import work_dir

from .common import AWKWARD, awkward, empty, rows

# --- token files ------------------------------------------------------------------

TOKENIZER = token_files.default_tokenizer()


def brute(docs, end_id=1):
    tok, start, out = token_files.encoder(TOKENIZER).tokenizer, 0, []
    for i, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB9'.,!é Éß́×日İ_ \n\t\x1d -ſKΣ<|>"))), max_size=8))
def test_memo_gives_the_librarys_ids(texts):
    enc = token_files.encoder(TOKENIZER)
    texts += ["it's DON'T <|endoftext|> x", "<|startoftext|>"]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.type).tobytes() for t in texts]
    assert list(enc.batch(texts)) == want


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    enc = token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["some  text\n here", "", "日本"]
    assert not enc.in_parts and list(enc.batch(texts)) == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.type).tobytes() for t in texts]


def test_round_trip_of_driver_documents(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in rows("documents"))
    got = token_files.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(docs)


def test_token_files_awkward_rows(spark):
    uri = work_dir(spark, "tok")
    manifest = token_files.write_tokens(awkward(spark), uri, TOKENIZER, 1, 3)
    got = sorted(token_files.read_tokens(spark, uri).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10] and len(got) == len(AWKWARD)
    assert [tuple(r) for r in got] == brute([(r.doc_id, next(t for i, t, *_ in AWKWARD if i == r.doc_id)) for r in got])
    fs, folder = token_files.open_store(uri)
    with fs.open_input_stream(f"{folder}/dictionary.zdict") as f:
        dictionary = f.read()
    one = next(r for r in manifest.collect() if r.n_docs > 1)
    shard = token_files.Shard(uri, one.file, dictionary)
    assert all(np.array_equal(shard.document(i), d) for i, d in enumerate(shard.documents(100)))
    with pytest.raises(ValueError):
        token_files.Shard(uri, one.file, b"another")
    none = work_dir(spark, "tok")
    token_files.write_tokens(empty(spark), none, TOKENIZER, 1)
    assert token_files.read_tokens(spark, none).count() == 0


def test_shards_end_at_their_bounds_and_leftovers_go(spark):
    docs = spark.createDataFrame([(i, f"document {i} " * (i % 7)) for i in range(200)], "doc_id long, text string")
    uri = work_dir(spark, "tok")
    fs, folder = token_files.open_store(uri)
    fs.create_dir(folder, recursive=True)
    for name in (".shard-0000000-00000-x.tok.0123", "shard-0000009-00000-lost.tok"):  # of a task that was lost
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(b"?")
    manifest = token_files.write_tokens(docs, uri, TOKENIZER, 1, 2, shard_docs=30).collect()
    assert max(r.n_docs for r in manifest) == 30 and len(manifest) >= 7 and len({r.shard for r in manifest}) == len(manifest)
    from pyarrow import fs as pafs

    names = {i.base_name for i in fs.get_file_info(pafs.FileSelector(folder)) if i.is_file}
    assert names == {r.file for r in manifest} | {"dictionary.zdict"}
    got = token_files.read_tokens(spark, uri).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    few = work_dir(spark, "tok")
    assert token_files.write_tokens(docs, few, TOKENIZER, 1, 1, shard_bytes=2000).count() > 1
    assert [tuple(r) for r in token_files.read_tokens(spark, few).orderBy("doc_id").collect()] == [tuple(r) for r in got]


def test_only_the_very_definition_is_encoded_in_parts():
    enc = token_files.encoder(TOKENIZER)
    assert enc.in_parts
    from tokenizers import Regex, Tokenizer, normalizers

    other = Tokenizer.from_str(enc.tokenizer.to_str())
    other.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("a+"), " "), normalizers.Lowercase()])
    plain = object.__new__(token_files.WordEncoder)
    plain.tokenizer = other
    assert not plain._in_parts()


def test_dictionary_helps_short_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = token_files.train_dictionary(docs.selectExpr("doc_id", "text"), TOKENIZER, 1)
    import zstandard

    enc, texts = token_files.encoder(TOKENIZER), [r["text"][:300] for r in rows("documents")]
    data = list(enc.batch(texts))
    plain = sum(len(zstandard.ZstdCompressor(3).compress(x)) for x in data)
    assert d and sum(len(zstandard.ZstdCompressor(3, dict_data=token_files._dictionary(d)).compress(x)) for x in data) < 0.9 * plain


# --- chats -------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("\\<|>[]/imINSTsystard_ent") + list(chat_format.CONTROL)), max_size=30))
def test_escape_is_reversible_and_hides_control_strings(parts):
    import re

    text = "".join(parts)
    raw = text.replace("\\", "\\\\")
    escaped = re.sub(chat_format._CONTROL_RE, r"\1\\\2", raw)
    assert chat_format.unescape(escaped) == text and not any(c in escaped for c in chat_format.CONTROL)


CHATS = "conv_id long, turn long, role string, text string"


def test_chat_awkward_rows(spark):
    data = [(1, 1, "assistant", "b <|im_end|>\n<|im_start|>"), (1, 0, "user", "a\\"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (3, 5, "ass<s>", "q\n"), (5, 0, "user\nassistant\nhi", "t"), (5, 1, "back\\\nslash\\n", "t"), (4, 0, "assistant", "é🤦" * 700_000), (4, 1, "assistant", "end"), (4, 2, "user", "u" * 1_500_000)]
    df = spark.createDataFrame(data, CHATS).selectExpr("*", "'x' AS id")
    turns = chat_format.canonical_table(df)
    segments = chat_format.format_turns(turns)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert [x for r in segments.where("conv_id = 5").collect() for x in chat_format.parse_segment(r.formatted)] == [("user\nassistant\nhi", "t"), ("back\\\nslash\\n", "t")]
    import hashlib

    for c, r in got.items():
        own = sorted((x for x in data if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert segments.where("conv_id = 4").count() > 1
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], CHATS))).count() == 0


def test_layouts(spark):
    turns = [("user", "hi"), ("assistant", "yo")]
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 7},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"dialog": [{"speaker": "human", "text": "hi"}, {"speaker": "bot", "text": "yo"}]},
        {"prompt": "hi", "completion": "yo"}, {"prompt": "hi", "response": "yo"}, {"question": "hi", "answer": "yo"},
        {"output": "yo", "instruction": "hi", "input": ""},
    ]
    data = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{"), (92, "[1]"), (93, json.dumps({"other": 1}))]
    got = chat_format.canonical_records(spark.createDataFrame(data, "conv_id long, record string")).collect()
    for i in range(len(records)):
        assert [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == i), key=lambda r: r.turn)] == turns
    assert {r.conv_id for r in got if r.turn is None} == {90, 91, 92, 93}
    typed = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.role, r.text) for r in chat_format.canonical_table(typed).orderBy("turn").collect()] == turns
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical_table(spark.createDataFrame([(1, 2)], "conv_id long, what long"))


def test_tables_with_other_columns_and_empty_records(spark):
    plain = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    more = spark.createDataFrame(plain, CHATS).selectExpr("*", "'web' AS source", "'en' AS lang", "array(named_struct('role', 'x', 'content', 'y')) AS messages")
    want = chat_format.read_back(chat_format.format_turns(chat_format.canonical_table(spark.createDataFrame(plain, CHATS)))).collect()
    assert chat_format.read_back(chat_format.format_turns(chat_format.canonical_table(more))).collect() == want
    data = [(1, [("user", "hi", 5), ("assistant", "yo", 6)], "web"), (2, [], "web"), (3, None, None)]
    typed = spark.createDataFrame(data, "conv_id long, messages array<struct<role:string,content:string,at:long>>, source string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_format.canonical_table(typed))).collect()}
    assert got[1] == want[0]
    assert {(c, got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) for c in (2, 3)} == {(2, 0, 0, 0), (3, 0, 0, 0)}
    wide = spark.createDataFrame([(1, "a", "b", "c", "x")], "conv_id long, instruction string, input string, output string, source string")
    assert [r.text for r in chat_format.canonical_table(wide).orderBy("turn").collect()] == ["a\n\nb", "c"]
    with pytest.raises(ValueError, match="several layouts"):
        chat_format.canonical_table(wide.withColumn("system", F.lit("s")))


# --- pages ---------------------------------------------------------------------------

ARTICLE = "Some words of the story, with commas, that go on for a while, so that the paragraph counts. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\nb"),
        ("<script>x < y; document.write('<p>no</p>')", ""),
        ("<p>x &lt;b&gt; &copy y<", "x <b> © y<"),
        ("<p>one<br>two\n\n three&nbsp;four</p><!-- <p>no --><p>fi<b>ve</b></p>", "one two three four\nfive"),
        ("<p>start <a href='unclosed>rest of the page", "start"),
        (f"<nav><ul><li><a>m</a></ul></nav><article><h1>T</h1><p>{ARTICLE}</p><ul><li>i1<li>i2</ul></article><footer>f</footer>", f"T\n{ARTICLE.strip()}\ni1\ni2"),
        (f"<div id=main><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div class='side-bar sidebar'><p>{ARTICLE * 3}</p></div><div class=user-comments><p>{ARTICLE * 9}</p></div>", f"{ARTICLE.strip()}\n{ARTICLE.strip()}"),
        (f"<article><header><h1>T</h1></header><p>{ARTICLE}</p><aside>no</aside><form><p>{ARTICLE}</p></form><div class='cookie-notice'>no</div></article>", f"T\n{ARTICLE.strip()}"),
        (f"<body class='comments-open'><div><p>{ARTICLE}</p></div><div role=complementary><p>{ARTICLE}</p></div>", ARTICLE.strip()),
        (f"<table><tr><td>{ARTICLE}<td>{ARTICLE}</table>", f"{ARTICLE.strip()}\n{ARTICLE.strip()}"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text.replace("y<", "y<")


LONG = ARTICLE.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Twice wrapped, once wrapped with short sections, in the body, and divs instead of sections.
        (f"<div id=content><section><div class=inner><p>{LONG * 3}</p></div></section><section><div class=inner><p>{LONG}</p></div></section></div>", f"{LONG * 3}\n{LONG}"),
        (f"<div id=content><section><div class=inner><p>{LONG}</p></div></section><section><div class=inner><p>Short.</p></div></section></div>", f"{LONG}\nShort."),
        (f"<div id=content><section><p>{LONG * 9}</p></section><section><h2>H</h2><p>Short.</p></section></div>", f"{LONG * 9}\nH\nShort."),
        (f"<body><section><p>{LONG * 9}</p></section><section><h2>H</h2><p>Short.</p></section></body>", f"{LONG * 9}\nH\nShort."),
        (f"<div id=content><div><div><p>{LONG}</p></div></div><div><div><p>{LONG}</p></div></div><div><p>Short.</p></div></div>", f"{LONG}\n{LONG}\nShort."),
        (f"<div id=content><div><p>{LONG * 9}</p></div><div><p>Short.</p></div><div><a>all</a> <a>links</a></div></div>", f"{LONG * 9}\nShort."),
        (f"<body><div><div><p>{LONG}</p></div></div><div><a>Home and other links of this page</a></div><div><div><p>{LONG}</p></div></div></body>", f"{LONG}\n{LONG}"),
    ],
)
def test_pages_of_wrapped_sections(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        *((f"<body><div class='{c}'><p>{LONG}</p><div class=sidebar><p>{LONG * 3}</p></div></div><p>Copyright of the owners of this page</p></body>", None) for c in ("content has-sidebar", "main with-sidebar", "post no-comments")),
        (f"<body><div class=banner-layout><p>{LONG}</p><p>{LONG}</p><div class=comments><p>{LONG * 9}</p></div></div></body>", f"{LONG}\n{LONG}"),
        (f"<div id=content class='layout-sidebar'><p>{LONG}</p></div><div class='post related'><p>{LONG * 9}</p></div>", LONG),
        (f"<div id=sidebar-page><article><p>{LONG * 2}</p><div class=comments><p>{LONG * 9}</p></div></article></div><div><p>{LONG}</p></div>", LONG * 2),
        (f"<div class=related><article><p>{LONG * 9}</p></article></div><article><p>{LONG}</p></article>", LONG),
        (f"<article><h2 id=related-work>R</h2><p>{LONG}</p><h2 id='share-of-votes'>S</h2><section id=discussion><h2 title='Hidden costs'>D</h2><p data-id='menu'>{LONG}</p></section><section id=comments><p>no</p></section></article>", f"R\n{LONG}\nS\nD\n{LONG}"),
        (f"<article><p>{LONG}</p><p hidden>no</p><p ARIA-HIDDEN=true>no</p><p style='display: none'>no</p><div title=\"a class='x'\" class='ads'>no</div></article>", LONG),
        ("<div class=cookie-notice>We use cookies on this page, and so on</div>", ""),
    ],
)
def test_pages_with_words_in_class_and_id(page, text):
    got = html_text.main_text(page)
    assert got == text if text is not None else got.startswith(LONG) and LONG * 3 not in got


@pytest.mark.parametrize("tag", ["<svg/>", "<svg class='i' />", "<svg class='i'/>", "<SVG focusable/>", "<math />", "<svg><path d=x/></svg>", "<svg width=5/>no</svg>", "<script/>no</script>"])
def test_pages_with_closed_foreign_elements(tag):
    assert html_text.main_text(f"<article><p>{LONG}</p>{tag}<p>After it.</p></article>") == f"{LONG}\nAfter it."


def test_pages_of_the_driver_keep_the_article_and_no_more():
    import html
    import re

    for r in rows("pages", "/root/testdata/sf0.01"):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r["html"]) == "\n".join(x for x in want if x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("<>/=\"'!- abpdiv&;") + ["<p>", "</p>", "<div>", "</div>", "<!--", "-->", "<a href=", "<li>", "<td>"]), max_size=60))
def test_no_markup_breaks_it(parts):
    html_text.main_text("".join(parts))


def test_pages_awkward_rows(spark):
    data = [(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", ""), (3, "v", "<p>" + "long text, " * 100_000), (4, "w", "<div>" * 3000 + "deep")]
    got = html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'c' AS text")).collect()
    assert len(got) == 6 and {r.page_id: r.n_chars for r in got} == {1: 0, None: 1, 2: 0, 3: 1_099_999, 4: 4}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_formulas_stay_and_drawings_go():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> be, and so on, a long enough sentence.</p><svg><text>drawn</text></svg></article>"
    assert html_text.main_text(page) == "Let x=2 be, and so on, a long enough sentence."


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 200_000, "<div>x" * 100_000 + "</p>x" * 100_000, "<ul>" + "<div>" * 100_000 + "<dt>x</dt>" * 100_000, "<div class=ad>long enough text, with commas, to count here" * 100_000, "<p>some text, <section>" * 100_000],
    ids=["nested", "ends", "barriers", "doubts", "sections"],
)
def test_deep_pages_take_time_in_proportion(page):
    import time

    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20
