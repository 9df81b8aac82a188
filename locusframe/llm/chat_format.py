"""Chat formatting with mappings chosen by schema fingerprints.

Records with conversations come in many layouts. The layout of a record (or of
a table) is told by a fingerprint: a hash of its sorted nested field paths,
each list element as ``[]``. ``LAYOUTS`` maps fingerprints to declarative
mappings (paths only, no code) that give canonical turns (role, text); a table
of one row per turn is a layout too. Records of an unknown fingerprint are
returned as such, not guessed at.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings (``CONTROL``) inside roles and texts are broken by a backslash after
their first character, and backslashes are doubled, so that no text can forge a
control string and unescaping gives it back exactly. A line feed in a role, whose
end is one, is written as a backslash and an n. The loss mask covers the
text of assistant turns, as code point spans.

Turns are formatted one by one before they are shuffled, and hashed as a stream
in (turn, role, text) order; a conversation of any length needs the memory of
``SEGMENT`` characters only, and is written as that many segments.

Defined results: null roles and texts are empty, a null turn comes first, rows
with a null conv_id are one conversation, repeated rows are repeated turns,
turns of one number are ordered by role and text, texts of any length are kept
whole. An empty table gives an empty result. Other columns and fields of a table are
ignored; a table that several layouts fit, none of them with all fields of the
others, is refused. A typed record with a null or empty list of turns is a
conversation of no turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import read_table, shuffle_width, work_dir, write_shared

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that chat templates in use treat as control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
#: Characters of a segment of the output, about.
SEGMENT = 1 << 20

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_CONTROL_RE = rf"([<\[])({_TAILS})"
_SEGMENTS = "conv_id long, segment long, formatted string, loss_spans array<struct<start:int,end:int>>"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, r"$1\\$2")


def unescape(text: str) -> str:
    """The text before ``escape``: a doubled backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(text: str) -> str:
    """The role before ``escape_role``: no control string goes on with an n, so a single backslash before one is a line feed."""
    return re.sub(r"\\(\\|n)?", lambda m: "\n" if m[1] == "n" else m[1] or "", text) if "\\" in text else text


# --- layouts -------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where canonical turns are found.

    ``items`` names a list of turns, with ``role`` and ``text`` paths below its
    elements; without it, ``parts`` gives (role, paths) whose non-empty values
    are joined by blank lines. ``roles`` renames roles. ``rows`` marks a table
    of one row per turn.
    """

    name: str
    fields: tuple[str, ...]
    items: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    rows: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.fields)


def fingerprint_of(paths) -> str:
    """Hash of nested field paths, whatever their order; ids do not count."""
    kept = sorted(p for p in set(paths) if p.split(".")[-1] not in ("id", "conv_id", "conversation_id"))
    return hashlib.sha256("\n".join(kept).encode()).hexdigest()[:16]


def paths_of(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value; a list's elements share ``[]``."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths_of(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from paths_of(v, f"{at}[]")
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


_SPEAKERS = (("human", "user"), ("gpt", ASSISTANT), ("bot", ASSISTANT), ("model", ASSISTANT))
LAYOUTS = {
    x.fingerprint: x
    for x in (
        Layout("turn rows", ("turn", "role", "text"), rows=True),
        Layout("messages", ("messages[].role", "messages[].content"), items="messages"),
        Layout("named messages", ("messages[].role", "messages[].name", "messages[].content"), items="messages"),
        Layout("from/value", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=_SPEAKERS),
        Layout("text dialog", ("dialog[].speaker", "dialog[].text"), items="dialog", role="speaker", text="text", roles=_SPEAKERS),
        Layout("prompt/completion", ("prompt", "completion"), parts=(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
        Layout("prompt/response", ("prompt", "response"), parts=(("user", ("prompt",)), (ASSISTANT, ("response",)))),
        Layout("question/answer", ("question", "answer"), parts=(("user", ("question",)), (ASSISTANT, ("answer",)))),
        Layout("instruction/output", ("instruction", "output"), parts=(("user", ("instruction",)), (ASSISTANT, ("output",)))),
        Layout("instruction/input/output", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
        Layout("system/instruction/output", ("system", "instruction", "output"), parts=(("system", ("system",)), ("user", ("instruction",)), (ASSISTANT, ("output",)))),
    )
}


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record."""
    names = dict(layout.roles)
    if layout.items is not None:
        found = [(_get(x, layout.role), _get(x, layout.text)) for x in record.get(layout.items) or []]
        return [(names.get(r, r), t) for r, t in found]
    turns = [(role, "\n\n".join(v for p in paths if (v := _get(record, p)))) for role, paths in layout.parts]
    return [(r, t) for r, t in turns if t or r != "system"]


_TURNS = "conv_id long, turn long, role string, text string, layout string"


def _turn_rows(records: DataFrame, found) -> DataFrame:
    """Rows of (conv_id, record): ``found`` gives the layout of a record, or none, and its name for the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv_id, raw in zip(b["conv_id"].astype("Int64").to_numpy(dtype=object, na_value=None), b["record"], strict=True):
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError):
                    record = None
                layout, name = found(record)
                turns = turns_of(record, layout) if layout else []
                rows += [(conv_id, i, r, t, name) for i, (r, t) in enumerate(turns)] or [(conv_id, None, None, None, name)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "layout"]).astype({"conv_id": "Int64", "turn": "Int64"})

    source = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record"))
    return source.mapInPandas(run, _TURNS)


def canonical_records(records: DataFrame, layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, layout) from JSON records (conv_id, record).

    A record that is no JSON object, or of an unknown layout, gives one row
    with turn, role and text null and its fingerprint as layout.
    """

    def found(record) -> tuple[Layout | None, str]:
        key = fingerprint_of(paths_of(record)) if isinstance(record, dict) else "none"
        layout = layouts.get(key)
        return (None, key) if layout is None or layout.rows else (layout, layout.name)

    return _turn_rows(records, found)


def layout_of(schema: T.StructType, layouts: dict[str, Layout] = LAYOUTS) -> Layout:
    """The layout of a table that has all its fields, whatever others it has: rows per turn, else the one with most fields."""
    paths = set(schema_paths(schema))
    fitting = [x for x in layouts.values() if paths.issuperset(x.fields)]
    fitting = [x for x in fitting if x.rows] or [x for x in fitting if not any(set(x.fields) < set(y.fields) for y in fitting)]
    if not fitting:
        raise ValueError(f"no layout has the fingerprint {fingerprint_of(paths)}")
    if len(fitting) > 1:
        raise ValueError("several layouts fit: " + ", ".join(x.name for x in fitting))
    return fitting[0]


def canonical_table(table: DataFrame, layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, empty) from a table: rows per turn, or typed records.

    A typed record without turns gives one row that is ``empty``; it is formatted as no turn.
    """
    layout = layout_of(table.schema, layouts)
    if layout.rows:
        return table.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.lit(False).alias("empty"),
        )
    body = dict.fromkeys(re.split(r"\[\]|\.", f)[0] for f in layout.fields)
    packed = table.select("conv_id", F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("record"))
    return _turn_rows(packed, lambda record: (layout, layout.name)).select("conv_id", "turn", "role", "text", F.col("turn").isNull().alias("empty"))


# --- template ------------------------------------------------------------


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted segments: conv_id, segment, formatted, loss_spans (code points within the segment).

    Rows that are ``empty``, where there is such a column, count as no turn; their conversation stays.
    """
    turn = ~F.coalesce("empty", F.lit(False)) if "empty" in turns.columns else F.lit(True)
    role = escape_role(F.coalesce(F.col("role"), F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    pieces = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(turn, F.concat(head, body, F.lit(END))).otherwise("").alias("piece"), F.length(head).alias("from"), F.length(body).alias("chars"),
    )
    ordered = pieces.repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, number, parts, spans, size = object(), 0, [], [], 0
        done = []
        for b in batches:
            ids = b["conv_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for conv_id, role, piece, start, chars in zip(ids, b["role"], b["piece"], b["from"], b["chars"], strict=True):
                if conv_id != conv or size >= SEGMENT:
                    if parts:
                        done.append((conv, number, "".join(parts), spans))
                    number = number + 1 if conv_id == conv else 0
                    conv, parts, spans, size = conv_id, [], [], 0
                if role == ASSISTANT:
                    spans.append({"start": size + start, "end": size + start + chars})
                parts.append(piece)
                size += len(piece)
            if done:
                yield _segments(done)
                done = []
        if parts:
            yield _segments([(conv, number, "".join(parts), spans)])

    return ordered.select("conv_id", "role", "piece", "from", "chars").mapInPandas(run, _SEGMENTS)


def _segments(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "segment", "formatted", "loss_spans"]).astype({"conv_id": "Int64"})


def parse_segment(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) turns of a formatted segment, unescaped."""
    for piece in formatted.split(START)[1:]:
        role, _, body = piece.partition("\n")
        if not body.endswith(END):
            raise ValueError("a turn without an end")
        yield unescape_role(role), unescape(body[: -len(END)])


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text and its mask alone."""
    ordered = segments.repartition(shuffle_width(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = object(), None

        def result() -> tuple:
            n, turns, chars, loss, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for b in batches:
            done = []
            ids = b["conv_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for conv_id, formatted, spans in zip(ids, b["formatted"], b["loss_spans"], strict=True):
                if conv_id != conv:
                    if state:
                        done.append(result())
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_segment(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if done:
                yield _digests(done)
        if state:
            yield _digests([result()])

    return ordered.mapInPandas(run, _DIGESTS)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGESTS.split(", ")]).astype({"conv_id": "Int64"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": own}, {"role": ASSISTANT, "content": own}]})
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    turns = canonical_table(read_table(spark, sf_dir, "conversations")).unionByName(
        canonical_records(extra).select("conv_id", "turn", "role", "text", F.col("turn").isNull().alias("empty"))
    )
    return read_back(write_shared(format_turns(turns), work_dir(spark, "chats")))


_SQL_CONTROL = r"([<\[])(" + "|".join(re.sub(r"([|\[\]])", r"\\\1", c[1:]) for c in CONTROL) + ")"
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(regexp_replace(replace(role, '\', '\\'), '{_SQL_CONTROL}', '\1\\\2', 'g'), chr(10), '\n'))
          + length(regexp_replace(replace(text, '\', '\\'), '{_SQL_CONTROL}', '\1\\\2', 'g')) + {len(START) + 1 + len(END)} AS chars
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
