"""Personal data by candidate gradient boosting, in Spark SQL expressions only.

High-recall generators (one regular expression for each kind and looseness)
propose spans, which may overlap. Spans that meet a kind's definition (the
base: e-mail address, IPv4 address, card number with Luhn digit, international
phone number) are always redacted. Every other proposal is described by its
format and its context and scored by boosted trees; those over the threshold
of their kind that do not meet a base span are added, the best of those that
overlap first.

The trees learn from two sources. Weak labels: matches of the base patterns in
a bounded sample of the documents (``SAMPLE_DOCS``, told by a hash of the text,
so that copies count once), labelled by whether they meet the definition; every
separator or bracket of a loose form counts as it does there. And examples that
a seeded generator writes from known formats, which stand for forms that the
base patterns cannot match. Half of both are held out, and the thresholds are
calibrated on that half for a precision of ``PRECISION``. The trees are then
written as CASE expressions, so scoring stays in the JVM: the main path is one
projection over the table, with no shuffle, Python, pandas or RDD code.

Positions come from splitting the text at the matches: gaps and matches
alternate, and their running lengths are summed in blocks. Overlaps are told by
ranks in sorted arrays, rivals and redactions by folds in blocks, and context is
cut from pieces of the text, so a text with n matches costs about n * sqrt(n)
copies of small values, whatever its length. Patterns are written so that they
cannot recurse or retry within a run.

Defined results: null text counts as empty; a text without personal data has
zero counts, the digest of the empty string and empty ``spans``. Of added spans
that overlap the one with the higher score stays, of equal ones the earlier;
those that touch a base span go. Repeated rows give repeated rows, null ids
stay null, an empty table gives an empty result. Texts of any length are read
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Proposals of this kind are listed by themselves: credentials in texts.
SECRET = "secret"
_ALL = (*KINDS, SECRET)

# The base patterns. Lookbehinds and possessive quantifiers give the same
# leftmost matches in linear time; \G lets a match start where the last one ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without one of these cannot match.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Looser proposals: kind, pattern. Matches are short by construction.
LOOSE = (
    ("email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?[\[({<] ?at ?[\])}>] ?[A-Z0-9-]{1,63}+(?: ?(?:\.|[\[({<] ?dot ?[\])}>]) ?[A-Z0-9-]{2,63}+){1,4}+"),
    ("ip", r"(?i)(?<![0-9A-F:.])(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}(?![0-9A-F:])"),
    ("card", r"(?<![0-9.-])[0-9]{4}(?:[./_ ‐-―][0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.(-])(?:00[1-9][0-9 ./-]{7,16}[0-9]|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9A-Za-z-]|\.[0-9])"),
    (SECRET, r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"),
)
#: Words before a span that name a kind, and words that name something else.
CONTEXT = {
    "email": r"(?i)e-?mail|mail|contact|write|reach|address",
    "ip": r"(?i)\bip\b|ipv6|host|server|addr|client|login",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|tarjeta|carte|\bcc\b|pay",
    SECRET: r"(?i)token|secret|passw|api.?key|access.?key|bearer|credential|private.?key",
    "phone": r"(?i)phone|tel\b|tel\.|call|mobile|cell|fax|whatsapp|sms|dial|ring|telefon|t[ée]l[ée]fono?",
}
AGAINST = r"(?i)\border|invoice|isbn|issn|serial|part no|version|item|sku|ref\b|tracking|article|model|\bid\b|figure|section|page|time|score"
#: Characters of context before a span.
BEFORE = 24

TREES, DEPTH, SHRINK, PRECISION = 24, 3, 0.3, 0.98
#: Documents whose base matches are weak labels, about, and distinct feature rows of them at most.
SAMPLE_DOCS, SAMPLE_ROWS = 4000, 4000
#: Code points of a piece of a text.
PIECE = 512
FEATURES = ("kind", "length", "digits", "groups", "luhn", "named", "against", "leading_zero", "bracket", "same_separators")


# --- training on generated candidates (driver, plain Python) ------------------


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(rng: random.Random) -> str:
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if _luhn(body + c))


def generated(count: int, seed: int) -> list[tuple[dict[str, float], int]]:
    """(features, label) of ``count`` proposals as the loose generators make them."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        kind = rng.randrange(5)
        real = rng.random() < 0.5
        named = rng.random() < (0.75 if real else 0.08)
        against = rng.random() < (0.02 if real else 0.55)
        f = dict.fromkeys(FEATURES, 0.0)
        f |= {"kind": kind, "named": float(named), "against": float(against)}
        if kind == 0:
            f |= {"length": rng.randint(12, 40), "bracket": 1.0, "groups": rng.randint(2, 4), "digits": rng.choice((0, 0, 2))}
            real = real or not against
        elif kind == 1:
            f |= {"length": rng.randint(15, 39), "digits": rng.randint(4, 28), "groups": 8, "same_separators": 1.0}
            real = real or not against
        elif kind == 2:
            digits = _card(rng) if real else "".join(rng.choice("0123456789") for _ in range(16))
            f |= {"length": 19, "digits": 16, "groups": 4, "luhn": float(_luhn(digits)), "same_separators": float(rng.random() < (0.95 if real else 0.5))}
            real = bool(f["luhn"]) and not (against and not named)
        elif kind == 4:
            # Credentials are assigned to a name; other long runs are identifiers, paths and digests.
            length = rng.randint(20, 80)
            f |= {"length": length, "digits": rng.randint(length // 6, length * 2 // 3), "groups": rng.choice((1, 1, 2, 3)), "same_separators": 1.0}
            real = named
        else:
            f |= {"length": rng.randint(10, 18), "digits": rng.randint(10, 14) if real else rng.randint(8, 16), "groups": rng.randint(2, 5)}
            f |= {"leading_zero": float(rng.random() < 0.5), "bracket": float(rng.random() < (0.5 if real else 0.1)), "same_separators": float(rng.random() < 0.7)}
            real = 9 <= f["digits"] <= 15 and (named or (bool(f["bracket"]) and not against and rng.random() < 0.97))
        out.append((f, int(real)))
    return out


@dataclass(frozen=True)
class Tree:
    """A split (feature, value, left for smaller, right) or a leaf (value)."""

    value: float = 0.0
    feature: str | None = None
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, f: dict[str, float]) -> float:
        node = self
        while node.feature is not None:
            node = node.left if f[node.feature] < node.value else node.right
        return node.value

    def column(self, features: dict[str, Column]) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(features[self.feature] < self.value, self.left.column(features)).otherwise(self.right.column(features))


def _grow(rows: list[tuple[dict[str, float], float, float]], depth: int) -> Tree:
    """A tree on (features, gradient, hessian) by the gain of second order boosting."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Tree(SHRINK * g / (h + 1))
    if depth == 0 or len(rows) < 20:
        return leaf
    best = (1e-6, None, 0.0)
    for name in FEATURES:
        ordered = sorted(rows, key=lambda r: r[0][name])
        gl = hl = 0.0
        for (f, rg, rh), (after, _, _) in zip(ordered, ordered[1:], strict=False):
            gl, hl = gl + rg, hl + rh
            if after[name] > f[name]:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, name, (f[name] + after[name]) / 2)
    _, name, cut = best
    if name is None:
        return leaf
    return Tree(cut, name, _grow([r for r in rows if r[0][name] < cut], depth - 1), _grow([r for r in rows if r[0][name] >= cut], depth - 1))


Model = tuple[tuple[Tree, ...], tuple[float, ...]]
Example = tuple[dict[str, float], int, float]


def train(weak: list[Example] = (), count: int = 1500, seed: int = 5) -> Model:
    """(trees, threshold by kind) from generated and weakly labelled examples (features, label, weight).

    Weak examples alternate between learning and calibration; together they
    weigh as much as the generated ones at most.
    """
    import math

    share = min(1.0, count / max(1.0, sum(w for *_, w in weak) / 2))
    mine = [(f, y, 1.0) for f, y in generated(count, seed)] + [(f, y, w * share) for f, y, w in weak[::2]]
    margins = [0.0] * len(mine)
    trees = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        tree = _grow([(f, w * (y - q), w * q * (1 - q)) for (f, y, w), q in zip(mine, p, strict=True)], DEPTH)
        trees.append(tree)
        margins = [m + tree.predict(f) for m, (f, _, _) in zip(margins, mine, strict=True)]
    held = [(f, y, 1.0) for f, y in generated(2 * count, seed + 1)] + [(f, y, w * share) for f, y, w in weak[1::2]]
    scored = [(sum(t.predict(f) for t in trees), y, w, f["kind"]) for f, y, w in held]
    return tuple(trees), tuple(_cut(sorted(((s, y, w) for s, y, w, k in scored if k == kind), reverse=True)) for kind in range(len(_ALL)))


def _cut(scored: list[tuple[float, int, float]]) -> float:
    """The lowest margin above 0 from which on the precision is ``PRECISION``; equal margins are told together."""
    cut, hits, total = scored[0][0] + 1.0 if scored else 1.0, 0.0, 0.0
    for i, (s, y, w) in enumerate(scored):
        hits, total = hits + w * y, total + w
        if s > 0 and hits >= PRECISION * total and (i + 1 == len(scored) or scored[i + 1][0] < s):
            cut = s
    return cut - 1e-9


@functools.cache
def model() -> Model:
    """What is known without documents: trained on generated examples alone."""
    return train()


def quality(fitted: Model, examples: list[Example]) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind among labelled examples that are no part of the training."""
    trees, cuts = fitted
    out = {}
    for k, name in enumerate(_ALL):
        told = [(sum(t.predict(f) for t in trees) > cuts[k], y, w) for f, y, w in examples if f["kind"] == k]
        hit, said, real = (sum(w for p, y, w in told if ok(p, y)) for ok in (lambda p, y: p and y, lambda p, y: p, lambda p, y: y))
        out[name] = (hit / said if said else 1.0, hit / real if real else 1.0)
    return out


# --- expressions --------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """Sums of all elements before each one, by blocks of sqrt(n) elements."""
    empty = F.expr("cast(array() as array<int>)")

    def before(values: Column) -> Column:
        """Sums before each element, one by one."""
        state = F.struct(F.lit(0).alias("sum"), empty.alias("out"))
        return F.aggregate(
            values, state, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"]
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def sums(values: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), width)
        blocks = F.transform(starts, lambda s: F.slice(values, s, width))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, before(F.transform(b, total)), lambda x, s: F.transform(before(x), lambda y: y + s))))

    return let(lengths, sums)


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut_out(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text in ``pieces_of``: only the pieces between are looked at."""
    part = lambda c: F.substring(F.get(pieces, c), F.greatest(a - c * PIECE, F.lit(0)) + 1, F.least(b - c * PIECE, F.lit(PIECE)) - F.greatest(a - c * PIECE, F.lit(0)))
    first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
    return F.when(b > a, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def folded(values: Column, state: Column, step: Callable[[Column, Column], Column], emitted: str) -> Column:
    """struct(state, out): ``step(state, x)`` gives struct(state, emit), and what it emits (arrays of type ``emitted``) is joined.

    Values are taken in blocks of sqrt(n), so that what is joined so far is not copied at every step.
    """
    none = F.expr(f"cast(array() as array<{emitted}>)")

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), width), lambda s: F.slice(v, s, width))

    def one(a: Column, x: Column) -> Column:
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["emit"]).alias("out")))

    def block(a: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(a["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{emitted}>>)").alias("outs"))
    return F.aggregate(let(values, blocks), start, block, lambda a: F.struct(a["state"].alias("state"), F.flatten(a["outs"]).alias("out")))


def counts_below(points: Column, marks: Column, strict: bool) -> Column:
    """How many of ``points`` lie below (``strict``) or not above each of ``marks``, in the order of the marks."""
    point, mark = (1, 0) if strict else (0, 1)
    events = F.array_sort(F.concat(
        F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(point).alias("k"), F.lit(-1).alias("i"))),
        F.transform(marks, lambda q, i: F.struct(q.alias("at"), F.lit(mark).alias("k"), i.alias("i"))),
    ))

    def ranked(e: Column) -> Column:
        below = running(F.transform(e, lambda x: (x["i"] < 0).cast("int")))
        asked = F.filter(F.zip_with(e, below, lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))), lambda x: x["i"] >= 0)
        return F.transform(F.array_sort(asked), lambda x: x["n"])

    return let(events, ranked)


def matches(text: Column, pattern: str, hint: str | None) -> Column:
    """Array of (s, e, m): code point spans and strings of the matches of ``pattern``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("m")))

    def spans(pairs: Column) -> Column:
        starts = running(F.transform(pairs, lambda p: p["gap"] + p["len"]))
        return F.zip_with(pairs, starts, lambda p, s: F.struct((s + p["gap"]).alias("s"), (s + p["gap"] + p["len"]).alias("e"), p["m"].alias("m")))

    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    there = text.rlike(pattern)
    if hint is not None:
        there = F.contains(text, F.lit(hint)) & there
    return F.when(there, let(F.filter(pairs, lambda p: p["m"].isNotNull()), spans)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_base(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        # Numbers up to 255; leading zeros do not change them.
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _span(kind: str, s: Column, e: Column, score: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(_ALL.index(kind)).alias("k"), e.alias("e"), score.alias("p"))


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind], HINT[kind]), lambda x: _is_base(kind, x["m"]))
    return F.transform(found, lambda x: _span(kind, x["s"], x["e"], F.lit(1000.0)))


def _features(kind: str, x: Column, before: Column) -> dict[str, Column]:
    m = x["m"]
    seps = F.regexp_extract_all(m, F.lit("[^0-9A-Za-z]+"), F.lit(0))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "kind": F.lit(float(_ALL.index(kind))),
        "length": F.length(m).cast("double"),
        "digits": F.length(_digits(m)).cast("double"),
        "groups": (F.size(seps) + 1).cast("double"),
        "luhn": one(F.call_function("luhn_check", _digits(m))) if kind == "card" else F.lit(0.0),
        "named": one(before.rlike(CONTEXT[kind])),
        "against": one(before.rlike(AGAINST)),
        "leading_zero": one(m.startswith("0")),
        "bracket": one(m.rlike(r"[\[({<]")),
        "same_separators": one(F.size(F.array_distinct(seps)) <= 1),
    }


def _with_features(pieces: Column, kind: str, found: Column, use: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """``use`` of each match and its features, which are computed once."""

    def told(x: Column) -> Column:
        before = let(cut_out(pieces, F.greatest(F.lit(0), x["s"] - BEFORE), x["s"]), lambda b: F.struct(*[c.alias(n) for n, c in _features(kind, x, b).items()]))
        return let(before, lambda f: use(x, {n: f[n] for n in FEATURES}))

    return F.transform(found, told)


def added_spans(pieces: Column, kind: str, found: Column, fitted: Model) -> Column:
    """Of the matches of a loose generator those whose boosted margin passes the kind's threshold, as spans."""
    trees, cuts = fitted
    margin = lambda x, f: _span(kind, x["s"], x["e"], functools.reduce(lambda a, t: a + t.column(f), trees, F.lit(0.0)))
    return F.filter(_with_features(pieces, kind, found, margin), lambda x: x["p"] > cuts[_ALL.index(kind)])


_SPAN = "struct<s:int,k:int,e:int,p:double>"


def _apart(spans: Column) -> Column:
    """Spans in order of start; of neighbours that overlap, the one with the higher score stays."""

    def step(last: Column, x: Column) -> Column:
        free = last["s"].isNull() | (x["s"] >= last["e"])
        out = F.when(free & last["s"].isNotNull(), F.array(last)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
        return F.struct(F.when(free | (x["p"] > last["p"]), x).otherwise(last).alias("state"), out.alias("emit"))

    kept = folded(F.array_sort(spans), F.expr(f"cast(null as {_SPAN})"), step, _SPAN)
    return let(kept, lambda r: F.when(r["state"].isNull(), r["out"]).otherwise(F.concat(r["out"], F.array(r["state"]))))


def _free(loose: Column, base: Column) -> Column:
    """The loose spans that overlap no base span: as many of those begin before its end as end before its start."""
    begun = counts_below(F.transform(base, lambda b: b["s"]), F.transform(loose, lambda x: x["e"]), strict=True)
    over = counts_below(F.transform(base, lambda b: b["e"]), F.transform(loose, lambda x: x["s"]), strict=False)
    marked = F.zip_with(loose, F.zip_with(begun, over, lambda a, b: a == b), lambda x, ok: F.struct(x.alias("x"), ok.alias("ok")))
    return F.transform(F.filter(marked, lambda y: y["ok"]), lambda y: y["x"])


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def weak_examples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = SAMPLE_ROWS) -> list[Example]:
    """Matches of the base patterns in a sample of the texts: (features, whether they meet the definition, texts that have such a one).

    Rows with equal features are one example; at most ``most`` come to the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64(text).alias("h"))
    every = max(1, (hashed.agg(F.approx_count_distinct("h")).first()[0] or 0) // sample_docs)
    some = hashed.where(F.pmod(F.col("h"), F.lit(every)) == 0)
    t = F.col("text")
    some = some.select("h", "text", pieces_of(t).alias("pieces"), *[matches(t, BASE[k], HINT[k]).alias(f"m_{k}") for k in KINDS])
    told = lambda k: lambda x, f: F.struct(_is_base(k, x["m"]).cast("int").alias("y"), *[f[n].alias(n) for n in FEATURES])
    # A run of digits that is too short or long for a card is no proposal.
    fit_in = lambda k: F.filter(F.col(f"m_{k}"), lambda x: F.length(_digits(x["m"])).between(14, 19)) if k == "card" else F.col(f"m_{k}")
    rows = some.select("h", F.explode(F.concat(*[_with_features(F.col("pieces"), k, fit_in(k), told(k)) for k in KINDS])).alias("r")).select("h", "r.*")
    counted = rows.groupBy("y", *FEATURES).agg(F.count_distinct("h").alias("n")).orderBy(F.desc("n"), "y", *FEATURES).limit(most)
    return [({n: r[n] for n in FEATURES}, r["y"], float(r["n"])) for r in counted.collect()]


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds that have seen the formats and contexts of the documents."""
    return train(weak_examples(docs))


def find(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """One row per document: doc_id, text, n_<kind>, base, added and secrets (arrays of spans: s, k, e, p)."""
    fitted = fitted or model()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    rows = rows.select("doc_id", "text", *[base_spans(t, k).alias(f"base_{k}") for k in KINDS], *[matches(t, p, None).alias(f"match_{i}") for i, (_, p) in enumerate(LOOSE)])
    some = functools.reduce(lambda a, b: a | b, [F.size(f"match_{i}") > 0 for i in range(len(LOOSE))])
    rows = rows.withColumn("pieces", F.when(some, pieces_of(t)).otherwise(F.expr("cast(array() as array<string>)")))
    told = {i: added_spans(F.col("pieces"), k, F.col(f"match_{i}"), fitted) for i, (k, _) in enumerate(LOOSE)}
    rows = rows.select(
        "doc_id", "text", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*[F.col(f"base_{k}") for k in KINDS]).alias("base"),
        F.concat(*[told[i] for i, (k, _) in enumerate(LOOSE) if k != SECRET]).alias("loose"), F.concat(*[told[i] for i, (k, _) in enumerate(LOOSE) if k == SECRET]).alias("lone"),
    )
    added = F.when(F.size("loose") > 0, _apart(_free(F.col("loose"), F.col("base")))).otherwise(F.col("loose"))
    rows = rows.withColumn("added", added)
    secrets = F.when(F.size("lone") > 0, _free(F.col("lone"), F.concat("base", "added"))).otherwise(F.col("lone"))
    return rows.select("doc_id", "text", *[f"n_{k}" for k in KINDS], "base", "added", secrets.alias("secrets"))


def redact(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """(doc_id, text): each maximal stretch of personal data is replaced by ``[KIND]``."""
    found = find(docs, fitted).withColumn("spans", F.array_sort(F.concat("base", "added", "secrets"))).withColumn("pieces", F.when(F.size("spans") > 0, pieces_of(F.col("text"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in _ALL])

    def step(at: Column, x: Column) -> Column:
        new = F.when(x["s"] >= at, F.array(cut_out(F.col("pieces"), at, x["s"]), F.get(names, x["k"]))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(at, x["e"]).alias("state"), new.alias("emit"))

    done = let(folded(F.col("spans"), F.lit(0), step, "string"), lambda r: F.concat(F.array_join(r["out"], ""), cut_out(F.col("pieces"), r["state"], F.length("text"))))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(done).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    spans = F.concat("base", "added")
    return find(docs, fit(docs)).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"), ((F.size(spans) > 0) | (F.size("secrets") > 0)).alias("private"),
    )
