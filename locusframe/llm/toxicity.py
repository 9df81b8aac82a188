"""Toxicity by classifier chains over labelled documents.

A chain predicts its categories one after the other; each is a logistic model
on the words of the text, on the beginnings of its words (so that inflected and
compound forms count) and on the probabilities of the categories before it.
In training those probabilities are out of fold: each document's comes from a
model that did not see it, so later links learn from what they will be given.
Thresholds are set on out-of-fold probabilities, for the best F1.

Training reads a bounded sample of labelled documents (``SAMPLE_DOCS``, those with
the smallest hashes of doc_id, up to ``SAMPLE_CHARS`` characters in all) and keeps
``VOCAB`` words and beginnings at most. Scoring reads whole texts, of any length,
once, in batches and without a shuffle; the model has a fixed size.

Defined results: null or wordless texts get the probabilities of a text without
known words, and are never flagged; without labels of both kinds, so with an
empty table of labels, a category has probability 0. Labels may be null for some
categories; of several for one doc_id the highest counts. Repeated rows are
scored alike; null ids stay null. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read_table

SAMPLE_DOCS, SAMPLE_CHARS, VOCAB, FOLDS = 5000, 50_000_000, 800, 3
STEPS, RATE, DECAY = 200, 0.1, 3e-4
#: Standard errors by which a feature's log odds must exceed 0.
LEAST_Z = 3.5
#: Lengths of the beginnings of words that count as features.
PREFIXES = (4, 5, 6, 7)
#: Entries of a worker's memo of words before it is emptied.
MEMO = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word, and its beginnings (marked by a hyphen)."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def with_repeats(found: Iterable[str]) -> set[str]:
    """Features of the words of a text; beginnings that two different words share count once more (``-2``)."""
    counts = Counter(found)
    return counts.keys() | {f"{f}2" for f, n in counts.items() if n > 1 and f[-1] == "-"}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows; both classes weigh alike."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    for step in range(1, STEPS + 1):
        d = (_sigmoid(x @ w + b) - y) * weight
        g = np.append(x.T @ d + DECAY * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1].astype(np.float32)
        b -= move[-1]
    return w, float(b)


@dataclass
class Link:
    name: str
    weights: dict[str, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    bias: float = -30.0
    threshold: float = 0.5


@dataclass
class Chain:
    links: list[Link]

    def __post_init__(self):
        # Words and beginnings with a weight, be it for their first or (-2) a further occurrence.
        self._names = sorted({f[:-1] if f.endswith("-2") else f for link in self.links for f in link.weights})
        self._at = {f: i for i, f in enumerate(self._names)}
        self._once = [np.array([link.weights.get(f, 0.0) for f in self._names]) for link in self.links]
        self._twice = [np.array([link.weights.get(f"{f}2", 0.0) if f.endswith("-") else 0.0 for f in self._names]) for link in self.links]
        self._memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"links": self.links}

    def __setstate__(self, state):
        self.links = state["links"]
        self.__post_init__()

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities of the categories, in order, for each text: (texts, categories)."""
        if len(self._memo) > MEMO:
            self._memo.clear()
        memo, found, sizes = self._memo, [], []
        for text in texts:
            at = len(found)
            for w in word_set(text):
                own = memo.get(w)
                if own is None:
                    own = memo[w] = tuple(self._at[f] for f in features_of(w) if f in self._at)
                found += own
            sizes.append(len(found) - at)
        # Features of a text once, and those that two of its words share once more.
        keys, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(self._names) + np.array(found, np.int64), return_counts=True)
        doc, feature = np.divmod(keys, max(1, len(self._names)))
        again = counts > 1
        got = np.zeros((len(texts), len(self.links)))
        for i, link in enumerate(self.links):
            z = link.bias + got[:, :i] @ np.array(link.earlier[:i], np.float64)
            z = z + np.bincount(doc, self._once[i][feature], len(texts)) + np.bincount(doc[again], self._twice[i][feature[again]], len(texts))
            got[:, i] = _sigmoid(z)
        return got


def _vocabulary(words: list[set[str]], labels: dict[str, np.ndarray]) -> list[str]:
    """Features that tell the classes of some category apart best, by the z-score of their log odds; only evidence for a category counts."""
    best: Counter[str] = Counter()
    for y in labels.values():
        counts = (Counter(), Counter())
        for own, label in zip(words, y, strict=True):
            if label >= 0:
                counts[int(label)].update(with_repeats(f for w in own for f in features_of(w)))
        n = [max(1, int((y == k).sum())) for k in (0, 1)]
        for f, b in counts[1].items():
            a = counts[0][f]
            if a + b >= 3:
                odds = math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))
                z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
                if z >= LEAST_Z:
                    best[f] = max(best[f], z)
    return [f for f, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:VOCAB]]


def train_chain(texts: Sequence[str | None], labels: dict[str, Sequence[int | None]], folds: int = FOLDS) -> Chain:
    """A chain over the categories in the order of ``labels`` (0, 1 or None for each text).

    Of texts with the same words and labels one counts, so that copies neither
    lend weight to their words nor are out of fold and in sight at once.
    """
    rows = {}
    for i, text in enumerate(texts):
        own = word_set(text)
        marks = tuple(-1 if v is None or v != v else int(v > 0) for v in (col[i] for col in labels.values()))
        rows.setdefault((hash_words(own), len(own), marks), own)
    words = list(rows.values())
    marks = {k: np.array([key[2][j] for key in rows]) for j, k in enumerate(labels)}
    vocab = _vocabulary(words, marks)
    at = {f: i for i, f in enumerate(vocab)}
    x = np.zeros((len(words), len(vocab)), np.float32)
    for i, own in enumerate(words):
        x[i, [at[f] for f in with_repeats(f for w in own for f in features_of(w)) if f in at]] = 1
    fold = np.array([key[0] % 9973 % folds for key in rows], int)
    links, earlier = [], np.zeros((len(words), 0), np.float32)
    for name, y in marks.items():
        known = y >= 0
        link, out = Link(name), np.zeros(len(words), np.float32)
        if 0 < y[known].sum() < known.sum():
            features = np.hstack((x, earlier))
            out[:] = y[known].mean()  # where a fold's rest has one class only
            told = np.zeros(len(words), bool)
            for k in range(folds):
                seen, held = known & (fold != k), fold == k
                if held.any() and 0 < y[seen].sum() < seen.sum():
                    w, b = _logistic(features[seen], y[seen].astype(np.float32))
                    out[held], told[held] = _sigmoid(features[held] @ w + b), True
            w, b = _logistic(features[known], y[known].astype(np.float32))
            link.weights = {f: float(a) for f, a in zip(vocab, w[: len(vocab)], strict=True) if abs(a) > 1e-4}
            link.earlier, link.bias = [float(a) for a in w[len(vocab) :]], b
            if y[known & told].any():
                link.threshold = _best_threshold(out[known & told], y[known & told])
        else:
            link.earlier = [0.0] * earlier.shape[1]
        links.append(link)
        earlier = np.hstack((earlier, out[:, None]))
    return Chain(links)


def hash_words(words: set[str]) -> int:
    """A number that is the same for the same words, in every process."""
    import zlib

    return sum(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the best cut by F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 1e-6, 1 - 1e-6))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Chain:
    """A chain from documents and ``labels`` (doc_id and what the category columns need)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), *[c.cast("int").alias(k) for k, c in categories.items()]).where("id IS NOT NULL")
    # Of several labels of a document the higher counts.
    marked = marked.groupBy("id").agg(*[F.max(k).alias(k) for k in categories])
    total = marked.count()
    share = int((1 << 30) * min(1.0, 1.3 * sample_docs / max(1, total))) + 1
    h = F.xxhash64("id")
    # At most sample_docs narrow rows: a broadcast of known size.
    chosen = marked.where(F.pmod(h, F.lit(1 << 30)) < share).orderBy(h, "id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").withColumn("h", h).orderBy("h", "id", "text").limit(sample_docs)
    # Texts up to a bound in characters, in the same order; the window runs over those rows only.
    before = Window.orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sum", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where((F.col("sum") + F.coalesce(F.length("text"), F.lit(0))) <= sample_chars)
    got = rows.orderBy("h", "id", "text").collect()
    return train_chain([r["text"] for r in got], {k: [r[k] for r in got] for k in categories})


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: doc_id, and p_<category> and is_<category> for each category."""
    names = [link.name for link in chain.links]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = "doc_id long, " + ", ".join(f"p_{k} double, is_{k} boolean" for k in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = np.array([link.threshold for link in shared.value.links])
        for b in batches:
            p = shared.value.probabilities(b["text"].tolist())
            there = np.array([bool(t) and _WORD.search(t) is not None for t in b["text"]], bool)
            out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64")})
            for i, k in enumerate(names):
                out[f"p_{k}"] = p[:, i]
                out[f"is_{k}"] = (p[:, i] >= cuts[i]) & there
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    chain = fit(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score(docs, chain)
