"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of ``WINDOW`` bytes. The network looks at runs of
2, 3 and 4 bytes with ``FILTERS`` filters for each width (a filter is a table of
256 weights for each of its positions, the convolution of one-hot bytes), takes
the maximum over the window after a ramp, and maps that to language scores by a
softmax layer. It is trained by Adam on windows of labelled texts; the maximum
passes a gradient to one position for each filter only, so a step is cheap.
The score of a text is the mean of the probabilities of its windows, weighted by
their bytes; every byte of the text is in a window.

Training reads a bounded sample of labelled rows: ``SAMPLE_DOCS`` distinct texts
of each label at most, ``SAMPLE_BUDGET`` in all (but ``LEAST_DOCS`` of each label,
however many labels there are), three windows of each, those with the smallest
hashes. Every label that is not null is learned.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any labelled row every text is ``und``. Texts of any length are read
whole. Repeated rows are predicted alike; null ids stay null. Of labels with
equal probability the first in order counts. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import give_back, packed, read_table, slices

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
SAMPLE_DOCS, SAMPLE_BUDGET, LEAST_DOCS = 1200, 24_000, 8
STEPS, BATCH, RATE, SEED = 700, 96, 0.01, 11
#: Further steps for each label beyond the first eight.
STEPS_PER_LANG = 20
#: Documents whose crc32(doc_id) leaves this remainder by 4 are never learned from.
HELD_OUT = 2
UNKNOWN = "und"

#: ASCII letters count in lower case; other bytes as they are.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLOCK = 256  # windows handled at once


def windows_of(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes; the last window is padded with spaces."""
    data = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    count = max(1, -(-len(data) // WINDOW))
    out = np.full(count * WINDOW, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(count, WINDOW)


class ByteCnn:
    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self._pairs: list[list[np.ndarray]] | None = None

    def params(self) -> list[np.ndarray]:
        return [*(t for tables in self.tables for t in tables), self.bias, self.out, self.out_bias]

    def _conv(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter values at each position, for each width: (windows, positions, FILTERS)."""
        out = []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - w + 1
            v = tables[0][x[:, :n]]
            for k in range(1, w):
                v += tables[k][x[:, k : k + n]]
            out.append(v)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE) -> None:
        rng = np.random.default_rng(SEED)
        params = self.params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        for step in range(1, steps + 1):
            # Languages count alike, however many texts they have.
            picked = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(by_lang), batch)])
            xb, yb = x[picked], y[picked]
            tops, peaks = [], []
            for values in self._conv(xb):
                at = values.argmax(axis=1)
                peaks.append(at)
                tops.append(np.take_along_axis(values, at[:, None, :], 1)[:, 0])
            pre = np.concatenate(tops, 1) + self.bias
            hidden = np.maximum(pre, 0)
            p = _softmax(hidden @ self.out + self.out_bias)
            d = p.copy()
            d[np.arange(batch), yb] -= 1
            d /= batch
            d_hidden = (d @ self.out.T) * (pre > 0)
            grads: list[np.ndarray] = []
            for i, (w, at) in enumerate(zip(WIDTHS, peaks, strict=True)):
                g = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    table = np.zeros((256, FILTERS), np.float32)
                    np.add.at(table, (np.take_along_axis(xb, at + k, 1), np.arange(FILTERS)[None, :]), g)
                    grads.append(table)
            grads += [d_hidden.sum(0), hidden.T @ d + 1e-4 * self.out, d.sum(0)]
            scale = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p_, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p_ -= scale * a / (np.sqrt(b) + 1e-8)
        self._pairs = None

    def _pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, one table over byte pairs for each two positions (the last may be single)."""
        if self._pairs is None:
            self._pairs = [
                [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) if k + 1 < w else t[k] for k in range(0, w, 2)]
                for w, t in zip(WIDTHS, self.tables, strict=True)
            ]
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of windows."""
        out = []
        for i in range(0, len(x), _BLOCK):
            b = x[i : i + _BLOCK]
            pairs = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            tops = []
            for w, tables in zip(WIDTHS, self._pair_tables(), strict=True):
                n = WINDOW - w + 1
                v = None
                for k, t in zip(range(0, w, 2), tables, strict=True):
                    part = np.take(t, pairs[:, k : k + n] if k + 1 < w else b[:, k : k + n], axis=0)
                    v = part if v is None else np.add(v, part, out=v)
                tops.append(v.max(axis=1))
            out.append(_softmax(np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, probability) of each whole text; windows of all texts are handled in batches."""
        result: list[tuple[str, float]] = []
        held: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        count = 0

        def flush() -> None:
            p = self.probabilities(np.concatenate(held))
            at = 0
            for w in weights:
                mean = w @ p[at : at + len(w)] / w.sum()
                at += len(w)
                best = int(mean.argmax())
                result.append((self.langs[best], float(min(1.0, mean[best]))))

        for text in texts:
            x = windows_of(text)
            size = len(text.encode("utf-8", "surrogatepass"))
            w = np.full(len(x), WINDOW, np.float64)
            w[-1] = max(1, size - WINDOW * (len(x) - 1))
            held.append(x)
            weights.append(w)
            count += len(x)
            if count >= 4096:
                flush()
                held, weights, count = [], [], 0
        if held:
            flush()
        return result


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, budget: int = SAMPLE_BUDGET, steps: int | None = None) -> ByteCnn | None:
    """A network from (text, lang); None if nothing is labelled.

    Of each label the distinct texts with the smallest hashes count: the same
    ones however often they are copied and however the table is laid out.
    """
    h = F.xxhash64("text")
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    # One row for each label comes to the driver.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not counts:
        return None
    each = max(LEAST_DOCS, min(sample_docs, budget // len(counts)))
    space = 1 << 30
    # Texts of a label whose hash is under its bound are a few more than wanted (the counts are right to a twentieth).
    bounds = [(k, min(space, int(space * (1.3 * each + 50) / n) + 1)) for k, n in counts.items()]
    width = F.lit(WINDOW * 2)

    def cut(i: int):
        room = F.greatest(F.length("text") - width, F.lit(0)) + 1
        return F.substring("text", F.pmod(F.xxhash64("text", F.lit(i)), room.cast("long")).cast("int") + 1, width)

    # Whole texts stay on the executors; three pieces of bounded length come to the driver.
    few = labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")
    near = rows.withColumn("h", h).join(F.broadcast(few), "lang").where(F.pmod("h", F.lit(space)) < F.col("bound"))
    pieces = near.select("lang", "h", *[cut(i).alias(f"c{i}") for i in range(3)]).groupBy("lang", "h").agg(*[F.min(f"c{i}").alias(f"c{i}") for i in range(3)])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(space)), "h")
    chosen = pieces.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    langs = sorted(counts)
    x, y = [], []
    place = {k: i for i, k in enumerate(langs)}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["n"])):
        for piece in [r["c0"]] if len(r["c0"]) < 2 * WINDOW else [r["c0"], r["c1"], r["c2"]]:
            x.append(windows_of(piece)[0])
            y.append(place[r["lang"]])
    model = ByteCnn(langs)
    model.train(np.stack(x), np.array(y), STEPS + STEPS_PER_LANG * max(0, len(langs) - 8) if steps is None else steps)
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score. Only the text is looked at."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(text.rlike(r"\p{L}"), text).alias("text"),  # null: nothing to predict from
    )
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kB, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            there = b["text"].notna().to_numpy()
            found = iter(shared.value.predict(b["text"][there].tolist()))
            result = [next(found) if t else (UNKNOWN, 0.0) for t in there]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "lang_pred": [r[0] for r in result], "score": [r[1] for r in result],
            })

    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double")


def predict_rows(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(row, lang, score): the verdict beside each row's struct of columns; no join, so repeated rows and null ids keep theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            result = []
            for part in slices(batch):
                texts = part.to_pylist()
                found = iter(shared.value.predict([t for t in texts if t is not None]))
                result += [(UNKNOWN, 0.0) if t is None else next(found) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in result], pa.string()), pa.array([r[1] for r in result], pa.float64())], ["lang", "score"])
        give_back()

    text = F.col("text").cast("string")
    return packed(docs, verdict=verdict(F.when(text.rlike(r"\p{L}"), text))).select("row", "verdict.lang", "verdict.score")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def fit_unheld(docs: DataFrame) -> ByteCnn | None:
    """The network learned from the documents that are not held out."""
    return fit(docs.where(~held_out()).select("text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit_unheld(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
