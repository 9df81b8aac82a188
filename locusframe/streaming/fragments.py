"""Incremental forms: held-back fragments, first-seen reads, depth by window, and an order that must not go back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import order_violations


def first_seen(stream: DataFrame, event_time: str, delay: str, keys: tuple[str, ...] = ("fid", "readno")) -> DataFrame:
    """The first record of each fragment and read; state older than the watermark goes."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def whole_fragments(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Fragments (fid, reads, first, last, orphan), each emitted once the watermark has passed its last record.

    Records of a fragment are held back as counts and times only.
    """
    marked = stream.select("fid", "readno", F.col(event_time).alias("at")).withWatermark("at", delay)

    def close(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            mask, n, first, last = state.get
            state.remove()
            yield pd.DataFrame({"fid": [key[0]], "reads": [n], "first": [pd.Timestamp(first, unit="us")], "last": [pd.Timestamp(last, unit="us")], "orphan": [mask != 3]})
            return
        mask, n, first, last = state.get if state.exists else (0, 0, 1 << 62, -(1 << 62))
        for b in batches:
            at = b["at"].astype("datetime64[us]").astype("int64")
            mask |= int(sum(1 << int(r) for r in set(b["readno"])))
            n, first, last = n + len(b), min(first, int(at.min())), max(last, int(at.max()))
        state.update((mask, n, first, last))
        state.setTimeoutTimestamp(max(last // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"fid": [], "reads": [], "first": pd.Series([], dtype="datetime64[us]"), "last": pd.Series([], dtype="datetime64[us]"), "orphan": pd.Series([], dtype=bool)}).astype({"fid": "int64", "reads": "int64"})

    return marked.groupBy("fid").applyInPandasWithState(
        close, "fid long, reads long, first timestamp, last timestamp, orphan boolean", "mask int, n long, first long, last long", "append", "EventTimeTimeout"
    )


def depth_by_window(stream: DataFrame, event_time: str, delay: str, width: str, key: str) -> DataFrame:
    """Records by window of event time and key, final once the watermark has passed."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def pending_mates(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Mates (fid, k, first, second: their times) as soon as both reads came; what the watermark has passed alone comes with a null.

    The k-th read 0 of a fragment goes with its k-th read 1; only unpaired times
    are held back, and a fragment's state goes when nothing is pending.
    """
    marked = stream.select("fid", F.col("readno").cast("int").alias("readno"), F.col(event_time).alias("at")).withWatermark("at", delay)
    names = ["fid", "k", "first", "second"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names).astype({"fid": "int64", "k": "int64"})
        return out.assign(**{c: pd.to_datetime(out[c], unit="us") for c in ("first", "second")})

    def match(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, sides = state.get if state.exists else (0, ([], []))
        sides = [list(sides[0]), list(sides[1])]
        rows = []
        if not state.hasTimedOut:
            for b in batches:
                for readno, at in sorted(zip(b["readno"], b["at"].astype("datetime64[us]").astype("int64"), strict=True), key=lambda x: x[1]):
                    sides[readno & 1].append(int(at))
        while sides[0] and sides[1]:
            done += 1
            rows.append((key[0], done, sides[0].pop(0), sides[1].pop(0)))
        if state.hasTimedOut:
            for side in (0, 1):
                for at in sides[side]:
                    done += 1
                    rows.append((key[0], done, at if side == 0 else None, at if side == 1 else None))
            sides = [[], []]
        if sides[0] or sides[1]:
            state.update((done, (sides[0], sides[1])))
            state.setTimeoutTimestamp(max(max(sides[0] + sides[1]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield frame(rows)

    return marked.groupBy("fid").applyInPandasWithState(
        match, "fid long, k long, first timestamp, second timestamp", "done long, sides struct<a:array<long>,b:array<long>>", "append", "EventTimeTimeout"
    )


def sliding_consensus(stream: DataFrame, reach: int) -> DataFrame:
    """(contig, pos, depth, base, score): the commonest base of each position of a pileup stream (contig, pos, base), in order of position.

    Positions are final, and their counts leave the memory, once a base came
    ``reach`` positions later: the position is the event time. Of bases as common
    as each other the first of A, C, G and T counts; the score is the number by
    which it leads the next one.
    """
    timed = stream.select("contig", F.upper("base").alias("base"), F.timestamp_seconds(F.col("pos")).alias("at")).withWatermark("at", f"{reach} seconds")
    counts = timed.groupBy("contig", F.window("at", "1 second")).agg(*[F.sum((F.col("base") == b).cast("long")).alias(b) for b in "ACGT"])
    ranked = F.sort_array(F.array(*[F.struct(F.col(b).alias("n"), F.lit(-i).alias("o"), F.lit(b).alias("b")) for i, b in enumerate("ACGT")]), False)
    told = counts.select("contig", F.unix_seconds("window.start").alias("pos"), sum((F.col(b) for b in "CGT"), F.col("A")).alias("depth"), ranked.alias("r"))
    return told.select("contig", "pos", "depth", F.get("r", F.lit(0))["b"].alias("base"), (F.get("r", F.lit(0))["n"] - F.get("r", F.lit(1))["n"]).alias("score"))


class MonotoneSink:
    """A foreachBatch sink for rows that must not go back behind what was already written.

    Use as ``writeStream.foreachBatch(MonotoneSink("pos", write))``. Rows before
    the bound are an error (``late="error"``), are left out (``"drop"``), or go to a
    function (batch, epoch). With ``sequence``, a batch's own order is checked too.
    With ``store``, a folder that outlives the driver, the bound is kept there
    by epoch, and an epoch that comes again is held against the bound before it.
    """

    def __init__(self, key: str, write, late="error", sequence: str | None = None, store: str | None = None):
        self.key, self.write, self.late, self.sequence, self.store = key, write, late, sequence, store
        self.bound = None

    def _before(self, spark, epoch: int):
        if self.store is None:
            return self.bound
        try:
            kept = spark.read.schema("bound string, at long").json(f"{self.store}/*.json").where(F.col("at") < epoch)
            last = kept.orderBy(F.desc("at")).first()
        except AnalysisException:  # nothing is written yet
            return None
        return None if last is None else json.loads(last["bound"])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bound = self._before(spark, epoch)
        low, high = batch.agg(F.min(self.key), F.max(self.key)).first()
        if low is None:
            return
        if self.sequence is not None:
            wrong = order_violations(batch, self.sequence, self.key).select(self.key, "previous").first()
            if wrong is not None:
                raise ValueError(f"row {wrong[0]} after {wrong[1]} within a batch")
        if bound is not None and low < bound:
            if self.late == "error":
                raise ValueError(f"row {low} after everything up to {bound} was final")
            if callable(self.late):
                self.late(batch.where(F.col(self.key) < bound), epoch)
            batch = batch.where(F.col(self.key) >= bound)
        self.write(batch, epoch)
        self.bound = high if bound is None else max(bound, high)
        if self.store is not None:
            row = spark.createDataFrame([(json.dumps(self.bound), epoch)], "bound string, at long").coalesce(1)
            row.write.mode("overwrite").json(f"{self.store}/{epoch:012d}.json")
