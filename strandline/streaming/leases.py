"""Sightings of a key under a lease: the first one counts, each further one renews, and a pause longer than the lease makes the next count again.

A batch finds the earlier sighting of each row; a stream keeps the last sighting of each key as state, which expires with
the lease. Both give the same rows, as the stream puts a key's rows in order before it judges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key string, id long, ts timestamp"
_US = 1_000_000


def _rows(events: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """key as text, id and ts; a row without a key, an id or a time is no sighting."""
    return events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts")).dropna()


def leased_batch(events: DataFrame, key: str, order: str, time: str, seconds: int, part: int = 86_400) -> DataFrame:
    """key, id, ts of the rows whose key was not seen within `seconds` before; of rows at one time the least id comes first.

    A hot key is not one task: rows are ordered within a key's parts of `part` seconds, and only the last time of each part
    goes to the window over parts, whose number the covered time bounds.
    """
    rows = _rows(events, key, order, time).withColumn("_p", F.floor(F.unix_micros("ts") / (part * _US)))
    last = rows.groupBy("key", "_p").agg(F.max("ts").alias("_last"))
    before = last.select("key", "_p", F.lag("_last").over(W.partitionBy("key").orderBy("_p")).alias("_before"))
    own = F.lag("ts").over(W.partitionBy("key", "_p").orderBy("ts", "id"))
    seen = rows.withColumn("_own", own).join(before, ["key", "_p"]).withColumn("_seen", F.coalesce("_own", "_before"))
    return seen.where(F.col("_seen").isNull() | (F.unix_micros("ts") - F.unix_micros("_seen") > seconds * _US)).select("key", "id", "ts")


class Lease(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then judges them in order; the last sighting expires with the lease.

    The rows that wait are those between the watermark and the newest row, so the delay of the watermark bounds them. They
    are appended to the state, and a timer stands at the earliest of them, so one that fires goes through them once.
    """

    def __init__(self, seconds: int):
        self.lease = seconds * _US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, id long")
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            fresh = [(int(t), int(i)) for t, i in zip(us, pdf["id"]) if t > now * 1000]  # what the watermark has passed is late
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(self._ms(min(fresh)[0]))
        yield pd.DataFrame({"key": pd.Series(dtype=object), "id": pd.Series(dtype="int64"), "ts": pd.Series(dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = sorted((t, i) for t, i in waiting if t <= now), [(t, i) for t, i in waiting if t > now]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, i in due:
            if last is None or t - last > self.lease:
                out.append((t, i))
            last = t
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(self._ms(min(rest)[0]))
            self.last.update((last,))
            self.handle.registerTimer((last + self.lease) // 1000 + 1)
        elif last is not None and not waiting and last + self.lease < now:
            self.last.clear()
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "id": [i for _, i in out], "ts": pd.to_datetime(pd.Series([t for t, _ in out], dtype="int64"), unit="us")})

    @staticmethod
    def _ms(us: int) -> int:
        """The first millisecond that is not before a time."""
        return -(-us // 1000)

    def close(self) -> None:
        pass


def leased_stream(events: DataFrame, key: str, order: str, time: str, seconds: int, late: str) -> DataFrame:
    """The rows of `leased_batch` for a stream; a row later than the watermark is dropped. Needs the state store that keeps its state on disk."""
    rows = _rows(events, key, order, time).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Lease(seconds), SCHEMA, outputMode="Append", timeMode="EventTime")


def epoch_sample(rows: DataFrame, key: str, share: float, epoch: int, seed: int = 0) -> DataFrame:
    """A share of the rows drawn anew in each epoch: by a hash of key, epoch and seed, so that a repeated task draws the same rows. Null keys are drawn as one."""
    drawn = F.xxhash64(F.col(key), F.lit(epoch), F.lit(seed))
    return rows.where(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30)))


def epochs(stream: DataFrame, key: str, share: float, path: str, checkpoint: str, seed: int = 0) -> Callable:
    """Writer that samples each micro-batch with its number as epoch; a batch that is written again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        epoch_sample(batch, key, share, number, seed).write.mode("overwrite").parquet(f"{path}/epoch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
