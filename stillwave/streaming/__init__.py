"""Chunk statistics and triggers over a stream: an addition, for the reference has only bounded runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def chunk_statistics(samples: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Statistics by window and channel of a streaming (or bounded) frame. Samples later than
    ``late`` behind the newest are dropped, so a window's state can be let go."""
    x = F.col(value)
    grouped = samples.withWatermark(time, late).groupBy(F.window(time, window), key)
    out = grouped.agg(
        F.count(x).alias("npts"), (F.sum(x * x) / F.count(x)).alias("energy"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
    )
    return out.select(F.col("window.start").alias("starttime"), F.col("window.end").alias("endtime"), key, "npts", "energy", "min", "max", "mean", "variance", "skewness", "kurtosis")


EVENTS = "start timestamp, stop timestamp, npts long, peak double"


class Hysteresis(StatefulProcessor):
    """One key's triggers over micro-batches: samples that the watermark hasn't passed wait, the
    others are taken in order of time (of equal times, of their values), and an event that is
    open is carried on. Timers wake a key whose samples the watermark has passed meanwhile."""

    def __init__(self, key: str, on: float, off: float):
        self.key, self.on, self.off = key, on, off

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, stop long, npts long, peak double")
        self.waiting = handle.getListState("waiting", "at long, value double")

    def _taken(self, key, waiting: list[tuple[int, float]], watermark_ms: int) -> Iterator[pd.DataFrame]:
        ready = sorted(r for r in waiting if r[0] <= watermark_ms * 1000)
        rest = [r for r in waiting if r[0] > watermark_ms * 1000]
        now, done = self.open.get() if self.open.exists() else None, []
        for at, value in ready:
            if now is not None and value > self.off or value > self.on:
                start, _, n, peak = now or (at, at, 0, 0.0)
                now = (start, at, n + 1, max(peak, abs(value)))
            elif now is not None:
                done.append(now)
                now = None
        if ready:
            if now is None:
                self.open.clear()
            else:
                self.open.update(now)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if done:
            times = [pd.to_datetime([d[i] for d in done], unit="us") for i in range(2)]
            yield pd.DataFrame({self.key: [key[0]] * len(done), "start": times[0], "stop": times[1], "npts": [d[2] for d in done], "peak": [d[3] for d in done]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for frame in rows:
            waiting += zip(frame["at"].tolist(), frame["value"].tolist(), strict=True)
        yield from self._taken(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._taken(key, waiting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def triggers(samples: DataFrame, on: float, off: float, late: str = "1 hour", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Events of a stream by key: ``start`` and ``stop`` (first and last sample), ``npts`` and
    ``peak`` (largest size), from a sample above ``on`` until one at or below ``off``.

    Samples may come in any order within ``late`` of the newest; they are judged once the
    watermark has passed them, so the events are those of the sorted sequence. Later ones are
    dropped. Samples that are null or NaN, or have no time, decide nothing and are left out. An
    event is given out when it ends; one that is open waits for its end. The session must keep
    state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    if off > on:
        raise ValueError("off must not exceed on")
    v = F.col(value).cast("double")
    rows = samples.withWatermark(time, late).filter(F.col(time).isNotNull() & v.isNotNull() & ~F.isnan(v))
    rows = rows.select(key, time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), v.alias("value"))
    kind = samples.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Hysteresis(key, on, off), f"{key} {kind}, {EVENTS}", "Append", "EventTime")
