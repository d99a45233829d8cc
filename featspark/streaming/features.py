"""Features on streams: fitted transforms run as they are; gaps and rolling windows keep state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def apply_fitted(stream: DataFrame, *fitted: Any) -> DataFrame:
    """Fitted numeric features on a stream: a stateless projection."""
    for step in fitted:
        stream = step.transform(stream)
    return stream


def stream_gaps(stream: DataFrame, key: str, ts: str = "ts", forget_after: str = "7 days") -> DataFrame:
    """key, ts, secs_since_last_obs by key, in order of time inside a batch. Rows older than the last one
    seen have a null gap; a key unseen for ``forget_after`` of event time is forgotten."""
    kept_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", forget_after)

    def work(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(parts)).sort_values("ts")
        gaps = []
        for t in batch["ts"]:
            now = t.value // 1000
            gaps.append(None if last is None or now < last else (now - last) // 1_000_000)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + 1, state.getCurrentWatermarkMs() + 1) + kept_ms)
        yield pd.DataFrame({"key": name[0], "ts": batch["ts"], "secs_since_last_obs": pd.array(gaps, "Int64")})

    return rows.groupBy("key").applyInPandasWithState(
        work, "key string, ts timestamp, secs_since_last_obs long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_rolling(stream: DataFrame, window: str, slide: str, key: str | None = None, ts: str = "ts", val: str = "val", horizon: str = "0 seconds") -> DataFrame:
    """[key,] start, end, n, mean, std, min, max over sliding windows; the watermark is the horizon, so a
    window is final once nothing newer than the horizon can still arrive."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", horizon)
    by = [F.window("_ts", window, slide).alias("w"), *([F.col(key)] if key else [])]
    out = rows.groupBy(*by).agg(F.count(val).alias("n"), F.avg(val).alias("mean"), F.stddev_samp(val).alias("std"), F.min(val).alias("min"), F.max(val).alias("max"))
    return out.select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "min", "max")
