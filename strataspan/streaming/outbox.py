"""Streams: publication of admitted documents in micro-batches, windows with late data, exposure cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataspan.sources.tables import TableStore


def publish_stream(admitted: DataFrame, store: TableStore, handlers: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str) -> StreamingQuery:
    """Runs each index handler on every micro-batch; the batch id is the generation. Index tables are written first, the generation is published last, and
    a repeated batch overwrites its own generation: readers see whole generations, once each."""

    def one(batch: DataFrame, generation: int) -> None:
        for name, build in handlers.items():
            store.append(name, build(batch), generation)
        store.publish(generation)

    return admitted.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent(requests: DataFrame, event_time: str = "ts", key: str = "request_id", late: str = "1 hour") -> DataFrame:
    """The first of requests with one key within the watermark."""
    return requests.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by hour and event_type, tumbling or sliding, rows later than the watermark being dropped."""
    w = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def not_surfaced_recently(hints: DataFrame, cooldown_ms: int = 86_400_000) -> DataFrame:
    """Of hints (session_id, document_id, at_ms), those that their session hasn't seen within the cooldown; the last time is kept as state by key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(t for b in batches for t in b["at_ms"]):
            if last is None or at - last >= cooldown_ms:
                out.append((*key, at))
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["session_id", "document_id", "at_ms"])

    return hints.groupBy("session_id", "document_id").applyInPandasWithState(step, "session_id string, document_id long, at_ms long", "last long", "append", GroupStateTimeout.NoTimeout)
