"""Streams of entity events: running state per entity, and slot snapshots with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "value string, rev long"
OUTPUT = "entity_id string, rev long, key string, value string"


class EntityState(StatefulProcessor):
    """Keeps each entity's fields and revision; emits the fields that an event changes. Events of a batch are
    applied by ``(ts, event_id)``; one that does not come after the last applied one is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "key string", "value string")
        self.last = handle.getValueState("last", "rev long, ts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        rev, *seen = self.last.get() if self.last.exists() else (0, -(1 << 63), -1)
        seen, out = tuple(seen), []
        for event in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at = (pd.Timestamp(event.ts).value, event.event_id)
            if at <= seen:
                continue
            rev, seen = rev + 1, at
            self.fields.updateValue((event.field,), (event.value,))
            out.append((key[0], rev, event.field, event.value))
        self.last.update((rev, *seen))
        yield pd.DataFrame(out, columns=["entity_id", "rev", "key", "value"])

    def close(self) -> None:
        pass


def follow(events: DataFrame) -> DataFrame:
    """Changes of a stream of ``entity_id string, ts, event_id long, field, value``."""
    return events.groupBy("entity_id").transformWithStateInPandas(EntityState(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def slot_counts(events: DataFrame, *, late: str = "10 minutes", slot: str = "8 hours") -> DataFrame:
    """Events of each type in each slot, closed when the watermark passes it. ``ts`` must be a timestamp with time zone."""
    w = F.window("ts", slot)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("slot"), "event_type", "n")


def upsert_latest(batch: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """For ``foreachBatch``: adds the batch's last row of each key; ``latest`` over the folder gives the current rows, so a batch that is
    repeated after a failure changes nothing."""
    from quire.operators.paging import latest

    latest(batch, by, order).write.mode("append").parquet(path)
