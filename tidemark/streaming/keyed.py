"""The last arrival of each key over all micro-batches, by keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastArrival(StatefulProcessor):
    """Holds the arrival number of a key's newest row, and nothing else of it."""

    def __init__(self, arrival: str, expiry_ms: int | None):
        self.arrival, self.expiry_ms = arrival, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "arrival long", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        before = most = None if held is None else held[0]
        best = None
        for part in rows:
            at = part[self.arrival].idxmax()
            if most is None or part[self.arrival][at] > most:
                most, best = int(part[self.arrival][at]), part.loc[[at]]
        if best is not None and most != before:
            self.newest.update((most,))
            yield best

    def close(self) -> None:
        pass


def last_arrivals(rows: DataFrame, key: list[str], arrival: str = "ingest_seq", expiry_ms: int | None = None) -> DataFrame:
    """The row with the largest arrival number (a whole number) of each key; ties keep the one that came first.

    On a table: one row per key. On a stream (update mode): a row each time a newer arrival than any before it comes for
    its key, in whatever order and batch they come, so that a keyed upsert of what is handed on ends with the same rows. State is a number
    for each key; with expiry_ms a key is forgotten that long after its last newer arrival (processing time), and an older
    row which comes later than that counts as new. Rows without an arrival number are dropped. The stream needs the
    RocksDB state store.
    """
    rows = rows.where(F.col(arrival).isNotNull())
    if not rows.isStreaming:
        newest = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), arrival).alias("x")
        return rows.groupBy(*key).agg(newest).select("x.*")
    if rows.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    return rows.groupBy(*key).transformWithStateInPandas(_LastArrival(arrival, expiry_ms), rows.schema, "Update", "None" if expiry_ms is None else "ProcessingTime")
