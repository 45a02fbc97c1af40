"""Event-time operators, an extension: windows, sessions, duplicates within a delay, and running totals per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark; times without a zone are read as UTC, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    w = timed(events, delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    w = timed(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("first_ts"), "n")


def without_duplicates(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return timed(events, delay).dropDuplicatesWithinWatermark(["event_id"])


class _Totals(StatefulProcessor):
    """Count and sum of each key so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for f in rows:
            n, total = n + len(f), total + float(f["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after every batch that has events of a user; needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(_Totals(), "user_id bigint, n bigint, total double", "Update", "None")
