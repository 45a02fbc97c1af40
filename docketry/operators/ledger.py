"""The append-only ledger: appending in order, and verifying in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.hashing import ENTRY_PREFIX, GENESIS, entry_hash, payload_hash

SCHEMA = "seq bigint, event_type string, payload string, created_micros bigint, payload_hash string, prev_hash string, entry_hash string"


def _chain(start: int, tip: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, previous = start, tip
        for f in frames:
            rows = []
            for kind, payload, micros in zip(f["event_type"], f["payload"], f["created_micros"], strict=True):
                seq += 1
                p = hashlib.sha256(payload.encode()).hexdigest()
                e = hashlib.sha256(ENTRY_PREFIX.encode() + previous.encode() + p.encode() + int(micros).to_bytes(8, "big", signed=True)).hexdigest()
                rows.append((seq, kind, payload, micros, p, previous, e))
                previous = e
            yield pd.DataFrame(rows, columns=["seq", "event_type", "payload", "created_micros", "payload_hash", "prev_hash", "entry_hash"])

    return run


def append(events: DataFrame, order: list[str], start: int = 0, tip: str = GENESIS) -> DataFrame:
    """A chained entry per event (event_type, payload, created_micros), in order, after entry `start` with hash `tip`.

    Every hash holds the one before, so one task writes a batch; it streams through the rows and holds none of them.
    A chain is per ledger: a larger history is appended batch by batch."""
    ordered = events.repartition(1).sortWithinPartitions(*order).select("event_type", F.coalesce("payload", F.lit("null")).alias("payload"), "created_micros")
    return ordered.mapInPandas(_chain(start, tip), SCHEMA)


def verify(ledger: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """One row: entries, whether all hold, and the first bad seq (null if none).

    Each entry is checked against the one before it: recomputed hashes, and prev_hash equal to that entry's hash. Entries
    meet their predecessor within slices of seq; the first of a slice is handed over by a join, so nothing is sorted in
    one task. A seq that is missing breaks the chain at the next one."""
    sliced = ledger.withColumn("_slice", F.floor((F.col("seq") - 1) / slice_rows))
    w = Window.partitionBy("_slice").orderBy("seq")
    before = F.struct(F.lag("seq").over(w).alias("seq"), F.lag("entry_hash").over(w).alias("hash"))
    with_before = sliced.withColumn("_before", before)
    ends = sliced.groupBy("_slice").agg(F.max_by(F.struct("seq", F.col("entry_hash").alias("hash")), "seq").alias("_end")).select((F.col("_slice") + 1).alias("_slice"), "_end")
    joined = with_before.join(ends, "_slice", "left")
    previous = F.when(F.col("_before.seq").isNotNull(), F.col("_before")).otherwise(F.col("_end"))
    expected = F.when(F.col("seq") == 1, F.lit(GENESIS)).when(previous["seq"] == F.col("seq") - 1, previous["hash"])
    p = payload_hash(F.col("payload"))
    e = entry_hash(F.col("prev_hash"), F.col("payload_hash"), F.timestamp_micros(F.col("created_micros")))
    good = (p == F.col("payload_hash")) & (e == F.col("entry_hash")) & F.coalesce(expected == F.col("prev_hash"), F.lit(False))
    checked = joined.select("seq", F.coalesce(good, F.lit(False)).alias("good"))
    return checked.agg(F.count("*").alias("entries"), F.coalesce(F.bool_and("good"), F.lit(True)).alias("valid"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("first_bad_seq"))


def entries_for(ledger: DataFrame, field: str, value: str) -> DataFrame:
    """Entries whose payload has a value in a field, in order."""
    return ledger.filter(F.get_json_object("payload", f"$.{field}") == value).orderBy("seq")
