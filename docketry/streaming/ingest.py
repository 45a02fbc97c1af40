"""Incremental ingestion: a feed's micro-batches are merged into tables, its state is one row, and new work is queued."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.upsert import inserted, upsert
from docketry.session import Files

STATE = "source string, batches bigint, rows_seen bigint, rows_new bigint, failures bigint, last_batch bigint, last_error string"
#: Parts of a table by a hash of its key; a merge rewrites those that its rows fall into.
PARTS = 64


class TableFolder:
    """Parquet tables in parts. A part's new version is written beside the old one, then a pointer names the versions that
    are current.

    A reader sees the old or the new version of all parts; a writer that dies leaves the old ones. One writer per table.
    Folders are reached through Hadoop, so they may be in any file system that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def _versions(self, name: str) -> dict[str, str]:
        text = self.files.read(f"{self.folder}/{name}.current")
        return json.loads(text) if text else {}

    def read(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        """The table, or some of its parts."""
        at = self._versions(name)
        paths = sorted(v for k, v in at.items() if parts is None or int(k) in parts)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def replace(self, name: str, df: DataFrame, key: list[str], parts: list[int] | None = None) -> None:
        """Writes df as the content of these parts, or of all; a part with no rows is empty from then on."""
        before, version = self._versions(name), f"{name}-{uuid.uuid4().hex}"
        df.withColumn("_part", part_of(key)).repartition("_part").write.partitionBy("_part").parquet(f"{self.folder}/{version}")
        written = [p.removeprefix("_part=") for p in self.files.names(f"{self.folder}/{version}") if p.startswith("_part=")]
        after = {k: v for k, v in before.items() if parts is not None and int(k) not in parts} | {p: f"{version}/_part={p}" for p in written}
        self.files.write(f"{self.folder}/{name}.current", json.dumps(after, sort_keys=True))
        for old in set(before.values()) - set(after.values()):
            self.files.remove(f"{self.folder}/{old}")


def part_of(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")


def merge_batch(tables: TableFolder, source: str, name: str, schema: str, key: list[str], rules: dict[str, str], transform: Callable[[DataFrame], DataFrame], order: str | None = None):
    """A foreachBatch function: transform, merge into table `name`, and keep the source's state.

    Only the parts that the batch's keys fall into are read and written. The state keeps the number of the last batch that
    was merged: one that is delivered again after a failure is merged again, which changes nothing, and not counted again. A
    batch that fails is counted in the state, and the stream stops with its error. order: a column of the transformed rows
    by which the last of several rows of a key holds (see upsert())."""

    def run(batch: DataFrame, number: int) -> None:
        state = tables.read("state", STATE)
        old = state.filter(F.col("source") == source).first()
        batches, seen, new, bad, last = (old["batches"], old["rows_seen"], old["rows_new"], old["failures"], old["last_batch"]) if old else (0, 0, 0, 0, -1)
        error = None
        try:
            columns = [*key, *rules, *([order] if order and order not in rules else [])]
            incoming = transform(batch).select(*columns).persist()
            touched = [r["p"] for r in incoming.select(part_of(key).alias("p")).distinct().collect()]  # PARTS numbers at most
            if touched:
                held = tables.read(name, schema, touched)
                fresh, n = inserted(held, incoming, key).count(), incoming.count()
                tables.replace(name, upsert(held.select(*key, *rules), incoming, key, rules, order), key, touched)
                if number > last:
                    seen, new = seen + n, new + fresh
            incoming.unpersist()
            batches, bad, last = batches + (number > last), 0, max(number, last)
        except Exception as e:
            bad, error = bad + 1, str(e)[:300]
            raise
        finally:
            row = tables.spark.createDataFrame([(source, batches, seen, new, bad, last, error)], STATE)
            tables.replace("state", state.filter(F.col("source") != source).unionByName(row), ["source"])

    return run


def run_feeds(feeds: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Runs every feed; one that fails doesn't stop the others. Errors by name; an error if all failed."""
    errors: dict[str, str] = {}
    for name, run in feeds.items():
        try:
            run()
        except Exception as e:
            errors[name] = str(e)
    if feeds and len(errors) == len(feeds):
        raise RuntimeError(f"all feeds failed: {errors}")
    return errors


def feed_states(state: DataFrame, declared: list[str], cursors: dict[str, str] | None = None) -> DataFrame:
    """(source, state) of declared and observed feeds: not configured, waiting, N failures, list complete, mid-list or
    healthy. cursors: where the crawl of a paged list stands (see sources.pages.poll), for the feeds that have one."""
    named = state.sparkSession.createDataFrame([(s, (cursors or {}).get(s)) for s in declared], "source string, cursor string").withColumn("declared", F.lit(True))
    both = named.join(state, "source", "full")
    word = (
        F.when(F.col("declared").isNull(), "not configured").when(F.col("batches").isNull(), "waiting").when(F.col("failures") > 0, F.concat(F.col("failures").cast("string"), F.lit(" failures")))
        .when(F.startswith("cursor", F.lit("complete:")), "list complete").when(F.startswith("cursor", F.lit("page:")), "mid-list").otherwise("healthy")
    )
    return both.select("source", word.alias("state"))


def feed_totals(state: DataFrame) -> DataFrame:
    """One row over all feeds: feeds, failing ones, rows seen and new."""
    return state.agg(F.count("*").alias("feeds"), F.count_if(F.col("failures") > 0).alias("failing"), F.coalesce(F.sum("rows_seen"), F.lit(0)).alias("rows_seen"), F.coalesce(F.sum("rows_new"), F.lit(0)).alias("rows_new"))


def feed_list(text: str) -> list[str]:
    """Names of feeds written with commas or blanks between them, each once, in the order in which they first stand."""
    return list(dict.fromkeys(t for t in text.replace(",", " ").lower().split() if t))
