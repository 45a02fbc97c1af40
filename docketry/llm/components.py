"""Connected components of links: in one task below a size, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import drop_materialized, materialize

#: Links up to which one task joins them; more take rounds over the cluster, with the same answer.
ONE_TASK = 500_000


def merge_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins x[i] with y[i]; label[k] is the smallest index of k's component, before and after, in place."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = to[to]
            if (nearer == to).all():
                break
            to = nearer
        label[:] = to[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of a task, which are ONE_TASK at most."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    links = pa.Table.from_batches(held)
    ends = pa.chunked_array([*links.column("u").chunks, *links.column("v").chunks])
    names = ends.unique().sort()
    at = {v: i for i, v in enumerate(names.to_pylist())} if not pa.types.is_integer(names.type) else None
    code = lambda c: np.searchsorted(names.to_numpy(), c.to_numpy()) if at is None else np.fromiter((at[v] for v in c.to_pylist()), np.int64, len(c))
    label = np.arange(len(names))
    merge_labels(label, code(links.column("u")), code(links.column("v")))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["id", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v. Large: every larger neighbour of a node is linked to the node's smallest
    neighbour; small: every smaller one is, and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(a, b) links to (id, component), component the smallest id; ids without links are not in it. Null ends are dropped.

    Up to ONE_TASK links are joined in one task. More are never gathered: minima are combined before the shuffle and joined back, and every round's result is a
    table in the shared folder."""
    edges = links.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now, before = materialize(edges, name), None
    if now.count() <= ONE_TASK:
        kind = now.schema["u"].dataType.simpleString()
        out = materialize(now.coalesce(1).mapInArrow(_in_one_task, f"id {kind}, component {kind}"), name)
        drop_materialized(now)
        return out
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            # stars: every node is linked to its component's smallest
            least = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(least)
        before = tuple(state)
        half = materialize(_star(now, True), name)
        after = materialize(_star(half, False), name)
        drop_materialized(half)
        drop_materialized(now)
        now = after
