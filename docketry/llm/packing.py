"""Filling containers of fixed capacity with texts: best-two-fit over the histogram of sizes.

How well containers can be filled depends only on how many items there are of each size, and sizes are whole numbers up
to the capacity, so the packing is worked out on a histogram that has no more rows than the capacity, whatever the
corpus. A container's make-up is found greedily (largest size that fits, again and again), then its smallest item is
replaced by two unpacked ones if they fit the widened gap more tightly; the make-up is used as often as the counts
allow. Items then find their container by their rank among the items of their size, which is counted in chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialize

#: Items ranked by one task, about.
CHUNK_ROWS = 200_000


def _largest_up_to(counts: np.ndarray) -> np.ndarray:
    """For every size, the largest size that is left and no larger, or 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def make_up(counts: np.ndarray, capacity: int) -> list[int]:
    """The sizes of the next container; counts[s] items of size s are left, some of them."""
    left, upto = counts.copy(), _largest_up_to(counts)
    items, gap = [], capacity
    while gap and (s := int(upto[gap])):
        items.append(s)
        gap -= s
        left[s] -= 1
        if not left[s]:
            upto = _largest_up_to(left)
    if gap and items:
        least = min(items)
        room = least + gap
        left = left.copy()
        upto = _largest_up_to(left)
        first = np.flatnonzero(left[: room // 2 + 1] > 0)
        first = first[first > 0]
        if len(first):
            # the second is the larger one; two of the same size need two items
            second = upto[room - first]
            ok = (second >= first) & ((second > first) | (left[first] > 1))
            total = np.where(ok, first + second, 0)
            best = int(total.argmax())
            if total[best] > least:
                items.remove(least)
                items += [int(first[best]), int(second[best])]
    return items


def best_two_fit(sizes: dict[int, int], capacity: int) -> list[tuple[list[int], int, int]]:
    """(make-up, first container, containers) until all items are packed."""
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        counts[s] = n
    out, base = [], 0
    while counts.any():
        items = make_up(counts, capacity)
        uses = Counter(items)
        times = int(min(counts[s] // n for s, n in uses.items()))
        for s, n in uses.items():
            counts[s] -= n * times
        out.append((items, base, times))
        base += times
    return out


def _intervals(plan: list[tuple[list[int], int, int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: the ranks at which a make-up's share begins, its first container and its number of containers."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    for items, base, times in plan:
        for s, n in Counter(items).items():
            rows.setdefault(s, []).append((used[s], base, times))
            used[s] += n * times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def _place(of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size, rank = f["size"].to_numpy(), f["rank"].to_numpy()
            out = np.zeros(len(f), np.int64)
            for s in np.unique(size):
                at = size == s
                start, base, times = of[int(s)]
                j = np.searchsorted(start, rank[at], side="right") - 1
                out[at] = base[j] + (rank[at] - start[j]) % times[j]
            f["container"] = out
            yield f[["id", "part", "size", "container"]]

    return run


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(id, size) to (id, part, size): an item larger than the capacity is cut into full parts and a rest."""
    full = F.floor(F.col("size") / capacity).cast("int")
    n = F.greatest(F.lit(1), full + F.when(F.col("size") % capacity > 0, 1).otherwise(0))
    parts = sized.select("id", F.col("size").alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return parts.select("id", "part", F.least(F.lit(capacity), F.col("whole") - F.col("part").cast("bigint") * capacity).cast("int").alias("size"))


def pack(sized: DataFrame, capacity: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, size) to (id, part, size, container): no container holds more than capacity, and an item is cut only if it
    is larger than that.

    Containers are numbered from 0. Items of size 0 take no room and are spread over all containers (container 0 if
    there are none). Rows with a null size count as size 0; repeated ids are separate items; an empty table gives an
    empty one. Equal sizes are told apart by a hash of id and part, so the result depends on the rows alone."""
    items = pieces(sized.select("id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), capacity)
    items = materialize(items, "items")
    sizes = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity + 1 rows at most
    empty = sizes.pop(0, 0)
    plan = best_two_fit(sizes, capacity)
    bins = plan[-1][1] + plan[-1][2] if plan else 1
    of = _intervals(plan, capacity)
    of[0] = (np.array([0]), np.array([0]), np.array([bins]))
    chunks = max(1, -(-(sum(sizes.values()) + empty) // chunk_rows))
    chunked = items.withColumn("chunk", F.pmod(F.xxhash64("id", "part"), F.lit(chunks)).cast("int"))
    # counts per size and chunk: capacity x chunks rows at most, in groups of as many rows as there are chunks
    counts = chunked.groupBy("size", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("chunk")) - F.col("n")
    offsets = counts.select("size", "chunk", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "chunk").orderBy(F.xxhash64("id", "part"), "id", "part")) - 1
    ranked = chunked.withColumn("local", local).join(offsets, ["size", "chunk"]).select("id", "part", "size", (F.col("before") + F.col("local")).alias("rank"))
    kind = sized.schema["id"].dataType.simpleString()
    return ranked.mapInPandas(_place(of), f"id {kind}, part int, size int, container bigint")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of room left."""
    by = packed.groupBy("container").agg(F.sum("size").alias("tokens"))
    total, n = F.sum("tokens"), F.count("*")
    return by.agg(n.alias("containers"), total.alias("tokens"), F.ceil(total / capacity).alias("least_containers"), F.max("tokens").alias("fullest"), F.round(1 - total / (n * capacity), 6).alias("room_left"))
