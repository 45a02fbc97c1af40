"""Upserts without a table format: union, then one row per key by each column's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(held: DataFrame, incoming: DataFrame, key: list[str], rules: dict[str, str], order: str | None = None) -> DataFrame:
    """held and incoming merged by key.

    rules per column: "new" (the incoming value if not null, else the held), "old" (the held value if not null, else the
    incoming), "replace" (the incoming row's value whenever there is one, also null). Columns of neither are dropped.
    Of several incoming rows of a key the last delivered holds: the one with the largest value in the column order, which
    incoming has; equal ones, and all without order, by the columns themselves. Only that row counts, not the earlier
    ones' values. The maximum is combined before the shuffle. Null keys never match."""
    columns = [c for c in held.columns if c in rules]
    ranked = F.struct(*([F.col(order).alias("_order")] if order else []), F.struct(*columns).alias("_row"))
    fresh = incoming.groupBy(*key).agg(F.max(ranked).alias("_m")).select(*key, F.col("_m._row").alias("_new"))
    both = held.select(*key, F.struct(*columns).alias("_old")).join(fresh, key, "full")
    pick = {
        "new": lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")),
        "old": lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")),
        "replace": lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")),
    }
    return both.select(*key, *[pick[rules[c]](c).alias(c) for c in columns])


def inserted(held: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key."""
    return incoming.dropDuplicates(key).join(held.select(*key), key, "left_anti")


def without_superseded(opinions: DataFrame, ref: str = "source_ref", completeness: str = "text_completeness") -> DataFrame:
    """Rows without partial texts whose source_ref has a full one; rows without a source_ref stay."""
    full = opinions.filter(F.col(completeness) == "full").select(F.col(ref).alias("_ref")).filter("_ref is not null").distinct()
    partial = F.coalesce(F.col(completeness) != "full", F.lit(True))
    return opinions.filter(~partial | F.col(ref).isNull()).unionByName(opinions.filter(partial & F.col(ref).isNotNull()).join(full, F.col(ref) == F.col("_ref"), "left_anti"))
