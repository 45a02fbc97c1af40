"""Latest row per key: the one dedupe that every feed table needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, key: str | Column, order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """One row per key: the columns of its row that is largest by order; the columns themselves break ties, so repeated
    rows give the same result in any partitioning. Nulls order first; rows whose key is null are dropped.

    A max over a struct is combined before the shuffle, so a key that holds a third of all rows costs one row per task.
    """
    key = F.col(key) if isinstance(key, str) else key
    picked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[c.alias(n) for n, c in columns.items()])
    return (
        df.select(key.alias("_key"), picked.alias("_row"))
        .filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.max("_row").alias("_row"))
        .select("_key", *[F.col(f"_row.{n}").alias(n) for n in columns])
    )
