"""Merging rows that turn out to be one: survivors of equal keys, and children that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(rows: DataFrame, id_col: str, key: Column, first: list[Column]) -> DataFrame:
    """(id_col, survivor_id): of the rows of a key the one that is least by first, then by id; a null key is one of its own.

    The least is combined before the shuffle, so a key with a third of all rows is a row per task."""
    keyed = rows.select(F.col(id_col).alias("_id"), F.coalesce(key, F.concat(F.lit("\x00"), F.col(id_col))).alias("_key"), F.struct(*first, F.col(id_col).alias("_last")).alias("_rank"))
    least = keyed.groupBy("_key").agg(F.min("_rank")["_last"].alias("survivor_id"))
    return keyed.join(least, "_key").select(F.col("_id").alias(id_col), "survivor_id")


def repoint(children: DataFrame, merged: DataFrame, id_col: str, unique: list[str] | None = None) -> DataFrame:
    """children whose id_col names the survivor; ids that merged does not know, and null ones, stay.

    unique: columns of which, once repointed, one row each may be left; of colliding ones that stays whose id was the
    survivor's before, then the least of its columns."""
    to = merged.filter(F.col(id_col) != F.col("survivor_id")).select(F.col(id_col).alias("_from"), F.col("survivor_id").alias("_to"))
    out = children.join(to, F.col(id_col) == F.col("_from"), "left").withColumn("_moved", F.col("_to").isNotNull()).withColumn(id_col, F.coalesce("_to", id_col)).drop("_from", "_to")
    if not unique:
        return out.drop("_moved")
    rest = [c for c in children.columns if c not in unique]
    one = out.groupBy(*unique).agg(F.min(F.struct("_moved", *rest)).alias("_r"))
    return one.select(*[F.col(c) if c in unique else F.col(f"_r.{c}").alias(c) for c in children.columns])


def merged_holds(holds: DataFrame, merged: DataFrame, id_col: str = "actor_id") -> DataFrame:
    """(id_col, approved) of survivors: approved if any of the merged rows was."""
    return repoint(holds, merged, id_col).groupBy(id_col).agg(F.bool_or("approved").alias("approved"))


def without_merged(rows: DataFrame, merged: DataFrame, id_col: str) -> DataFrame:
    """rows but for those that another one survives."""
    return rows.join(merged.filter(F.col(id_col) != F.col("survivor_id")).select(id_col), id_col, "left_anti")
