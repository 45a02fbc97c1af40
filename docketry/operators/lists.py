"""Lists as people ask for them: optional filters, a text to look for, the newest rows, lookups by code or name, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """rows whose columns have the wanted values; a value of None asks for nothing and adds no predicate, so what is asked
    reaches the scan and nothing else does. A list or set asks for any of its values; null columns never fit."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple, set, frozenset)) else F.col(column) == value)
    return rows


def containing(rows: DataFrame, needle: str | None, *columns: str) -> DataFrame:
    """rows in one of whose columns, joined by blanks and lower case, the needle stands; a blank needle asks for nothing."""
    asked = (needle or "").strip().lower()
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(asked))) if asked else rows


def newest(rows: DataFrame, at: str, tie: str, limit: int = 200) -> DataFrame:
    """The newest rows, undated first, ties by another column; 1 to 2000 of them."""
    return rows.orderBy(F.desc_nulls_first(at), tie).limit(max(1, min(2000, limit)))


def by_kind(rows: DataFrame, kind: str | None, groups: dict[str, list[str]] | None = None, column: str = "kind", key: str = "code") -> DataFrame:
    """rows of one kind, case aside; a kind in groups stands for a list of keys. No kind, and one that no row has, ask for
    all rows."""
    if kind is None:
        return rows
    if groups and kind in groups:
        return rows.filter(F.col(key).isin(*groups[kind]))
    fits = F.lower(F.col(column)) == kind.lower()
    return rows.filter(fits) if not rows.filter(fits).isEmpty() else rows


def unknown_values(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """(value, n): values of a column that are not among the known ones, null aside."""
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*known)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def checked(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """rows; a value of the column that is not known fails the job as soon as its row is read. Null passes."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column)))
    return rows.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(*known), F.col(column)).otherwise(bad))


def lookup(asked: DataFrame, column: str, forums: DataFrame) -> DataFrame:
    """asked with code and name of the forum whose code or name a column writes, trimmed, case aside; null if none does.

    forums: (code, name). Code and name are both keys of one equi-join, the code first if they are ambiguous."""
    key = lambda c: F.lower(F.trim(c))
    keys = forums.select(key(F.col("code")).alias("_k"), F.lit(0).alias("_r"), "code", "name").unionByName(forums.select(key(F.col("name")).alias("_k"), F.lit(1).alias("_r"), "code", "name"))
    first = keys.groupBy("_k").agg(F.min(F.struct("_r", "code", "name")).alias("_f")).select("_k", "_f.code", "_f.name")
    kept = [c for c in asked.columns if c not in ("code", "name")]
    return asked.select(*kept, key(F.col(column)).alias("_k")).join(first, "_k", "left").select(*kept, "code", "name")


def options(rows: DataFrame, *columns: str) -> DataFrame:
    """(list, value, n): the values of every column and how often each occurs, null aside; one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).cast("string").alias("value")) for c in columns])).alias("o")
    return rows.select(each).select("o.*").filter("value is not null").groupBy("list", "value").agg(F.count("*").alias("n"))


def is_panel(name: Column) -> Column:
    """Whether a name lists several people, or is a form's label: a semicolon, two commas, or the words form field."""
    return F.coalesce(F.contains(name, F.lit(";")) | (F.length(name) - F.length(F.replace(name, F.lit(","), F.lit(""))) >= 2) | F.contains(F.lower(name), F.lit("form field")), F.lit(False))


def without_panels(actors: DataFrame, touched: Column) -> DataFrame:
    """Actors but for those whose display_name lists several people; rows that a person has touched stay."""
    return actors.filter(~is_panel(F.col("display_name")) | F.coalesce(touched, F.lit(False)))
