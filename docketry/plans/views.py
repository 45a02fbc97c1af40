"""Canonical views of the data folder's tables: the latest row per key, keys in one form. Only the columns asked for are
read. SQL holds the same views for the engine that checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.latest import latest_by
from docketry.session import table

#: In place of the day a query runs on.
AS_OF = "2026-01-01"


def key(col: str | Column) -> Column:
    """A key's hexadecimal digits in lower case; null if there are none."""
    digits = F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), "[^0-9a-f]", "")
    return F.when(digits != "", digits)


_KEYS = ("case_id", "prosecutor_id", "actor_id")
_TABLES = {
    "cases": ("court_cases", "case_id", "inserted_at"),
    "findings": ("constitutional_findings", "finding_id", "ingested_at"),
    "disclosed": ("disclosed_evidence_items", "item_id", "ingested_at"),
    "entries": ("feed_entries", "entry_id", "fetched_at"),
    "prosecutors": ("prosecutors", "prosecutor_id", "created_at"),
    "actors": ("accountability_actors", "actor_id", "created_at"),
    "opinions": ("court_opinions", "opinion_id", "ingested_at"),
}


def view(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A view's key and the columns asked for."""
    source, key_col, order = _TABLES[name]
    as_key = key_col in _KEYS
    picked = {c: key(c) if c in _KEYS else F.col(c) for c in columns}
    out = latest_by(table(spark, d, source), key(key_col) if as_key else F.col(key_col), [F.col(order)], picked)
    return out.withColumnRenamed("_key", key_col)


def _sql_key(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '[^0-9a-f]', '', 'g'), '')"


def _sql_view(name: str) -> str:
    source, key_col, order = _TABLES[name]
    keys = {"cases": ("case_id", "prosecutor_id"), "findings": ("case_id", "prosecutor_id", "actor_id"), "disclosed": ("case_id",), "entries": (), "prosecutors": ("prosecutor_id",), "actors": ("actor_id", "prosecutor_id"), "opinions": ("case_id",)}[name]
    replaced = ", ".join(f"{_sql_key(k)} AS {k}" for k in keys)
    star = f"* REPLACE ({replaced})" if keys else "*"
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT {star}, row_number() OVER (PARTITION BY {_sql_key(key_col) if key_col in _KEYS else key_col} ORDER BY {order} DESC) AS rn FROM {source}) WHERE rn = 1)"


def sql(*names: str) -> str:
    """WITH clause of the views that a query names."""
    return "WITH " + ", ".join(_sql_view(n) for n in names) + " "
