"""A table of rules: a text is added only if it parses; the list is in the order in which rules came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.rules.language import parse

SCHEMA = "name string, source string, severity string, created_at timestamp_ntz"


def added(held: DataFrame, name: str, source: str, at) -> DataFrame:
    """held with one more rule; RuleError if the text is none, ValueError if the name is taken or blank."""
    rule = parse(source)
    if not name.strip() or not held.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"the name {name!r} is blank or taken")
    return held.unionByName(held.sparkSession.createDataFrame([(name, source, rule.severity, at)], SCHEMA))


def listed(held: DataFrame) -> DataFrame:
    return held.orderBy(F.desc("created_at"), "name")


def as_rules(held: DataFrame) -> dict[str, str]:
    """Name to text, for rules.compile.flags(): a person writes each, so they are few."""
    return {r["name"]: r["source"] for r in listed(held).collect()}
