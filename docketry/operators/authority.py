"""Which holding governs a clause in a forum: set-based joins over small catalogs that callers pass as tables.

clauses: (clause_id, incorporation); forums: (code, circuit, is_federal); holdings: (holding_id, clause_ids, court_kind,
court_id, year, authority, superseded_by, ordinal); splits: (clause_id, side_a, side_b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.forum import is_state_forum


def is_live(as_of: int | None) -> Column:
    """Holdings that still stand, up to a year if one is given."""
    live = (F.col("authority") != "overruled") & F.col("superseded_by").isNull()
    return live & (F.col("year") <= as_of) if as_of is not None else live


def resolve(asked: DataFrame, clauses: DataFrame, forums: DataFrame, holdings: DataFrame, splits: DataFrame, as_of: int | None = None) -> DataFrame:
    """asked: (clause_id, code, court_level). Adds state_actor, binding, circuit_holding, forum_side, split and status.

    Of live holdings the latest holds, the last declared of one year. A clause that isn't incorporated doesn't apply to a
    state actor. as_of bounds live holdings, not splits. Unknown clauses and forums give no row."""
    each = holdings.filter(is_live(as_of)).withColumn("clause_id", F.explode("clause_ids"))
    latest = lambda df, *by: df.groupBy(*by).agg(F.max_by("holding_id", F.struct("year", "ordinal")).alias("h"))
    top = latest(each.filter("court_kind = 'scotus'"), "clause_id").withColumnRenamed("h", "binding")
    circuit = latest(each.filter("court_kind = 'circuit'"), "clause_id", "court_id").select("clause_id", F.col("court_id").alias("circuit"), F.col("h").alias("circuit_holding"))
    q = asked.join(clauses, "clause_id").join(forums, "code").join(top, "clause_id", "left").join(circuit, ["clause_id", "circuit"], "left").join(splits.withColumn("split", F.lit(True)), "clause_id", "left")
    actor = is_state_forum(F.col("court_level")) & ~F.col("is_federal")
    split = F.coalesce("split", F.lit(False))
    side = F.when(F.array_contains("side_a", F.col("circuit")), "a").when(F.array_contains("side_b", F.col("circuit")), "b")
    status = (
        F.when(actor & (F.col("incorporation") == "not_incorporated"), "inapplicable").when(split, "unsettled").when(F.col("binding").isNotNull(), "controlling").when(F.col("circuit_holding").isNotNull(), "circuit_binding").otherwise("no_holding")
    )
    return q.select("clause_id", "code", "court_level", actor.alias("state_actor"), "binding", "circuit_holding", split.alias("split"), side.alias("forum_side"), status.alias("status"))


def checked(asked: DataFrame, clauses: DataFrame, forums: DataFrame) -> DataFrame:
    """asked, if every clause and forum in it is known; else an error that names up to five that are not."""
    bad = asked.select(F.col("clause_id").alias("x")).join(clauses.select(F.col("clause_id").alias("x")), "x", "left_anti")
    bad = bad.unionByName(asked.select(F.col("code").alias("x")).join(forums.select(F.col("code").alias("x")), "x", "left_anti")).distinct()
    if names := sorted(str(r["x"]) for r in bad.limit(5).collect()):
        raise ValueError(f"unknown clauses or forums: {', '.join(names)}")
    return asked


def broken_references(holdings: DataFrame, clauses: DataFrame, splits: DataFrame) -> DataFrame:
    """(kind, id, refers_to) of catalog rows that refer to clauses or holdings that are not there."""
    of_clause = holdings.select(F.lit("holding_clause").alias("kind"), F.col("holding_id").alias("id"), F.explode("clause_ids").alias("refers_to")).join(clauses.select(F.col("clause_id").alias("refers_to")), "refers_to", "left_anti")
    of_holding = holdings.filter("superseded_by is not null").select(F.lit("superseded_by").alias("kind"), F.col("holding_id").alias("id"), F.col("superseded_by").alias("refers_to"))
    of_holding = of_holding.join(holdings.select(F.col("holding_id").alias("refers_to")), "refers_to", "left_anti")
    of_split = splits.select(F.lit("split_clause").alias("kind"), F.col("clause_id").alias("id"), F.col("clause_id").alias("refers_to")).join(clauses.select(F.col("clause_id").alias("refers_to")), "refers_to", "left_anti")
    return of_clause.select("kind", "id", "refers_to").unionByName(of_holding.select("kind", "id", "refers_to")).unionByName(of_split.select("kind", "id", "refers_to"))
