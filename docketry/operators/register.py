"""Scores and the public register. Only substantiated findings count anywhere here; the gate is inside, not the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gated(rows: DataFrame) -> DataFrame:
    """Rows that a person has substantiated."""
    return rows.filter(F.col("review_status") == "substantiated")


def actor_matches(rows: DataFrame, actors: DataFrame) -> DataFrame:
    """rows with matched_actor: the row's own actor, or else every actor of its prosecutor.

    Either way is an equality, so both are one equi-join on a key that says which it is; one join with OR would be a nested
    loop, two joins would read the rows twice."""
    of_actor, of_prosecutor = (lambda c: F.concat(F.lit("a:"), c)), (lambda c: F.concat(F.lit("p:"), c))
    keys = actors.select(of_actor(F.col("actor_id")).alias("_k"), F.col("actor_id").alias("matched_actor")).distinct()
    keys = keys.unionByName(actors.filter("prosecutor_id is not null").select(of_prosecutor(F.col("prosecutor_id")).alias("_k"), F.col("actor_id").alias("matched_actor")))
    own = F.when(F.col("actor_id").isNotNull(), of_actor(F.col("actor_id"))).otherwise(of_prosecutor(F.col("prosecutor_id")))
    return rows.withColumn("_k", own).filter(F.col("_k").isNotNull()).join(keys, "_k").drop("_k")


def points(findings: Column, flags: Column, sources: Column, recent: Column) -> Column:
    """A capped additive score, 100 at most."""
    raw = 12 * F.least(findings, F.lit(4)) + 8 * F.least(flags, F.lit(3)) + 6 * F.least(sources, F.lit(3)) + F.when(recent > 0, 10).otherwise(0)
    return F.least(F.lit(100), raw).cast("double")


def scores(actors: DataFrame, findings: DataFrame, flags: DataFrame, as_of: str) -> DataFrame:
    """(actor_id, n_findings, n_flags, n_sources, n_recent, score) of every actor, zeros included.

    findings: (actor_id, prosecutor_id, finding_type, finding_date, review_status); flags: (actor_id, prosecutor_id, label,
    review_status). Sources are distinct types and labels together; recent findings are of the last five years."""
    since = F.lit(as_of).cast("date") - F.expr("INTERVAL '5' YEAR")
    f = actor_matches(gated(findings), actors).select("matched_actor", F.col("finding_type").alias("source"), F.lit(1).alias("f"), F.lit(0).alias("g"), F.coalesce((F.col("finding_date") >= since).cast("int"), F.lit(0)).alias("r"))
    g = actor_matches(gated(flags), actors).select("matched_actor", F.col("label").alias("source"), F.lit(0).alias("f"), F.lit(1).alias("g"), F.lit(0).alias("r"))
    by = f.unionByName(g).groupBy("matched_actor").agg(F.sum("f").alias("n_findings"), F.sum("g").alias("n_flags"), F.countDistinct("source").alias("n_sources"), F.sum("r").alias("n_recent"))
    out = actors.select("actor_id").join(by, F.col("actor_id") == F.col("matched_actor"), "left").drop("matched_actor").na.fill(0)
    return out.withColumn("score", points(*[F.col(c) for c in ("n_findings", "n_flags", "n_sources", "n_recent")]))


def publishable(actors: DataFrame, findings: DataFrame, holds: DataFrame) -> DataFrame:
    """Actors with a substantiated finding and without a hold. holds: (actor_id, approved)."""
    with_finding = actor_matches(gated(findings), actors).select(F.col("matched_actor").alias("actor_id")).distinct()
    held = holds.filter(~F.col("approved")).select("actor_id")
    return actors.join(with_finding, "actor_id", "left_semi").join(held, "actor_id", "left_anti")


def wall(actors: DataFrame, findings: DataFrame, holds: DataFrame) -> DataFrame:
    """Register cards: publishable actors with the number of their substantiated findings, most findings first, then by
    name and id. Actors need a display_name."""
    n = actor_matches(gated(findings), actors).groupBy(F.col("matched_actor").alias("actor_id")).agg(F.count("*").alias("n_findings"))
    return publishable(actors, findings, holds).join(n, "actor_id").orderBy(F.desc("n_findings"), "display_name", "actor_id")


def wall_records(actors: DataFrame, findings: DataFrame, holds: DataFrame, page_rows: int = 1000) -> DataFrame:
    """(actor_id, page, records) of the cards: substantiated findings by date, undated last, ties by id, as lists of at most
    page_rows. records: array of (finding_id, finding_type, finding_date).

    A finding's place is its rank in its month plus the findings of the months before, so no task sorts an actor whole."""
    f = actor_matches(gated(findings), actors).join(publishable(actors, findings, holds).select(F.col("actor_id").alias("matched_actor")), "matched_actor", "left_semi")
    f = f.select(F.col("matched_actor").alias("actor_id"), "finding_id", "finding_type", "finding_date", F.coalesce(F.trunc("finding_date", "MM"), F.lit("9999-12-01").cast("date")).alias("month"))
    months = f.groupBy("actor_id", "month").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("actor_id").orderBy("month")) - F.col("n")
    local = F.row_number().over(Window.partitionBy("actor_id", "month").orderBy(F.asc_nulls_last("finding_date"), "finding_id")) - 1
    placed = f.withColumn("local", local).join(months.select("actor_id", "month", before.alias("before")), ["actor_id", "month"]).withColumn("at", F.col("before") + F.col("local"))
    pages = placed.groupBy("actor_id", F.floor(F.col("at") / page_rows).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "finding_id", "finding_type", "finding_date"))).alias("r"))
    return pages.select("actor_id", "page", F.transform("r", lambda x: F.struct(x["finding_id"].alias("finding_id"), x["finding_type"].alias("finding_type"), x["finding_date"].alias("finding_date"))).alias("records"))
