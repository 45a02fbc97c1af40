"""Case records: the nested context that rules see, derived features, the work queue, and placing courts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Case fields of the context; prosecutor fields are added.
FIELDS = ("docket_number", "jurisdiction", "court_level", "case_type", "charge_category", "charges", "judge", "defendant_race", "evidence_strength", "outcome", "plea_offered", "plea_accepted", "plea_offer_months", "sentence_months", "sentence_type")


def offer_ratio() -> Column:
    """Offer over sentence where an offer was refused and a conviction followed; an offer of 0 counts."""
    fits = F.col("plea_offered") & ~F.col("plea_accepted") & (F.col("outcome") == "conviction") & F.col("plea_offer_months").isNotNull() & (F.col("sentence_months") > 0)
    return F.when(fits, F.col("plea_offer_months") / F.nullif(F.col("sentence_months"), F.lit(0)))


def penalty_window() -> Column:
    """Refused offers above 0 that ended in a conviction with a sentence above 0."""
    return F.col("plea_offered") & ~F.col("plea_accepted") & (F.col("outcome") == "conviction") & (F.col("plea_offer_months") > 0) & (F.col("sentence_months") > 0)


def penalty_ratio() -> Column:
    """Sentence over offer: the other way round than offer_ratio()."""
    return F.col("sentence_months").cast("double") / F.col("plea_offer_months")


def context(cases: DataFrame, prosecutors: DataFrame) -> DataFrame:
    """(case_id, case, features): one nested record per case, prosecutor fields null without one.

    Opinion text and gaps are unknown here, so the features that need them are false."""
    p = prosecutors.select(F.col("prosecutor_id").alias("_p"), F.col("name").alias("prosecutor_name"), "office")
    joined = cases.join(p, F.col("prosecutor_id") == F.col("_p"), "left")
    ratio = offer_ratio()
    weak = F.coalesce(F.lower("evidence_strength") == "weak", F.lit(False))
    convicted = F.coalesce(F.col("outcome") == "conviction", F.lit(False))
    drug = F.coalesce(F.lower("charge_category").isin("drug", "possession"), F.lit(False))
    features = F.struct(
        F.coalesce(ratio < 0.5, F.lit(False)).alias("trial_pressure"),
        (weak & convicted).alias("due_process"),
        ((F.length(F.coalesce("defendant_race", F.lit(""))) > 0) & drug & convicted).alias("equal_protection"),
        F.lit(False).alias("search"),
    )
    return joined.select("case_id", F.struct(*FIELDS, "prosecutor_name", "office", ratio.alias("plea_sentence_ratio")).alias("case"), features.alias("features"))


def queue(cases: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Oldest cases without a finished run; failed ones come again. limit: 1 to 2000."""
    done = runs.filter(F.col("status").isin("ok", "partial")).select("case_id").distinct()
    return cases.join(done, "case_id", "left_anti").orderBy("inserted_at", "case_id").limit(max(1, min(2000, limit)))


def placed(cases: DataFrame, courts: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """cases with forum, forum_level and forum_method: the registry's forum of the court, else the claimed one if it is a
    known code, else `unknown`. courts: (court_id, jurisdiction, level, method), court_id as compared."""
    c = courts.select(F.col("court_id").alias("_c"), F.col("jurisdiction").alias("_j"), F.col("level").alias("_l"), F.col("method").alias("_m"))
    out = cases.join(c, F.lower(F.trim("source_court_id")) == F.col("_c"), "left")
    claimed = F.upper(F.trim("jurisdiction"))
    known = claimed.isin(*codes)
    return (
        out.withColumn("forum", F.coalesce("_j", F.when(known, claimed), F.lit("unknown")))
        .withColumn("forum_level", F.coalesce("_l", "court_level"))
        .withColumn("forum_method", F.when(F.col("_j").isNotNull(), F.col("_m")).when(known, "claimed").otherwise("unknown"))
        .drop("_c", "_j", "_l", "_m")
    )
