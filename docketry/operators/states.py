"""Changes of state that are asked for: which are allowed, and tables with them made. Which states there are and what may
follow what, callers say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transition(rows: DataFrame, requests: DataFrame, key: str, state: str, allowed: dict[str, tuple[str, ...]], order: str = "at") -> tuple[DataFrame, DataFrame]:
    """rows with the states that requests ask for, and (key, to, reason) of the requests that are refused.

    requests: (key, to, order). Of several for a row the last holds. allowed: from each state, those that may follow; asking
    for the state that a row has changes nothing and is not refused. A request for a row that is not there is refused, as
    `missing`, any other that is not allowed as `not allowed`. Null keys ask for nothing."""
    last = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, "to")).alias("_q")).select(key, F.col("_q.to").alias("to"))
    pairs = [F.concat(F.lit(a), F.lit("\x1f"), F.lit(b)) for a, after in allowed.items() for b in after]
    fits = F.concat(F.col(state), F.lit("\x1f"), F.col("to")).isin(*pairs) if pairs else F.lit(False)
    asked = rows.join(last, key, "left").withColumn("_ok", F.coalesce(fits, F.lit(False)))
    changed = asked.withColumn(state, F.when(F.col("_ok"), F.col("to")).otherwise(F.col(state))).select(*rows.columns)
    refused = asked.filter(F.col("to").isNotNull() & ~F.col("_ok") & ~F.coalesce(F.col("to") == F.col(state), F.lit(False))).select(key, "to", F.lit("not allowed").alias("reason"))
    missing = last.join(rows.select(key), key, "left_anti").select(key, "to", F.lit("missing").alias("reason"))
    return changed, refused.unionByName(missing)


def hold(holds: DataFrame, requests: DataFrame, grounds: DataFrame, key: str = "actor_id", order: str = "at") -> tuple[DataFrame, DataFrame]:
    """holds (key, approved) with the latest request of each key merged in, and (key, reason) of refused ones.

    requests: (key, approved, order). Approving needs a row in grounds (key); withholding needs none."""
    last = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, "approved")).alias("_q")).select(key, F.col("_q.approved").alias("_to"))
    known = grounds.select(key).distinct().withColumn("_grounds", F.lit(True))
    asked = last.join(known, key, "left").withColumn("_ok", ~F.col("_to") | F.coalesce("_grounds", F.lit(False)))
    fresh = asked.filter("_ok").select(key, F.col("_to").alias("_new"))
    merged = holds.select(key, "approved").join(fresh, key, "full").select(key, F.coalesce("_new", "approved").alias("approved"))
    return merged, asked.filter("not _ok").select(key, F.lit("no grounds").alias("reason"))
