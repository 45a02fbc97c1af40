"""References to records that do not exist: run-compressed parent keys and an as-of match.

Parent keys are integers of 128 bits, written as 32 hexadecimal digits, whose text order is their number order. They are
sorted and compressed into runs of consecutive integers; a reference is matched as of the run that starts at or before
it and is an orphan if it lies beyond that run's end. Key space is cut into slices of 65,536 keys, a run never
crosses a slice, so every slice is solved on its own, is small however dense keys are, and slices spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialize

#: Leading hexadecimal digits that name a slice of key space, which so holds 65,536 keys at most.
SLICE_DIGITS = 28
#: Rows of one referred key that meet in one task when states are joined back; a key with more is spread over salts.
SALT_ROWS = 250_000


def hex_key(col: Column) -> Column:
    """The hexadecimal digits of a written key, lower case; null for null and blank.

    A value without exactly 32 digits equals no key and is marked by a question mark."""
    low = F.translate(F.lower(col), "-{} ", "")
    # most keys are plain: told without a regular expression
    plain = (F.length(low) == 32) & (F.translate(low, "0123456789abcdef", "") == "")
    digits = F.regexp_replace(low, "[^0-9a-f]", "")
    blank = F.length(F.regexp_replace(col, r"[\s\u00a0]+", "")) == 0
    return F.when(plain, low).when(~blank, F.when(F.length(digits) == 32, digits).otherwise(F.concat(F.lit("?"), digits)))


def keyed_references(refs: DataFrame) -> DataFrame:
    """refs with key, their key in one form, as a table in the shared folder: it is read several times."""
    return materialize(_with_key(refs.select("src_table", "src_field", "rec_id", "parent", "ref", "at")).drop("ref"), "references")


def _with_key(rows: DataFrame) -> DataFrame:
    """rows with key, the key that ref writes; blank references are dropped. Generated, so that it is computed once."""
    return rows.select("*", F.explode(F.filter(F.array(hex_key(F.col("ref"))), lambda k: k.isNotNull())).alias("key"))


def _offset(key: Column) -> Column:
    """The number of a key within its slice."""
    return F.conv(F.substring(key, SLICE_DIGITS + 1, 32 - SLICE_DIGITS), 16, 10).cast("int")


def key_runs(parents: DataFrame) -> DataFrame:
    """(parent, key, since) to (parent, slice, start, stop, newest): runs of consecutive integer keys of a parent table.

    newest is the latest time at which a key of the run first came. Null keys are dropped; repeated keys count once, with
    their earliest time. A run that crosses the border of a slice is cut there, which changes no answer."""
    w = Window.partitionBy("parent", "slice").orderBy("key")
    keyed = (
        parents.filter(~F.startswith("key", F.lit("?")))
        .groupBy("parent", "key")
        .agg(F.min("since").alias("since"))
        .withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    )
    # consecutive keys keep their distance to the row number
    island = _offset(F.col("key")) - F.row_number().over(w)
    return keyed.withColumn("_island", island).groupBy("parent", "slice", "_island").agg(F.min("key").alias("start"), F.max("key").alias("stop"), F.max("since").alias("newest")).drop("_island")


def reference_states(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, int]:
    """State of every referred key that has a problem, and the most references that one of them may have.

    refs: (parent, key, at); parents: (parent, key, since). Gives (parent, key, n, found, since): n counts its references, found is false where the
    key lies beyond the end of the run that starts at or before it; else since is when the key came, and some reference
    is earlier. Distinct keys are aggregated first: a key that a third of all rows refer to is one row here."""
    wanted = (
        refs.filter(F.col("key").isNotNull())
        .groupBy("parent", "key")
        .agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
        .withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    )
    kind = dict(parents.dtypes)["since"]
    run = F.struct("start", "stop", "newest")
    nothing = F.when(F.lit(False), F.struct(F.lit("").alias("start"), F.lit("").alias("stop"), F.lit(None).cast(kind).alias("newest")))
    both = (
        key_runs(parents)
        .select("parent", "slice", F.col("start").alias("key"), F.lit(0).alias("side"), run.alias("run"), F.lit(None).cast(kind).alias("first_at"), F.lit(0).cast("bigint").alias("n"))
        .unionByName(wanted.select("parent", "slice", "key", F.lit(1).alias("side"), nothing.alias("run"), F.col("first_at").cast(kind).alias("first_at"), "n"))
    )
    w = Window.partitionBy("parent", "slice").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("run", F.last("run", ignorenulls=True).over(w)).filter("side = 1")
    matched = matched.withColumn("found", F.coalesce(F.col("run.stop") >= F.col("key"), F.lit(False)))
    suspects = matched.filter(~F.col("found") | (F.col("run.newest") > F.col("first_at"))).select("parent", "key", "n", "run", "first_at", "found")
    suspects = materialize(suspects, "suspects")  # few keys, read twice
    single = ~F.col("found") | (F.col("run.start") == F.col("run.stop"))
    sure = suspects.filter(single).select("parent", "key", "n", "found", F.when(F.col("found"), F.col("run.newest")).alias("since"))
    # in a longer run newest may be another key's time
    open_ = suspects.filter(~single).select("parent", "key", "n", "found", "first_at")
    since = parents.groupBy("parent", "key").agg(F.min("since").alias("since"))
    exact = open_.join(since, ["parent", "key"]).filter(F.col("since") > F.col("first_at")).select("parent", "key", "n", "found", "since")
    return sure.unionByName(exact), suspects.agg(F.max("n")).first()[0] or 0


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target is absent.

    refs: (src_table, src_field, rec_id, parent, ref, at), ref as written, or keyed_references() of these; parents: (parent, ref, since). Gives
    (src_table, src_field, rec_id, at, ref_state) with `missing` where no such key exists and `late` where the key came
    after the row that refers to it. A null or blank ref is no reference; a null time is never late; an empty parent
    table makes every reference missing; repeated rows are the caller's to dedupe."""
    keyed = refs if "key" in refs.columns else keyed_references(refs)
    states, most = reference_states(keyed, _with_key(parents.select("parent", "ref", "since")).drop("ref"))
    # The problem keys are few; the rows of one key are spread over salts, so that no task gets a hot key whole.
    salts = max(1, -(-most // SALT_ROWS))
    salted = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = keyed.withColumn("salt", F.pmod(F.xxhash64("rec_id", "src_field"), F.lit(salts)).cast("int"))
    state = F.when(~F.col("found"), "missing").when(F.col("since") > F.col("at"), "late")
    return (
        rows.join(salted, ["parent", "key", "salt"])
        .select("src_table", "src_field", "rec_id", "at", state.alias("ref_state"))
        .filter(F.col("ref_state").isNotNull())
    )


def orphan_report(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """References, missing and late ones, per table, field and month of the referring row; a null time is month null."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    keyed = refs if "key" in refs.columns else _with_key(refs)
    total = keyed.groupBy("src_table", "src_field", month).agg(F.count("*").alias("n_refs"))
    bad = orphans.groupBy("src_table", "src_field", month).agg(F.count_if(F.col("ref_state") == "missing").alias("n_missing"), F.count_if(F.col("ref_state") == "late").alias("n_late"))
    on = (total.src_table == bad.src_table) & (total.src_field == bad.src_field) & total.month.eqNullSafe(bad.month)
    return total.join(bad, on, "left").select(total.src_table, total.src_field, total.month, "n_refs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_missing", "n_late")])
