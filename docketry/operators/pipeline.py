"""The run of a case as one DataFrame: forum, screening, evidence leads, rules, links to officials, score; and its summary.

Every stage is a set-based transform over all queued cases. A stage of a case is ok, or skipped where it has nothing to
work on; a case is ok if all its stages are, else partial."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import names
from docketry.functions.text import mentions_nondisclosure, mentions_search
from docketry.operators import authority, evidence
from docketry.operators.similar import similar_pairs
from docketry.operators.upsert import inserted
from docketry.rules.compile import flags
from docketry.session import materialize

#: Similarity of normal forms from which a name is taken for a registered one.
SIMILAR = 0.86
STAGES = ("forum", "screen", "evidence_leads", "rules", "actor_links", "score")
# The clauses that a feature is a lead to: feature, clause, severity, incorporation.
SCREEN = (
    ("trial_pressure", "amend.06.jury", "high", "incorporated"), ("trial_pressure", "amend.06.counsel", "high", "incorporated"), ("due_process", "amend.14.due_process", "high", "not_applicable"), ("due_process", "amend.05.due_process", "medium", "incorporated"),
    ("search", "amend.04.search_seizure", "medium", "incorporated"), ("equal_protection", "amend.14.equal_protection", "medium", "not_applicable"),
)


@dataclass(frozen=True)
class Catalogs:
    """The tables of authority.resolve()."""

    clauses: DataFrame
    forums: DataFrame
    holdings: DataFrame
    splits: DataFrame


def no_holdings(placed: DataFrame) -> Catalogs:
    """The clauses of SCREEN and the forums that cases are placed in, without circuits, holdings and splits."""
    empty = placed.sparkSession.createDataFrame
    forums = placed.filter("forum != 'unknown'").select(F.col("forum").alias("code"), F.lit(None).cast("string").alias("circuit"), (F.col("forum") == "US").alias("is_federal")).distinct()
    return Catalogs(
        empty([(c, i) for _, c, _, i in SCREEN], "clause_id string, incorporation string"),
        forums,
        empty([], "holding_id string, clause_ids array<string>, court_kind string, court_id string, year int, authority string, superseded_by string, ordinal int"),
        empty([], "clause_id string, side_a array<string>, side_b array<string>"),
    )


def named_judges(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, jurisdiction, name) of every judge a case names, and (case_id, raw, kind, reason) of fields that name none
    or can be read in several ways. Each typed field is read once; null fields are in neither."""
    fields = cases.select(F.col("judge").alias("_raw")).distinct().filter("_raw is not null").withColumn("p", names.parse_officials(F.col("_raw")))
    read = cases.select("case_id", "jurisdiction", "judge").join(fields, F.col("judge") == F.col("_raw"))
    people = read.select("case_id", "jurisdiction", F.explode("p.names").alias("name"))
    queue = read.filter("p.kind != 'individuals'").select("case_id", F.col("judge").alias("raw"), "p.kind", "p.reason")
    return people, queue.dropDuplicates(["case_id", "raw"])


def resolve(people: DataFrame, actors: DataFrame, role: str) -> DataFrame:
    """(jurisdiction, name, actor_id, similarity): the registered official of a role and jurisdiction that a name means.

    An equal normal form has similarity 1; else the most similar one from SIMILAR up. Ties go to the smallest id; names
    that mean nobody have no row. Distinct names are compared, and only those that share parts (see operators.similar)."""
    wanted = people.select(F.col("jurisdiction").alias("scope"), "name").distinct().withColumn("text", names.normalize_name(F.col("name")))
    known = actors.filter(F.col("role") == role).select(F.col("jurisdiction").alias("scope"), "actor_id", names.normalize_name(F.col("display_name")).alias("text"))
    # of equal forms the smallest id
    first = known.groupBy("scope", F.col("text").alias("b")).agg(F.min("actor_id").alias("actor_id"))
    near = similar_pairs(wanted, known, SIMILAR).join(first, ["scope", "b"]).withColumnRenamed("a", "text")
    found = wanted.join(near, ["scope", "text"]).select(F.col("scope").alias("jurisdiction"), "name", "actor_id", "similarity")
    return evidence.first_wins(found, [F.col("jurisdiction"), F.col("name")], [F.desc("similarity"), F.col("actor_id")])


def actor_links(cases: DataFrame, actors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, actor_id, role_in_case) of prosecutors and judges, and the fields that wait for a person."""
    people, queue = named_judges(cases)
    judges = people.join(resolve(people, actors, "judge"), ["jurisdiction", "name"]).select("case_id", "actor_id", F.lit("judge").alias("role_in_case"))
    by = actors.filter("prosecutor_id is not null").groupBy("prosecutor_id").agg(F.min("actor_id").alias("actor_id"))
    prosecutors = cases.join(by, "prosecutor_id").select("case_id", "actor_id", F.lit("prosecutor").alias("role_in_case"))
    return prosecutors.unionByName(judges).distinct(), queue


def new_unresolved(known: DataFrame, queue: DataFrame) -> DataFrame:
    """Fields of actor_links()'s queue that do not wait yet, one per case and field; known: (case_id, raw)."""
    return inserted(known, queue, ["case_id", "raw"])


def with_actors(flags_: DataFrame, links: DataFrame) -> DataFrame:
    """Flags (case_id, actor_id, ...) with an actor where they had none: the case's prosecutor, else its judge, the smallest
    id of several; an actor that is there stays."""
    first = links.groupBy("case_id").agg(F.min(F.struct(F.col("role_in_case") != "prosecutor", "actor_id"))["actor_id"].alias("_a"))
    return flags_.join(first, "case_id", "left").withColumn("actor_id", F.coalesce("actor_id", "_a")).drop("_a")


def public_actors(prosecutors: DataFrame, cases: DataFrame) -> DataFrame:
    """Officials that public records name: prosecutors, and judges of cases, one per fingerprint."""
    people, _ = named_judges(cases)
    p = prosecutors.select(F.lit("prosecutor").alias("role"), F.col("name").alias("display_name"), "jurisdiction", "prosecutor_id")
    j = people.select(F.lit("judge").alias("role"), F.col("name").alias("display_name"), "jurisdiction", F.lit(None).cast("string").alias("prosecutor_id"))
    none = F.lit(None).cast("string")
    keyed = p.unionByName(j.distinct()).withColumn("normalized_name", names.normalize_name(F.col("display_name"))).filter("normalized_name != ''")
    keyed = keyed.withColumn("fingerprint", names.fingerprint(F.col("role"), F.col("normalized_name"), F.col("jurisdiction"), none, none))
    return evidence.first_wins(keyed, [F.col("fingerprint")], [F.col("prosecutor_id").isNull(), F.col("display_name")])


def screen(contexts: DataFrame, placed: DataFrame, opinions: DataFrame, catalogs: Catalogs | None = None, gaps_before: DataFrame | None = None) -> DataFrame:
    """(case_id, screened, screen, screen_authority, n_texts): the clauses that the facts and all opinion texts of a case are
    leads to, each a struct of clause_id, severity, status and binding. Of gaps_before, (case_id, gaps_found), more than 0
    are a lead too.

    Cases in no forum that the catalogs know are not screened. Clauses that don't apply to a case's forum and level are
    dropped; authority is unsettled if a clause is, else controlling. Both text tests are aggregated before the join."""
    catalogs = catalogs or no_holdings(placed)
    read = opinions.filter("full_text is not null").groupBy("case_id").agg(F.count("*").alias("n_texts"), F.bool_or(mentions_search(F.col("full_text"))).alias("_search"), F.bool_or(mentions_nondisclosure(F.col("full_text"))).alias("_undisclosed"))
    at = placed.select("case_id", F.col("forum").alias("code"), *[F.col(c).alias("_level") for c in placed.columns if c == "forum_level"])
    out = contexts.select("case_id", "features", F.col("case.court_level").alias("court_level")).join(at, "case_id", "left").join(read, "case_id", "left")
    if "_level" in out.columns:
        out = out.withColumn("court_level", F.col("_level"))
    gaps = F.lit(False)
    if gaps_before is not None:
        out = out.join(gaps_before.groupBy("case_id").agg((F.max("gaps_found") > 0).alias("_gaps")), "case_id", "left")
        gaps = F.coalesce("_gaps", F.lit(False))
    # every clause of every forum and level that occur: a small table, so nothing is exploded per case
    asked = out.filter("code is not null").select("code", "court_level").distinct().withColumn("clause_id", F.explode(F.array(*[F.lit(c) for _, c, _, _ in SCREEN])))
    resolved = authority.resolve(asked, catalogs.clauses, catalogs.forums, catalogs.holdings, catalogs.splits).dropDuplicates(["code", "court_level", "clause_id"])
    applies = F.collect_list(F.when(F.col("status") != "inapplicable", F.struct("clause_id", F.struct("status", "binding").alias("r"))))
    by_forum = resolved.groupBy(F.col("code").alias("_c"), F.col("court_level").alias("_l")).agg(F.map_from_entries(applies).alias("_r"))
    out = out.join(by_forum, (F.col("code") == F.col("_c")) & F.col("court_level").eqNullSafe(F.col("_l")), "left")
    found = {
        "trial_pressure": F.col("features.trial_pressure"),
        "due_process": F.col("features.due_process") | F.coalesce("_undisclosed", F.lit(False)) | gaps,
        "search": F.col("features.search") | F.coalesce("_search", F.lit(False)),
        "equal_protection": F.col("features.equal_protection"),
    }
    hit = lambda f, c, severity: F.when(found[f] & F.col("_r")[c].isNotNull(), F.struct(F.lit(c).alias("clause_id"), F.lit(severity).alias("severity"), F.col("_r")[c]["status"].alias("status"), F.col("_r")[c]["binding"].alias("binding")))
    out = out.withColumn("screen", F.array_compact(F.array(*[hit(f, c, severity) for f, c, severity, _ in SCREEN])))
    settled = F.when(F.exists("screen", lambda h: h["status"] == "unsettled"), "unsettled").otherwise("controlling")
    screened = F.col("_r").isNotNull()
    return out.select("case_id", screened.alias("screened"), "screen", F.when(screened, settled).alias("screen_authority"), "n_texts")


def run_cases(contexts: DataFrame, placed: DataFrame, opinions: DataFrame, disclosed: DataFrame, links: DataFrame, scores: DataFrame, rules: dict[str, str], catalogs: Catalogs | None = None, gaps_before: DataFrame | None = None) -> DataFrame:
    """(case_id, status, stages, screen, screen_authority, screen_hits, n_leads, n_gaps, n_flags, n_links, best_score) of every
    case of contexts.

    contexts: cases.context(); placed: cases.placed(); opinions: (case_id, full_text); links: actor_links(); scores:
    register.scores(); catalogs, gaps_before: see screen(). Screening comes before evidence, so it never sees this run's
    gaps."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    texts = opinions.filter("full_text is not null").join(contexts.select("case_id"), "case_id", "left_semi")
    # texts are read for leads once, though leads are counted and held against what was disclosed; and what was screened is a
    # table, so that the last plan joins counts alone
    leads = materialize(evidence.expected_items(texts, ["case_id"], "full_text").distinct(), "leads")
    best = links.join(scores.select("actor_id", "score"), "actor_id").groupBy("case_id").agg(F.max("score").alias("best_score"))
    parts = [placed.select("case_id", (F.col("forum") != "unknown").alias("has_forum")), count(leads, "n_leads"), count(evidence.gaps(leads, disclosed), "n_gaps"), count(flags(contexts, rules, ["case_id"]), "n_flags"), count(links, "n_links"), best]
    out = materialize(screen(contexts, placed, opinions, catalogs, gaps_before), "screened")
    for p in parts:
        out = out.join(p, "case_id", "left")
    out = out.na.fill(0, ["n_texts", "n_leads", "n_gaps", "n_flags", "n_links"])
    worked = {"forum": F.coalesce("has_forum", F.lit(False)), "screen": F.col("screened"), "evidence_leads": F.col("n_texts") > 0, "rules": F.lit(True), "actor_links": F.col("n_links") > 0, "score": F.col("best_score").isNotNull()}
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.when(worked[s], "ok").otherwise("skipped").alias("status")) for s in STAGES])
    all_ok = worked["forum"] & worked["screen"] & worked["evidence_leads"] & worked["actor_links"] & worked["score"]
    return out.select("case_id", F.when(all_ok, "ok").otherwise("partial").alias("status"), stages.alias("stages"), "screen", "screen_authority", F.size("screen").alias("screen_hits"), "n_leads", "n_gaps", "n_flags", "n_links", "best_score")


def summary(runs: DataFrame) -> DataFrame:
    """One row: cases by status as a map, and sums over all runs."""
    by = runs.groupBy("status").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("screen_hits", "n_leads", "n_gaps", "n_flags", "n_links")])
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    return by.agg(states.alias("by_status"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("screen_hits", "n_leads", "n_gaps", "n_flags", "n_links")])


def latest_runs(runs: DataFrame, at: str) -> DataFrame:
    """The newest run of every case; ties keep one."""
    w = Window.partitionBy("case_id").orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*[c for c in runs.columns if c != at]))
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
