"""Lists, cells, screens, changes of state and merges over the data folder, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import geo, hashing, names
from docketry.functions.text import NONDISCLOSURE_WORDS, SEARCH_WORDS
from docketry.operators import cases as C
from docketry.operators import cells, lists, merge, pipeline, register, states
from docketry.operators.cases import penalty_ratio, penalty_window
from docketry.plans import records
from docketry.plans.catalogs import FORUMS, RULES
from docketry.plans.statistics import _PENALTY, _WINDOW, _sql_cell
from docketry.plans.views import sql, view
from docketry.rules.compile import flags, readable
from docketry.session import table
from docketry.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Resolution of the cells, coarse enough that they hold several cases.
RES = 2


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# -- lists ----------------------------------------------------------------------------------------------------------


def actor_list(spark: SparkSession, d: str, role: str | None = None, jurisdiction: str | None = None) -> DataFrame:
    a = view(spark, d, "actors", "role", "jurisdiction", "display_name")
    return lists.filtered(a, role=role, jurisdiction=jurisdiction).orderBy("display_name", "actor_id")


@query(sql("actors") + "SELECT 'judge' AS asked, actor_id, display_name FROM actors WHERE role = 'judge' UNION ALL SELECT 'judge in AVL', actor_id, display_name FROM actors WHERE role = 'judge' AND jurisdiction = 'AVL' UNION ALL SELECT 'all', actor_id, display_name FROM actors")
def actors_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The list of actors under three sets of optional filters."""
    asked = (("judge", "judge", None), ("judge in AVL", "judge", "AVL"), ("all", None, None))
    out = [actor_list(spark, d, r, j).select(F.lit(n).alias("asked"), "actor_id", "display_name") for n, r, j in asked]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(sql("actors") + "SELECT actor_id FROM actors WHERE role = 'officer' AND contains(lower(concat_ws(' ', display_name, office, jurisdiction)), 'av')")
def register_search(spark: SparkSession, d: str) -> DataFrame:
    """Officers in whose name, office or jurisdiction a text stands."""
    a = lists.filtered(view(spark, d, "actors", "role", "display_name", "office", "jurisdiction"), role="officer", jurisdiction=None)
    return lists.containing(a, " AV ", "display_name", "office", "jurisdiction").select("actor_id")


@query(sql("findings") + "SELECT finding_id, actor_id, finding_type FROM findings WHERE finding_type = 'brady' AND actor_id IS NOT NULL ORDER BY created_at DESC NULLS FIRST, finding_id LIMIT 500")
def packages_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows of one kind, of any actor; findings stand in for packages."""
    f = view(spark, d, "findings", "actor_id", "finding_type", "created_at").filter("actor_id is not null")
    return lists.newest(lists.filtered(f, finding_type="brady", actor_id=None), "created_at", "finding_id", 500).select("finding_id", "actor_id", "finding_type")


@query(sql("cases", "prosecutors") + "SELECT c.case_id, 'heavy-sentence' AS rule, p.office FROM cases c JOIN prosecutors p USING (prosecutor_id) WHERE sentence_months >= 120 AND p.jurisdiction = 'AVL' ORDER BY c.inserted_at DESC NULLS FIRST, c.case_id LIMIT 200")
def flags_by_office(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest flags of the offices of a jurisdiction."""
    f = flags(records._context(spark, d), {"heavy-sentence": RULES["heavy-sentence"]}, ["case_id"])
    c = view(spark, d, "cases", "prosecutor_id", "inserted_at").join(lists.filtered(view(spark, d, "prosecutors", "office", "jurisdiction"), jurisdiction="AVL"), "prosecutor_id")
    return lists.newest(f.select("case_id", "rule").join(c, "case_id"), "inserted_at", "case_id").select("case_id", "rule", "office")


_LOOKED = ", ".join(f"('{c}', '{n}')" for c, n in FORUMS)


@query(sql("actors", "cases") + f", f(code, name) AS (VALUES {_LOOKED}), a AS (SELECT lower(trim(jurisdiction)) AS k FROM cases UNION ALL SELECT lower(trim(split_part(office, ' ', 1))) FROM actors) SELECT code, name, count(*) AS n FROM a LEFT JOIN f ON k = lower(code) OR k = lower(name) GROUP BY ALL")
def forum_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Forums that cases claim and offices begin with, by code or by name."""
    asked = view(spark, d, "cases", "jurisdiction").select(F.col("jurisdiction").alias("asked")).unionByName(view(spark, d, "actors", "office").select(F.split_part("office", F.lit(" "), F.lit(1)).alias("asked")))
    return lists.lookup(asked, "asked", spark.createDataFrame(FORUMS, "code string, name string")).groupBy("code", "name").agg(F.count("*").alias("n"))


@query(sql("cases") + "SELECT 'court_level' AS list, court_level AS value, count(*) AS n FROM cases WHERE court_level IS NOT NULL GROUP BY ALL UNION ALL SELECT 'case_type', case_type, count(*) FROM cases WHERE case_type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'charge_category', charge_category, count(*) FROM cases WHERE charge_category IS NOT NULL GROUP BY ALL")
def option_lists(spark: SparkSession, d: str) -> DataFrame:
    """What may be chosen for some fields of a case."""
    return lists.options(view(spark, d, "cases", "court_level", "case_type", "charge_category"), "court_level", "case_type", "charge_category")


@query(sql("findings") + "SELECT finding_type AS value, count(*) AS n FROM findings WHERE finding_type NOT IN ('brady', 'giglio', 'batson', 'due_process', 'discovery') GROUP BY 1")
def unknown_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of findings that a list of five does not know."""
    return lists.unknown_values(view(spark, d, "findings", "finding_type"), "finding_type", ("brady", "giglio", "batson", "due_process", "discovery"))


@query(sql("actors") + "SELECT actor_id FROM actors WHERE NOT (coalesce(contains(display_name, ';') OR length(display_name) - length(replace(display_name, ',', '')) >= 2 OR contains(lower(display_name), 'form field'), false) AND bar_number IS NULL)")
def panel_purge(spark: SparkSession, d: str) -> DataFrame:
    """Actors but for those whose name lists several people; a number shows that a person has touched the row."""
    return lists.without_panels(view(spark, d, "actors", "display_name", "bar_number"), F.col("bar_number").isNotNull()).select("actor_id")


# -- counts ---------------------------------------------------------------------------------------------------------


@query(sql("opinions") + "SELECT case_id, arg_min(citation, opinion_id) AS caption FROM opinions WHERE case_id IS NOT NULL AND citation IS NOT NULL GROUP BY 1")
def case_caption(spark: SparkSession, d: str) -> DataFrame:
    """One citation of every case: that of its first opinion that has one."""
    o = view(spark, d, "opinions", "case_id", "citation").filter("case_id is not null and citation is not null")
    return o.groupBy("case_id").agg(F.min_by("citation", "opinion_id").alias("caption"))


@query(sql("cases", "disclosed") + ", r AS (SELECT case_id, created_at::DATE AS day, count(*) AS n FROM disclosed WHERE case_id IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL) SELECT c.case_id, coalesce(arg_max(n, day), 0)::BIGINT AS n_latest FROM cases c LEFT JOIN r USING (case_id) GROUP BY 1")
def latest_counts(spark: SparkSession, d: str) -> DataFrame:
    """The latest count of every case, 0 if there is none; the items of a day stand in for a run's gaps."""
    x = view(spark, d, "disclosed", "case_id", "created_at").filter("case_id is not null and created_at is not null")
    runs = x.groupBy("case_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    latest = runs.groupBy("case_id").agg(F.max_by("n", "day").alias("n_latest"))
    return view(spark, d, "cases").join(latest, "case_id", "left").na.fill(0, ["n_latest"])


@query(records._PUBLISHABLE + ", n AS (SELECT matched_actor, count(*) AS n FROM m WHERE review_status = 'substantiated' GROUP BY 1) SELECT count(*) AS cards, coalesce(sum(n), 0)::BIGINT AS findings, max(n) AS most, count(*) FILTER (WHERE n > 1) AS several FROM p JOIN n ON n.matched_actor = p.actor_id")
def register_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the register: cards, findings, the most of one card, cards with several."""
    w = register.wall(records._actors(spark, d), records._findings(spark, d), records._holds(spark, d))
    return w.agg(F.count("*").alias("cards"), F.coalesce(F.sum("n_findings"), F.lit(0).cast("bigint")).alias("findings"), F.max("n_findings").alias("most"), F.count_if(F.col("n_findings") > 1).alias("several"))


@query()
def unresolved_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fields that name no one person: all, ambiguous, and collective ones."""
    q = pipeline.named_judges(view(spark, d, "cases", "judge", "jurisdiction"))[1]
    return q.agg(F.count("*").alias("n_open"), F.count_if(F.col("kind") == "ambiguous").alias("n_ambiguous"), F.count_if(F.col("kind") == "collective").alias("n_collective"))


@query("SELECT sha256(string_agg(n_nationkey::VARCHAR || chr(0) || n_name || chr(10), '' ORDER BY n_nationkey)) AS corpus_hash, count(*) AS n FROM nation")
def corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash of a small catalog in order."""
    return hashing.corpus_hash(table(spark, d, "nation"), F.col("n_nationkey"), F.col("n_nationkey").cast("string"), F.col("n_name"))


@query(sql("cases", "prosecutors") + f", pts AS (SELECT p.office, sentence_months::DOUBLE / plea_offer_months AS ratio, court_location_lat AS lat, court_location_lng AS lng FROM cases JOIN prosecutors p USING (prosecutor_id) WHERE {_WINDOW}), c AS (SELECT office, {_sql_cell(RES)} AS cell, ratio FROM pts) SELECT office, cell, count(*) AS n, round(avg(ratio), 6) AS mean_ratio FROM c WHERE cell IS NOT NULL GROUP BY ALL")
def penalty_by_office_and_cell(spark: SparkSession, d: str) -> DataFrame:
    """Mean trial penalty by office and cell: cases, prosecutors and cells joined."""
    c = view(spark, d, "cases", "prosecutor_id", "court_location_lat", "court_location_lng", *_PENALTY).filter(penalty_window())
    rows = c.join(view(spark, d, "prosecutors", "office"), "prosecutor_id").select("office", geo.cell_for(F.col("court_location_lat"), F.col("court_location_lng"), RES).alias("cell"), penalty_ratio().alias("ratio"))
    return rows.filter("cell is not null").groupBy("office", "cell").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


@query(
    sql("cases", "opinions", "disclosed", "findings")
    + ", o AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE text_completeness <> 'full') AS p, arg_min(citation, opinion_id) FILTER (WHERE citation IS NOT NULL) AS caption FROM opinions GROUP BY 1), x AS (SELECT case_id, count(*) AS n FROM disclosed GROUP BY 1), f AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE review_status = 'substantiated') AS s FROM findings GROUP BY 1) "
    + "SELECT c.case_id, docket_number, o.caption, coalesce(o.n, 0) AS n_opinions, coalesce(o.p, 0) AS n_partial, coalesce(x.n, 0) AS n_disclosed, coalesce(f.n, 0) AS n_findings, coalesce(f.s, 0) AS n_substantiated, coalesce(sentence_months >= 120, false) AS flagged FROM cases c LEFT JOIN o USING (case_id) LEFT JOIN x USING (case_id) LEFT JOIN f USING (case_id)"
)
def case_packages(spark: SparkSession, d: str) -> DataFrame:
    """What is held on every case, joined: each side is counted before it meets the case."""
    o = view(spark, d, "opinions", "case_id", "text_completeness", "citation").filter("case_id is not null")
    o = o.groupBy("case_id").agg(F.count("*").alias("n_opinions"), F.count_if(F.col("text_completeness") != "full").alias("n_partial"), F.min_by("citation", F.when(F.col("citation").isNotNull(), F.col("opinion_id"))).alias("caption"))
    x = view(spark, d, "disclosed", "case_id").filter("case_id is not null").groupBy("case_id").agg(F.count("*").alias("n_disclosed"))
    f = view(spark, d, "findings", "case_id", "review_status").filter("case_id is not null").groupBy("case_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("review_status") == "substantiated").alias("n_substantiated"))
    c = view(spark, d, "cases", "docket_number", "sentence_months").withColumn("flagged", F.coalesce(F.col("sentence_months") >= 120, F.lit(False)))
    out = c.join(o, "case_id", "left").join(x, "case_id", "left").join(f, "case_id", "left").na.fill(0, ["n_opinions", "n_partial", "n_disclosed", "n_findings", "n_substantiated"])
    return out.select("case_id", "docket_number", "caption", "n_opinions", "n_partial", "n_disclosed", "n_findings", "n_substantiated", "flagged")


# -- cells ----------------------------------------------------------------------------------------------------------

#: Cases have one point; a second one, half a degree north, stands in for where the incident was.
_CELLS = f", pts AS (SELECT case_id, outcome, plea_accepted, sentence_months, court_location_lat AS lat, court_location_lng AS lng FROM cases UNION ALL SELECT case_id, outcome, plea_accepted, sentence_months, court_location_lat + 0.5, court_location_lng FROM cases), t AS (SELECT DISTINCT case_id, outcome, plea_accepted, sentence_months, {_sql_cell(RES)} AS cell FROM pts), s AS (SELECT cell, count(*) AS n_cases, count(*) FILTER (WHERE outcome = 'conviction') AS n_convictions, count(*) FILTER (WHERE plea_accepted) AS n_pleas, avg(sentence_months) FILTER (WHERE outcome = 'conviction') AS mean_sentence FROM t WHERE cell IS NOT NULL GROUP BY cell) "


def _cell_stats(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cases", "court_location_lat", "court_location_lng", "outcome", "plea_accepted", "sentence_months")
    lat, lng = F.col("court_location_lat"), F.col("court_location_lng")
    return cells.cell_stats(cells.touches(c, [(lat, lng), (lat + 0.5, lng)], RES, "outcome", "plea_accepted", "sentence_months"))


@query(sql("cases") + _CELLS + "SELECT cell, n_cases, n_convictions, n_pleas, round(mean_sentence, 6) AS mean_sentence, round(n_convictions / n_cases, 6) AS rate FROM s")
def cell_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every cell that a case touches by its court or its incident."""
    return _cell_stats(spark, d).withColumn("mean_sentence", F.round("mean_sentence", 6)).withColumn("rate", F.round("rate", 6))


_STEPS = ", ".join(f"({q}, {r})" for q in range(-2, 3) for r in range(max(-2, -q - 2), min(2, -q + 2) + 1))


@query(sql("cases") + _CELLS + f", k(dq, dr) AS (VALUES {_STEPS}), x AS (SELECT s.cell, 'hx{RES}_' || (split_part(s.cell, '_', 2)::BIGINT + dq) || '_' || (split_part(s.cell, '_', 3)::BIGINT + dr) AS near FROM s, k) SELECT x.cell, sum(n_cases)::BIGINT AS n_cases, sum(n_convictions)::BIGINT AS n_convictions, round(sum(n_convictions) / sum(n_cases), 6) AS rate FROM x JOIN s ON s.cell = x.near GROUP BY x.cell")
def kring_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with those within two steps."""
    return cells.ring_stats(_cell_stats(spark, d), 2).withColumn("rate", F.round("rate", 6))


@query(sql("cases") + f", pts AS (SELECT case_id, outcome, court_location_lat AS lat, court_location_lng AS lng FROM cases) SELECT case_id, CASE WHEN outcome = 'conviction' THEN 'kept' ELSE {_sql_cell(8)} END AS cell FROM pts")
def backfill_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells filled in where there are none yet."""
    c = view(spark, d, "cases", "court_location_lat", "court_location_lng", "outcome").withColumn("cell", F.when(F.col("outcome") == "conviction", "kept"))
    return cells.backfilled(c, "cell", F.col("court_location_lat"), F.col("court_location_lng"), 8).select("case_id", "cell")


# -- screens --------------------------------------------------------------------------------------------------------

_any = lambda words: " OR ".join(f"contains(lower(full_text), '{w}')" for w in words)
_HITS = ", ".join(f"('{f}', '{c}', '{s}')" for f, c, s, _ in pipeline.SCREEN)


@query(
    records.ORACLE["court_placement"].split("SELECT coalesce(forum")[0].replace("SELECT f.forum,", "SELECT c.case_id, f.forum,").replace(sql("cases").rstrip(), sql("cases", "opinions").rstrip())
    + f", t AS (SELECT case_id, bool_or({_any(SEARCH_WORDS)}) AS s, bool_or({_any(NONDISCLOSURE_WORDS)}) AS n FROM opinions WHERE full_text IS NOT NULL GROUP BY 1), "
    + f"d AS (SELECT c.case_id, coalesce({records._OFFER} < 0.5, false) AS trial_pressure, (coalesce(lower(evidence_strength) = 'weak', false) AND coalesce(outcome = 'conviction', false)) OR coalesce(t.n, false) AS due_process, coalesce(length(defendant_race) > 0, false) AND coalesce(lower(charge_category) IN ('drug', 'possession'), false) AND coalesce(outcome = 'conviction', false) AS equal_protection, coalesce(t.s, false) AS search FROM cases c LEFT JOIN t USING (case_id)), "
    + f"h(feature, clause_id, severity) AS (VALUES {_HITS}) SELECT clause_id, severity, 'no_holding' AS status, count(*) AS n FROM d JOIN p USING (case_id) JOIN h ON CASE feature WHEN 'trial_pressure' THEN trial_pressure WHEN 'due_process' THEN due_process WHEN 'search' THEN search ELSE equal_protection END WHERE coalesce(p.forum, p.claimed) IS NOT NULL GROUP BY ALL"
)
def screen_cases(spark: SparkSession, d: str) -> DataFrame:
    """The clauses that the facts and all texts of cases are leads to, counted."""
    c = view(spark, d, "cases", "source_court_id", "jurisdiction", "court_level")
    placed = C.placed(c, records._placements(spark, d), tuple(x for x, _ in FORUMS))
    opinions = view(spark, d, "opinions", "case_id", "full_text").filter("case_id is not null")
    hits = pipeline.screen(records._context(spark, d), placed, opinions).select(F.explode("screen").alias("h"))
    return hits.groupBy("h.clause_id", "h.severity", "h.status").agg(F.count("*").alias("n"))


# -- states and merges ----------------------------------------------------------------------------------------------

#: From each state of a finding, those that may follow.
NEXT = {"pending": ("substantiated", "rejected")}


@query(
    sql("findings")
    + ", q AS (SELECT *, CASE finding_type WHEN 'brady' THEN 'substantiated' WHEN 'batson' THEN 'rejected' WHEN 'giglio' THEN 'closed' END AS want FROM findings) SELECT CASE WHEN review_status = 'pending' AND want IN ('substantiated', 'rejected') THEN want ELSE review_status END AS review_status, count(*) AS n, count(*) FILTER (WHERE want IS NOT NULL AND want IS DISTINCT FROM review_status AND NOT coalesce(review_status = 'pending' AND want IN ('substantiated', 'rejected'), false)) AS n_refused FROM q GROUP BY 1"
)
def review_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Findings by state after requests for three types, and how many were refused."""
    f = view(spark, d, "findings", "finding_type", "review_status")
    to = F.when(F.col("finding_type") == "brady", "substantiated").when(F.col("finding_type") == "batson", "rejected").when(F.col("finding_type") == "giglio", "closed")
    changed, refused = states.transition(f, f.select("finding_id", to.alias("to"), F.lit(1).alias("at")).filter("to is not null"), "finding_id", "review_status", NEXT)
    out = changed.join(refused.select("finding_id", F.lit(1).alias("_no")), "finding_id", "left")
    return out.groupBy("review_status").agg(F.count("*").alias("n"), F.count("_no").alias("n_refused"))


@query(
    sql("findings", "actors") + records._MATCH + records._HOLDS
    + ", g AS (SELECT DISTINCT matched_actor FROM m WHERE review_status = 'substantiated'), r AS (SELECT a.actor_id, h.actor_id IS NOT NULL AS held, g.matched_actor IS NOT NULL AS grounds FROM actors a LEFT JOIN h USING (actor_id) LEFT JOIN g ON g.matched_actor = a.actor_id) "
    + "SELECT CASE WHEN grounds THEN 'approved' WHEN held THEN 'held' ELSE 'none' END AS state, count(*) AS n FROM r GROUP BY 1"
)
def publication_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every actor is asked to be approved: those with a substantiated finding are, others keep what they had."""
    a = records._actors(spark, d)
    grounds = register.actor_matches(register.gated(records._findings(spark, d)), a).select(F.col("matched_actor").alias("actor_id"))
    asked = a.select("actor_id", F.lit(True).alias("approved"), F.lit(1).alias("at"))
    # holds of actors that are not registered are not asked about
    merged, _ = states.hold(records._holds(spark, d).join(a.select("actor_id"), "actor_id", "left_semi"), asked, grounds)
    word = F.when(F.col("approved"), "approved").when(~F.col("approved"), "held").otherwise("none")
    return a.select("actor_id").join(merged, "actor_id", "left").groupBy(word.alias("state")).agg(F.count("*").alias("n"))


@query(
    records.ORACLE["renormalize_merge"].replace(sql("actors").rstrip(), sql("actors", "findings").rstrip()).replace("SELECT actor_id, first_value", ", s AS (SELECT actor_id, first_value") + "), "
    + "c AS (SELECT coalesce(s.survivor_id, f.actor_id) AS actor_id, f.case_id, f.finding_type FROM findings f LEFT JOIN s USING (actor_id)) SELECT actor_id, count(*) AS n_findings, count(DISTINCT coalesce(case_id, '-') || finding_type) AS n_links FROM c WHERE actor_id IS NOT NULL GROUP BY 1"
)
def merge_children(spark: SparkSession, d: str) -> DataFrame:
    """Findings of merged actors follow the survivor, and of links that collide one is left."""
    a = view(spark, d, "actors", "role", "display_name", "jurisdiction", "bar_number", "badge_number", "prosecutor_id")
    fp = names.fingerprint(F.col("role"), names.normalize_name(F.col("display_name")), F.col("jurisdiction"), F.col("bar_number"), F.col("badge_number"))
    merged = merge.survivors(a, "actor_id", fp, [F.col("prosecutor_id").isNull()])
    f = view(spark, d, "findings", "actor_id", "case_id", "finding_type").filter("actor_id is not null")
    moved = merge.repoint(f, merged, "actor_id").groupBy("actor_id").agg(F.count("*").alias("n_findings"))
    links = f.select("actor_id", F.coalesce("case_id", F.lit("-")).alias("case_id"), "finding_type", "finding_id")
    left = merge.repoint(links, merged, "actor_id", ["actor_id", "case_id", "finding_type"]).filter("finding_type is not null").groupBy("actor_id").agg(F.count("*").alias("n_links"))
    return moved.join(left, "actor_id", "left").na.fill(0, ["n_links"])


@query("SELECT * FROM (VALUES ('plea-coercion', true), ('selective-prosecution', true), ('trial-pressure', true), ('heavy-sentence', true), ('no-rule', false)) t(name, valid)")
def rule_registry(spark: SparkSession, d: str) -> DataFrame:
    """Rules that are offered, and whether they can be read."""
    good, bad = readable(RULES | {"no-rule": "when then flag"})
    return spark.createDataFrame([(n, n in good) for n in (*good, *bad)], "name string, valid boolean")


# -- public views ---------------------------------------------------------------------------------------------------

for _name, _view in (("register", records.wall_entries), ("register_records", records.wall_records_json), ("tracker", records.tracker), ("cells", cell_stats), ("options", option_lists)):
    sinks.public_view(_name)(_view)
