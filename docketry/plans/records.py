"""Joins, rules, texts, names, the register, the ledger and the grid over the data folder, each with the SQL it is checked
against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import forum, geo, hashing, names, text
from docketry.operators import cases as C
from docketry.operators import hierarchy as H
from docketry.operators import evidence, ledger, pipeline, register, search, simulate, upsert
from docketry.operators.latest import latest_by
from docketry.operators.similar import similar_pairs
from docketry.plans.catalogs import FORUMS, RULES
from docketry.plans.statistics import _sql_cell
from docketry.plans.views import AS_OF, sql, view
from docketry.rules.compile import flags, new_flags
from docketry.session import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CONTEXT = (*C.FIELDS, "prosecutor_id")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# -- joins ----------------------------------------------------------------------------------------------------------


@query(sql("cases", "prosecutors") + "SELECT case_id, docket_number, p.name, p.office FROM cases LEFT JOIN prosecutors p USING (prosecutor_id)")
def case_prosecutor_left(spark: SparkSession, d: str) -> DataFrame:
    """Every case with its prosecutor, if there is one."""
    return view(spark, d, "cases", "docket_number", "prosecutor_id").join(view(spark, d, "prosecutors", "name", "office"), "prosecutor_id", "left").select("case_id", "docket_number", "name", "office")


@query(
    sql("findings")
    + ", f AS (SELECT finding_type, count(*) AS n FROM findings WHERE jurisdiction = 'AVL' AND review_status = 'substantiated' GROUP BY 1), g AS (SELECT finding_type, count(*) AS n FROM findings WHERE jurisdiction <> 'AVL' AND review_status = 'substantiated' GROUP BY 1) "
    + "SELECT finding_type, coalesce(f.n, 0) AS here, coalesce(g.n, 0) AS elsewhere FROM f FULL JOIN g USING (finding_type)"
)
def finding_type_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Findings by type in one jurisdiction and elsewhere: one conditional count in place of a full outer join."""
    f = register.gated(view(spark, d, "findings", "finding_type", "jurisdiction", "review_status")).filter("jurisdiction is not null and finding_type is not null")
    here = F.col("jurisdiction") == "AVL"
    return f.groupBy("finding_type").agg(F.count_if(here).alias("here"), F.count_if(~here).alias("elsewhere"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "findings", "actor_id", "prosecutor_id", "finding_type", "finding_date", "review_status")


def _actors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "actors", "prosecutor_id", "role", "display_name", "jurisdiction", "office")


_MATCH = ", m AS (SELECT f.*, a.actor_id AS matched_actor FROM findings f JOIN actors a ON f.actor_id = a.actor_id OR (f.actor_id IS NULL AND a.prosecutor_id IS NOT NULL AND f.prosecutor_id = a.prosecutor_id)) "


@query(sql("findings", "actors") + _MATCH + "SELECT matched_actor AS actor_id, count(*) AS n FROM m GROUP BY 1")
def actor_match_union(spark: SparkSession, d: str) -> DataFrame:
    """Findings per actor, matched by actor or, where none is named, by prosecutor."""
    m = register.actor_matches(view(spark, d, "findings", "actor_id", "prosecutor_id"), view(spark, d, "actors", "prosecutor_id"))
    return m.groupBy(F.col("matched_actor").alias("actor_id")).agg(F.count("*").alias("n"))


#: Actors on hold in the test data: those with a rejected finding in which someone died.
_HOLDS = ", h AS (SELECT DISTINCT actor_id FROM findings WHERE actor_id IS NOT NULL AND review_status = 'rejected' AND death_resulted) "


def _holds(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "findings", "actor_id", "review_status", "death_resulted").filter("actor_id is not null and review_status = 'rejected' and death_resulted")
    return f.select("actor_id").distinct().withColumn("approved", F.lit(False))


_PUBLISHABLE = sql("findings", "actors") + _MATCH + _HOLDS + ", p AS (SELECT * FROM actors a WHERE EXISTS (SELECT 1 FROM m WHERE m.matched_actor = a.actor_id AND review_status = 'substantiated') AND NOT EXISTS (SELECT 1 FROM h WHERE h.actor_id = a.actor_id)) "


@query(_PUBLISHABLE + "SELECT actor_id, role FROM p")
def publishable_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Actors that may be shown: with a substantiated finding, without a hold."""
    return register.publishable(_actors(spark, d), _findings(spark, d), _holds(spark, d)).select("actor_id", "role")


@query(_PUBLISHABLE + ", n AS (SELECT matched_actor, count(*) AS n FROM m WHERE review_status = 'substantiated' GROUP BY 1) SELECT actor_id, display_name, n AS n_findings FROM p JOIN n ON n.matched_actor = p.actor_id")
def wall_entries(spark: SparkSession, d: str) -> DataFrame:
    """Register cards with their number of findings."""
    return register.wall(_actors(spark, d), view(spark, d, "findings", "actor_id", "prosecutor_id", "finding_type", "finding_date", "review_status"), _holds(spark, d)).select("actor_id", "display_name", "n_findings")


@query(_PUBLISHABLE + ", n AS (SELECT *, (row_number() OVER (PARTITION BY matched_actor ORDER BY finding_date NULLS LAST, finding_id) - 1) // 1000 AS page FROM m WHERE review_status = 'substantiated'), r AS (SELECT matched_actor, page, string_agg(finding_type || '@' || coalesce(finding_date::VARCHAR, 'undated'), ';' ORDER BY finding_date NULLS LAST, finding_id) AS records FROM n GROUP BY ALL) SELECT p.actor_id, page::INTEGER AS page, records FROM p JOIN r ON r.matched_actor = p.actor_id")
def wall_records_json(spark: SparkSession, d: str) -> DataFrame:
    """The ordered records of every card, as texts of at most 1,000 records."""
    w = register.wall_records(_actors(spark, d), _findings(spark, d), _holds(spark, d))
    line = lambda x: F.concat(x["finding_type"], F.lit("@"), F.coalesce(x["finding_date"].cast("string"), F.lit("undated")))
    return w.select("actor_id", "page", F.array_join(F.transform("records", line), ";").alias("records"))


@query(
    _PUBLISHABLE
    + ", k AS (SELECT matched_actor, max(reviewed_at) AS last FROM m WHERE review_status = 'substantiated' AND finding_type = 'brady' GROUP BY 1) SELECT actor_id, display_name, last::VARCHAR AS last_review FROM p JOIN k ON k.matched_actor = p.actor_id WHERE last IS NOT NULL ORDER BY last DESC, actor_id LIMIT 200"
)
def tracker(spark: SparkSession, d: str) -> DataFrame:
    """The 200 publishable actors with the newest reviews of one kind of finding."""
    f = view(spark, d, "findings", "actor_id", "prosecutor_id", "finding_type", "finding_date", "review_status", "reviewed_at")
    last = register.actor_matches(register.gated(f).filter("finding_type = 'brady'"), _actors(spark, d)).groupBy("matched_actor").agg(F.max("reviewed_at").alias("last"))
    shown = register.publishable(_actors(spark, d), f, _holds(spark, d))
    out = shown.join(last, F.col("actor_id") == F.col("matched_actor")).filter("last is not null").orderBy(F.desc("last"), "actor_id").limit(200)
    return out.select("actor_id", "display_name", F.col("last").cast("string").alias("last_review"))


_FLAGS = ", flags AS (SELECT lower(replace(case_id, '-', '')) AS case_id, prosecutor_id, 'Heavy sentence' AS label FROM cases WHERE sentence_months >= 120) "


@query(
    sql("findings", "actors", "cases")
    + _MATCH
    + ", fl AS (SELECT a.actor_id AS matched_actor, 'Heavy sentence' AS source FROM cases c JOIN actors a ON c.prosecutor_id = a.prosecutor_id WHERE c.sentence_months >= 120), "
    + f"u AS (SELECT matched_actor, finding_type AS source, 1 AS f, 0 AS g, CASE WHEN finding_date >= DATE '{AS_OF}' - INTERVAL 5 YEAR THEN 1 ELSE 0 END AS r FROM m WHERE review_status = 'substantiated' UNION ALL SELECT matched_actor, source, 0, 1, 0 FROM fl), "
    + "s AS (SELECT matched_actor, sum(f)::BIGINT AS nf, sum(g)::BIGINT AS ng, count(DISTINCT source) AS ns, sum(r)::BIGINT AS nr FROM u GROUP BY 1) "
    + "SELECT actor_id, coalesce(nf, 0) AS n_findings, coalesce(ng, 0) AS n_flags, coalesce(ns, 0) AS n_sources, coalesce(nr, 0) AS n_recent, least(100, 12 * least(coalesce(nf, 0), 4) + 8 * least(coalesce(ng, 0), 3) + 6 * least(coalesce(ns, 0), 3) + CASE WHEN coalesce(nr, 0) > 0 THEN 10 ELSE 0 END)::DOUBLE AS score FROM actors LEFT JOIN s ON s.matched_actor = actor_id"
)
def abuse_score(spark: SparkSession, d: str) -> DataFrame:
    """The capped score of every actor from findings and from flags of heavy sentences."""
    c = view(spark, d, "cases", "prosecutor_id", "sentence_months").filter("sentence_months >= 120")
    raised = c.select(F.lit(None).cast("string").alias("actor_id"), "prosecutor_id", F.lit("Heavy sentence").alias("label"), F.lit("substantiated").alias("review_status"))
    return register.scores(_actors(spark, d).select("actor_id", "prosecutor_id"), _findings(spark, d), raised, AS_OF)


@query(sql("findings", "actors", "cases") + _MATCH + "SELECT matched_actor AS actor_id, 'finding' AS source_kind, finding_type AS label, count(*) AS n FROM m WHERE review_status = 'substantiated' GROUP BY ALL UNION ALL SELECT a.actor_id, 'flag', 'Heavy sentence', count(*) FROM cases c JOIN actors a ON c.prosecutor_id = a.prosecutor_id WHERE c.sentence_months >= 120 GROUP BY ALL")
def evidence_rows_union(spark: SparkSession, d: str) -> DataFrame:
    """What speaks about an actor, findings and flags as one list, counted."""
    f = register.actor_matches(register.gated(_findings(spark, d)), _actors(spark, d)).select("matched_actor", F.lit("finding").alias("source_kind"), F.col("finding_type").alias("label"))
    c = view(spark, d, "cases", "prosecutor_id", "sentence_months").filter("sentence_months >= 120").withColumn("actor_id", F.lit(None).cast("string"))
    g = register.actor_matches(c, _actors(spark, d)).select("matched_actor", F.lit("flag").alias("source_kind"), F.lit("Heavy sentence").alias("label"))
    return f.unionByName(g).groupBy(F.col("matched_actor").alias("actor_id"), "source_kind", "label").agg(F.count("*").alias("n"))


@query(sql("cases", "findings") + f"SELECT case_id, docket_number FROM cases c WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.case_id = c.case_id AND f.review_status IN ('substantiated', 'pending')) ORDER BY inserted_at, case_id LIMIT 200")
def pipeline_queue_anti(spark: SparkSession, d: str) -> DataFrame:
    """The 200 oldest cases without a finished run; findings stand in for runs here."""
    runs = view(spark, d, "findings", "case_id", "review_status").select("case_id", F.when(F.col("review_status").isin("substantiated", "pending"), "ok").otherwise("failed").alias("status"))
    return C.queue(view(spark, d, "cases", "docket_number", "inserted_at"), runs, 200).select("case_id", "docket_number")


@query(
    sql("cases", "findings")
    + ", x AS (SELECT case_id FROM cases WHERE jurisdiction = 'QLL' UNION SELECT case_id FROM findings WHERE jurisdiction = 'QLL' AND case_id IS NOT NULL) SELECT court_level, count(*) AS n FROM cases WHERE case_id IN (SELECT case_id FROM x) GROUP BY 1"
)
def cell_cases_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Cases that touch a jurisdiction by either of two paths."""
    c = view(spark, d, "cases", "jurisdiction", "court_level")
    ids = c.filter("jurisdiction = 'QLL'").select("case_id").union(view(spark, d, "findings", "case_id", "jurisdiction").filter("jurisdiction = 'QLL'").select("case_id")).distinct()
    return c.join(ids, "case_id", "left_semi").groupBy("court_level").agg(F.count("*").alias("n"))


@query(sql("findings") + "SELECT case_id, finding_id, finding_type FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY finding_date DESC NULLS LAST, finding_id) AS rn FROM findings WHERE case_id IS NOT NULL) WHERE rn = 1")
def latest_per_case(spark: SparkSession, d: str) -> DataFrame:
    """The newest finding of every case, undated last, ties by id."""
    f = view(spark, d, "findings", "case_id", "finding_type", "finding_date").filter("case_id is not null")
    return evidence.first_wins(f, [F.col("case_id")], [F.desc_nulls_last("finding_date"), F.col("finding_id")]).select("case_id", "finding_id", "finding_type")


@query(sql("cases", "findings", "opinions") + "SELECT c.case_id, coalesce(f.n, 0) AS n_findings, coalesce(o.n, 0) AS n_opinions, coalesce(o.p, 0) AS n_partial FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM findings GROUP BY 1) f USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE text_completeness <> 'full') AS p FROM opinions GROUP BY 1) o USING (case_id)")
def correlated_counts(spark: SparkSession, d: str) -> DataFrame:
    """Three counts per case: aggregate first, then join."""
    n = view(spark, d, "findings", "case_id").filter("case_id is not null").groupBy("case_id").agg(F.count("*").alias("n_findings"))
    o = view(spark, d, "opinions", "case_id", "text_completeness").filter("case_id is not null").groupBy("case_id").agg(F.count("*").alias("n_opinions"), F.count_if(F.col("text_completeness") != "full").alias("n_partial"))
    return view(spark, d, "cases").join(n, "case_id", "left").join(o, "case_id", "left").na.fill(0)


@query(
    sql("actors")
    + ", n AS (SELECT actor_id, role, jurisdiction, translate(normalized_name, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#%&') AS nm FROM actors WHERE normalized_name IS NOT NULL AND role IS NOT NULL AND jurisdiction IS NOT NULL), p AS (SELECT a.actor_id, b.actor_id AS other, 1 - levenshtein(a.nm, b.nm)::DOUBLE / greatest(length(a.nm), length(b.nm)) AS s FROM n a JOIN n b ON a.role = b.role AND a.jurisdiction = b.jurisdiction AND a.actor_id <> b.actor_id WHERE greatest(length(a.nm), length(b.nm)) > 0) "
    + "SELECT actor_id, other AS best_actor, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY s DESC, other) AS rn FROM p WHERE s >= 0.86) WHERE rn = 1"
)
def similarity_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The most similar other name of the same role and jurisdiction, from a similarity up; ties by id.

    Distinct names meet by shared parts, so a scope with many names is not compared with itself."""
    n = view(spark, d, "actors", "role", "jurisdiction", "normalized_name").dropna()
    n = n.select("actor_id", F.concat_ws("|", "role", "jurisdiction").alias("scope"), F.col("normalized_name").alias("text"))
    # the two smallest ids of a spelling are all that can be asked for
    first = n.groupBy("scope", "text").agg(F.min("actor_id").alias("_first"))
    least = n.join(first, ["scope", "text"]).groupBy("scope", "text").agg(F.array_distinct(F.array(F.min("actor_id"), F.min(F.when(F.col("actor_id") != F.col("_first"), F.col("actor_id"))))).alias("ids"))
    p = similar_pairs(n, n, 0.86).join(least.select("scope", F.col("text").alias("b"), "ids"), ["scope", "b"])
    # of the actors of a spelling the first that is not the actor itself
    own = n.join(p.withColumnRenamed("a", "text"), ["scope", "text"]).select("actor_id", F.try_element_at(F.array_remove("ids", F.col("actor_id")), F.lit(1)).alias("best_actor"), "similarity")
    own = own.filter("best_actor is not null")
    return evidence.first_wins(own, [F.col("actor_id")], [F.desc("similarity"), F.col("best_actor")]).select("actor_id", "best_actor", F.round("similarity", 6).alias("similarity"))


# -- context and rules ----------------------------------------------------------------------------------------------


def _context(spark: SparkSession, d: str) -> DataFrame:
    return C.context(view(spark, d, "cases", *CONTEXT), view(spark, d, "prosecutors", "name", "office"))


_OFFER = "CASE WHEN plea_offered AND NOT plea_accepted AND outcome = 'conviction' AND plea_offer_months IS NOT NULL AND sentence_months > 0 THEN plea_offer_months::DOUBLE / sentence_months END"


@query(sql("cases", "prosecutors") + f"SELECT case_id, p.office, outcome, round({_OFFER}, 6) AS plea_sentence_ratio FROM cases LEFT JOIN prosecutors p USING (prosecutor_id)")
def case_context_flat(spark: SparkSession, d: str) -> DataFrame:
    """The nested context of every case, flattened."""
    return _context(spark, d).select("case_id", "case.office", "case.outcome", F.round("case.plea_sentence_ratio", 6).alias("plea_sentence_ratio"))


@query(
    sql("cases")
    + f"SELECT case_id, coalesce({_OFFER} < 0.5, false) AS trial_pressure, coalesce(lower(evidence_strength) = 'weak', false) AND coalesce(outcome = 'conviction', false) AS due_process, coalesce(length(defendant_race) > 0, false) AND coalesce(lower(charge_category) IN ('drug', 'possession'), false) AND coalesce(outcome = 'conviction', false) AS equal_protection FROM cases"
)
def derived_features(spark: SparkSession, d: str) -> DataFrame:
    """Boolean features of every case."""
    return _context(spark, d).select("case_id", "features.trial_pressure", "features.due_process", "features.equal_protection")


@query(sql("cases") + f"SELECT case_id FROM cases WHERE {_OFFER} < 0.5 AND evidence_strength = 'weak'")
def rule_plea_coercion(spark: SparkSession, d: str) -> DataFrame:
    """One rule, compiled."""
    return flags(_context(spark, d), {"plea-coercion": RULES["plea-coercion"]}, ["case_id"]).select("case_id")


@query(sql("cases") + f"SELECT case_id FROM cases WHERE {_OFFER} < 0.5 AND list_contains(charges, 'drug') UNION ALL SELECT case_id FROM cases WHERE charge_category IN ('drug', 'possession') AND outcome = 'conviction' AND defendant_race <> 'group_a'")
def rule_contains_in(spark: SparkSession, d: str) -> DataFrame:
    """Rules with contains and in; a missing value makes != false too."""
    return flags(_context(spark, d), {k: RULES[k] for k in ("trial-pressure", "selective-prosecution")}, ["case_id"]).select("case_id")


@query(
    sql("cases")
    + f"SELECT rule, severity, count(*) AS n FROM (SELECT 'plea-coercion' AS rule, 'high' AS severity FROM cases WHERE {_OFFER} < 0.5 AND evidence_strength = 'weak' UNION ALL SELECT 'selective-prosecution', 'medium' FROM cases WHERE charge_category IN ('drug', 'possession') AND outcome = 'conviction' AND defendant_race <> 'group_a' "
    + f"UNION ALL SELECT 'trial-pressure', 'high' FROM cases WHERE {_OFFER} < 0.5 AND list_contains(charges, 'drug') UNION ALL SELECT 'heavy-sentence', 'medium' FROM cases WHERE sentence_months >= 120) GROUP BY ALL"
)
def rules_all_flags(spark: SparkSession, d: str) -> DataFrame:
    """All rules over all cases in one scan, counted."""
    return flags(_context(spark, d), RULES, ["case_id"]).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(sql("cases", "findings") + f"SELECT case_id, 'heavy-sentence' AS rule FROM cases WHERE sentence_months >= 120 AND case_id NOT IN (SELECT case_id FROM findings WHERE case_id IS NOT NULL)")
def rule_flags_new_only(spark: SparkSession, d: str) -> DataFrame:
    """Flags of cases that had none before; findings stand in for earlier flags here."""
    fired = flags(_context(spark, d), {"heavy-sentence": RULES["heavy-sentence"]}, ["case_id"])
    known = view(spark, d, "findings", "case_id").filter("case_id is not null").select("case_id", F.lit("heavy-sentence").alias("rule"))
    return new_flags(fired, known, ["case_id", "rule"]).select("case_id", "rule")


@query(sql("findings") + "SELECT finding_id, office, review_status FROM findings WHERE review_status = 'pending' ORDER BY created_at DESC NULLS FIRST, finding_id LIMIT 200")
def flags_recent_topn(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest rows of one state."""
    f = view(spark, d, "findings", "office", "review_status", "created_at").filter("review_status = 'pending'")
    return f.orderBy(F.desc_nulls_first("created_at"), "finding_id").limit(200).select("finding_id", "office", "review_status")


@query(
    sql("cases")
    + "SELECT 'case' AS kind, case_id AS id FROM cases WHERE regexp_matches(lower(concat_ws(' ', docket_number, raw_data)), 'sealed|juvenile|expunged') OR coalesce(json_extract_string(CASE WHEN json_valid(raw_data) THEN raw_data END, '$.blocked') = 'true', false) "
    + "UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents WHERE regexp_matches(lower(concat_ws(' ', docket_number, text)), 'sealed|juvenile|expunged')"
)
def exclusion_filter(spark: SparkSession, d: str) -> DataFrame:
    """Cases and documents that must not be shown."""
    cases = view(spark, d, "cases", "docket_number", "raw_data").filter(text.is_excluded(F.col("docket_number"), F.col("raw_data"))).select(F.lit("case").alias("kind"), F.col("case_id").alias("id"))
    docs = table(spark, d, "documents").filter(text.is_excluded(F.col("docket_number"), F.col("text"))).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    return cases.unionByName(docs)


# -- texts ----------------------------------------------------------------------------------------------------------

_NAMED = "(?i)(?:interview(?:ed)?|statement(?:s)?)\\s+(?:with\\s+)?([A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+){0,2})"
_ITEMS = ", items AS (SELECT DISTINCT opinion_id, case_id, item_type, min(description) OVER (PARTITION BY opinion_id, item_type, lower(description) ORDER BY k) AS description0, first_value(description) OVER (PARTITION BY opinion_id, item_type, lower(description) ORDER BY k) AS description FROM (" + " UNION ALL ".join(
    f"SELECT opinion_id, case_id, '{t}' AS item_type, " + (f"replace('{tpl}', '{{}}', trim(m))" if "{}" in tpl else f"'{tpl}'") + f" AS description, k FROM (SELECT opinion_id, case_id, unnest(regexp_extract_all(full_text, '(?i){p}', {1 if '{}' in tpl else 0})) AS m, generate_subscripts(regexp_extract_all(full_text, '(?i){p}', {1 if '{}' in tpl else 0}), 1) AS k FROM opinions)" for t, p, tpl in evidence.PATTERNS
) + ")) "


@query(sql("opinions") + _ITEMS + "SELECT item_type, count(*) AS n, count(DISTINCT lower(description)) AS n_descriptions FROM (SELECT DISTINCT opinion_id, item_type, description FROM items) GROUP BY 1")
def evidence_extract(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that opinions mention, by type."""
    items = evidence.expected_items(view(spark, d, "opinions", "full_text"), ["opinion_id"], "full_text")
    return items.groupBy("item_type").agg(F.count("*").alias("n"), F.countDistinct(F.lower("description")).alias("n_descriptions"))


@query(
    sql("opinions", "disclosed")
    + _ITEMS
    + ", want AS (SELECT DISTINCT case_id, item_type, description FROM items WHERE case_id IS NOT NULL) SELECT item_type, count(*) AS n_gaps FROM want w WHERE NOT EXISTS (SELECT 1 FROM disclosed x WHERE x.case_id = w.case_id AND x.item_type = w.item_type AND (contains(lower(w.description), lower(x.description)) OR contains(lower(x.description), lower(w.description)))) GROUP BY 1"
)
def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Mentioned evidence for which nothing was disclosed, by type."""
    o = view(spark, d, "opinions", "case_id", "full_text").filter("case_id is not null")
    want = evidence.expected_items(o, ["case_id"], "full_text").distinct()
    return evidence.gaps(want, view(spark, d, "disclosed", "case_id", "item_type", "description")).groupBy("item_type").agg(F.count("*").alias("n_gaps"))


@query(sql("disclosed") + "SELECT case_id, item_type, description FROM (SELECT *, row_number() OVER (PARTITION BY case_id, item_type, lower(description) ORDER BY created_at, item_id) AS rn FROM disclosed) WHERE rn = 1")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first of items that differ in case only."""
    x = view(spark, d, "disclosed", "case_id", "item_type", "description", "created_at")
    return evidence.first_wins(x, [F.col("case_id"), F.col("item_type"), F.lower("description")], [F.asc_nulls_last("created_at"), F.col("item_id")]).select("case_id", "item_type", "description")


@query(
    sql("entries")
    + "SELECT entry_id, trim(replace(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(summary, '<[^>]*>', ' ', 'g'), '<[^>]*$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&#39;', ''''), '&#160;', ' '), '&amp;', '&'), '[\\s\\x{00a0}]+', ' ', 'g')), 'Original document', '')) AS plain FROM entries"
)
def strip_html_entries(spark: SparkSession, d: str) -> DataFrame:
    """Feed summaries as plain text."""
    return view(spark, d, "entries", "summary").select("entry_id", text.summary_text(F.col("summary")).alias("plain"))


@query("SELECT doc_id, regexp_extract(docket_number, '^[A-Za-z0-9:./-]*') AS docket FROM documents WHERE text IS NOT NULL AND length(regexp_extract(docket_number, '^[A-Za-z0-9:./-]*')) >= 4 AND regexp_matches(regexp_extract(docket_number, '^[A-Za-z0-9:./-]*'), '[0-9]')")
def docket_from_text(spark: SparkSession, d: str) -> DataFrame:
    """The docket number printed in a text: documents, under a caption that prints theirs, as the tables' texts print none."""
    printed = F.concat(F.lit("In the matter of Case No. "), F.col("docket_number"), F.lit(". "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.docket_from_text(printed).alias("docket")).filter("docket is not null")


@query(sql("entries") + "SELECT entry_id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) AS slug, CASE WHEN starts_with(link, 'http') THEN link ELSE 'https://records.example' || link END AS url FROM entries")
def slug(spark: SparkSession, d: str) -> DataFrame:
    """Titles as slugs and links made absolute."""
    e = view(spark, d, "entries", "title", "link")
    return e.select("entry_id", text.slug(F.col("title")).alias("slug"), text.absolute_url(F.col("link"), "https://records.example").alias("url"))


@query(sql("opinions") + "SELECT case_id, md5(string_agg(md5(full_text), chr(10) ORDER BY opinion_id)) AS text_md5 FROM opinions WHERE case_id IS NOT NULL GROUP BY 1")
def case_text_listagg(spark: SparkSession, d: str) -> DataFrame:
    """A hash of the opinion texts of a case in order: of the texts' own hashes, so that no task gathers texts."""
    o = view(spark, d, "opinions", "case_id", "full_text").filter("case_id is not null")
    parts = F.array_sort(F.collect_list(F.when(F.col("full_text").isNotNull(), F.struct("opinion_id", F.md5(F.col("full_text").cast("binary")).alias("h")))))
    return o.groupBy("case_id").agg(parts.alias("p")).select("case_id", F.when(F.size("p") > 0, F.md5(F.array_join(F.transform("p", lambda x: x["h"]), "\n").cast("binary"))).alias("text_md5"))


@query(sql("opinions") + "SELECT min(opinion_id) AS opinion_id, case_id, md5(full_text) AS text_md5, count(*) AS n FROM opinions GROUP BY case_id, md5(full_text)")
def opinion_upsert_md5(spark: SparkSession, d: str) -> DataFrame:
    """One row per case and text."""
    o = view(spark, d, "opinions", "case_id", "full_text").select("opinion_id", "case_id", F.md5(F.col("full_text").cast("binary")).alias("text_md5"))
    return o.groupBy("case_id", "text_md5").agg(F.min("opinion_id").alias("opinion_id"), F.count("*").alias("n"))


@query(sql("opinions") + "SELECT opinion_id, text_completeness FROM opinions o WHERE NOT (coalesce(text_completeness, '') <> 'full' AND source_ref IS NOT NULL AND EXISTS (SELECT 1 FROM opinions f WHERE f.text_completeness = 'full' AND f.source_ref = o.source_ref))")
def partial_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Opinions without the partial ones that a full text replaced."""
    return upsert.without_superseded(view(spark, d, "opinions", "source_ref", "text_completeness")).select("opinion_id", "text_completeness")


@query(
    sql("cases")
    + ", held AS (SELECT * FROM cases WHERE inserted_at < TIMESTAMP '2024-01-01'), new AS (SELECT * FROM cases WHERE inserted_at >= TIMESTAMP '2023-01-01') SELECT coalesce(h.case_id, n.case_id) AS case_id, coalesce(n.outcome, h.outcome) AS outcome, coalesce(h.judge, n.judge) AS judge, CASE WHEN n.case_id IS NOT NULL THEN n.court_level ELSE h.court_level END AS court_level FROM held h FULL JOIN new n ON h.case_id = n.case_id"
)
def case_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of cases merged: outcome takes the new value, judge keeps the old, the level is replaced."""
    c = view(spark, d, "cases", "outcome", "judge", "court_level", "inserted_at")
    held, new = c.filter("inserted_at < timestamp_ntz'2024-01-01'"), c.filter("inserted_at >= timestamp_ntz'2023-01-01'")
    return upsert.upsert(held, new, ["case_id"], {"outcome": "new", "judge": "old", "court_level": "replace"})


@query()
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 20 opinions that match a web query best."""
    o = view(spark, d, "opinions", "full_text")
    postings = search.stored(search.index(o, "opinion_id", "full_text"))
    return search.search(spark, postings, '"chain of custody" prosecutor -jury OR suppress', *search.corpus(postings))


@query()
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    """The 20 opinions that match a query by text, citation or reference, and by which."""
    o = view(spark, d, "opinions", "full_text", "citation", "source_ref")
    postings = search.stored(search.index(o, "opinion_id", "full_text"))
    return search.search_records(spark, postings, o.select(F.col("opinion_id").alias("id"), "citation", "source_ref"), ("citation", "source_ref"), "2021", *search.corpus(postings))


# -- names and forums -----------------------------------------------------------------------------------------------

_SQL_NORMAL = (
    "list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '\\s+'), lambda x: x <> '' AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in names.ENDINGS)
    + "], x))"
)
_SQL_NAME = "regexp_replace(array_to_string(" + _SQL_NORMAL + ", ' ') || ' ', '^((" + "|".join(names.TITLES) + ") )+', '')"


@query(sql("actors") + f"SELECT actor_id, trim({_SQL_NAME.format('display_name')}) AS normalized FROM actors")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of registered names."""
    return view(spark, d, "actors", "display_name").select("actor_id", names.normalize_name(F.col("display_name")).alias("normalized"))


@query(
    sql("actors")
    + f"SELECT actor_id, concat_ws('|', coalesce(role, ''), coalesce(trim({_SQL_NAME.format('display_name')}), ''), lower(trim(coalesce(jurisdiction, ''))), lower(trim(coalesce(bar_number, ''))), lower(trim(coalesce(badge_number, '')))) AS fingerprint FROM actors"
)
def name_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The key under which every actor is filed."""
    a = view(spark, d, "actors", "role", "display_name", "jurisdiction", "bar_number", "badge_number")
    return a.select("actor_id", names.fingerprint(F.col("role"), names.normalize_name(F.col("display_name")), F.col("jurisdiction"), F.col("bar_number"), F.col("badge_number")).alias("fingerprint"))


@query()
def parse_officials_explode(spark: SparkSession, d: str) -> DataFrame:
    """Judges that case fields name, or why they name none, counted."""
    judges = view(spark, d, "cases", "judge").groupBy("judge").agg(F.count("*").alias("n")).withColumn("p", names.parse_officials(F.col("judge")))
    return judges.select("p.kind", F.explode_outer("p.names").alias("name"), "n").groupBy("kind", "name").agg(F.sum("n").alias("n"))


@query(
    sql("actors")
    + f", k AS (SELECT actor_id, prosecutor_id, concat_ws('|', coalesce(role, ''), coalesce(trim({_SQL_NAME.format('display_name')}), ''), lower(trim(coalesce(jurisdiction, ''))), lower(trim(coalesce(bar_number, ''))), lower(trim(coalesce(badge_number, '')))) AS fp FROM actors) "
    + "SELECT actor_id, first_value(actor_id) OVER (PARTITION BY fp ORDER BY prosecutor_id IS NULL, actor_id) AS survivor_id FROM k"
)
def renormalize_merge(spark: SparkSession, d: str) -> DataFrame:
    """The survivor of every group of actors whose recomputed keys collide: those with a prosecutor first, then by id."""
    a = view(spark, d, "actors", "role", "display_name", "jurisdiction", "bar_number", "badge_number", "prosecutor_id")
    keyed = a.select("actor_id", "prosecutor_id", names.fingerprint(F.col("role"), names.normalize_name(F.col("display_name")), F.col("jurisdiction"), F.col("bar_number"), F.col("badge_number")).alias("fingerprint"))
    survivor = keyed.groupBy("fingerprint").agg(F.min(F.struct(F.col("prosecutor_id").isNull(), "actor_id"))["actor_id"].alias("survivor_id"))
    return keyed.join(survivor, "fingerprint").select("actor_id", "survivor_id")


def _courts(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every court, of equally late ones the largest."""
    kept = {c: F.col(c) for c in ("source_class", "full_name", "citation_string")}
    return latest_by(table(spark, d, "court_registry"), H.node_id(F.col("court_id")), [F.col("refreshed_at")], kept).withColumnRenamed("_key", "court_id")


def _placements(spark: SparkSession, d: str) -> DataFrame:
    """(court_id, jurisdiction, level, method) of every court."""
    return _courts(spark, d).select("court_id", forum.derive(F.col("court_id"), F.col("source_class"), F.col("full_name"), F.col("citation_string"), FORUMS).alias("f")).select("court_id", "f.*")


_SQL_COURTS = "WITH r AS (SELECT * FROM (SELECT lower(trim(court_id)) AS court_id, upper(trim(coalesce(source_class, ''))) AS cls, full_name, citation_string, row_number() OVER (PARTITION BY lower(trim(court_id)) ORDER BY refreshed_at DESC NULLS LAST, source_class DESC NULLS LAST, full_name DESC NULLS LAST, citation_string DESC NULLS LAST) AS rn FROM court_registry WHERE trim(court_id) <> '') WHERE rn = 1), "
_SQL_FORUM = "CASE " + " ".join(f"WHEN regexp_matches(' ' || coalesce({{0}}, '') || ' ', '(?i)[^A-Za-z0-9]{n}[^A-Za-z0-9]') THEN '{c}'" for c, n in sorted(FORUMS, key=lambda f: -len(f[1]))) + " END"


@query(
    _SQL_COURTS
    + f"x AS (SELECT *, {_SQL_FORUM.format('full_name')} AS by_name, {_SQL_FORUM.format('citation_string')} AS by_cite FROM r) "
    + "SELECT DISTINCT court_id, CASE WHEN cls = 'F' THEN 'US' WHEN cls = 'FD' THEN coalesce(by_name, 'US') ELSE coalesce(by_name, by_cite) END AS forum, CASE WHEN cls = 'F' THEN 'federal_circuit' WHEN cls = 'FD' AND by_name IS NOT NULL THEN 'federal_district_name' WHEN cls = 'FD' THEN 'federal_other' WHEN by_name IS NOT NULL THEN 'state_name' WHEN by_cite IS NOT NULL THEN 'state_citation' ELSE 'unmapped' END AS method FROM x"
)
def forum_derive(spark: SparkSession, d: str) -> DataFrame:
    """Where registered courts sit, and by which rule."""
    return _placements(spark, d).select("court_id", F.col("jurisdiction").alias("forum"), "method")


@query(
    _SQL_COURTS.replace("WITH r", sql("cases").rstrip() + ", r").rstrip()
    + f" x AS (SELECT *, {_SQL_FORUM.format('full_name')} AS by_name, {_SQL_FORUM.format('citation_string')} AS by_cite FROM r), "
    + "f AS (SELECT court_id, CASE WHEN cls = 'F' THEN 'US' WHEN cls = 'FD' THEN coalesce(by_name, 'US') ELSE coalesce(by_name, by_cite) END AS forum, CASE WHEN cls = 'F' THEN 'federal_circuit' WHEN cls = 'FD' AND by_name IS NOT NULL THEN 'federal_district_name' WHEN cls = 'FD' THEN 'federal_other' WHEN by_name IS NOT NULL THEN 'state_name' WHEN by_cite IS NOT NULL THEN 'state_citation' ELSE 'unmapped' END AS method FROM x), "
    + f"p AS (SELECT f.forum, f.method, CASE WHEN upper(trim(c.jurisdiction)) IN ({', '.join(repr(c) for c, _ in FORUMS)}) THEN upper(trim(c.jurisdiction)) END AS claimed FROM cases c LEFT JOIN f ON f.court_id = lower(trim(c.source_court_id))) "
    + "SELECT coalesce(forum, claimed, 'unknown') AS forum, CASE WHEN forum IS NOT NULL THEN method WHEN claimed IS NOT NULL THEN 'claimed' ELSE 'unknown' END AS forum_method, count(*) AS n FROM p GROUP BY ALL"
)
def court_placement(spark: SparkSession, d: str) -> DataFrame:
    """Cases by the forum their court is placed in: registry, claim, or unknown."""
    cases = view(spark, d, "cases", "source_court_id", "jurisdiction", "court_level")
    return C.placed(cases, _placements(spark, d), tuple(c for c, _ in FORUMS)).groupBy("forum", "forum_method").agg(F.count("*").alias("n"))


# -- the run of a case ----------------------------------------------------------------------------------------------


def _links(spark: SparkSession, d: str):
    return pipeline.actor_links(view(spark, d, "cases", "judge", "jurisdiction", "prosecutor_id"), _actors(spark, d))


@query()
def actor_link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links between officials and cases, per actor and role."""
    return _links(spark, d)[0].groupBy("actor_id", "role_in_case").agg(F.count("*").alias("n_cases"))


@query()
def unresolved_officials(spark: SparkSession, d: str) -> DataFrame:
    """Fields that name no one person, by reason: the 500 most frequent."""
    q = _links(spark, d)[1].groupBy("raw", "kind", "reason").agg(F.count("*").alias("n"))
    return q.orderBy(F.desc("n"), "raw").limit(500)


@query()
def public_record_actors(spark: SparkSession, d: str) -> DataFrame:
    """Officials that public records name, one per fingerprint."""
    return pipeline.public_actors(view(spark, d, "prosecutors", "name", "jurisdiction"), view(spark, d, "cases", "judge", "jurisdiction")).select("role", "display_name", "jurisdiction", "fingerprint")


@query()
def pipeline_runs(spark: SparkSession, d: str) -> DataFrame:
    """All six stages over all cases: the number of cases by status and by what was found."""
    c = view(spark, d, "cases", *CONTEXT, "source_court_id")
    # what several stages read is a table, so that no plan holds it twice
    contexts, links = materialize(_context(spark, d), "contexts"), materialize(_links(spark, d)[0], "links")
    courts = _placements(spark, d)
    none = spark.createDataFrame([], "actor_id string, prosecutor_id string, label string, review_status string")
    scores = materialize(register.scores(_actors(spark, d).select("actor_id", "prosecutor_id"), _findings(spark, d), none, AS_OF), "scores")
    opinions = view(spark, d, "opinions", "case_id", "full_text").filter("case_id is not null")
    placed = materialize(C.placed(c, courts, tuple(x for x, _ in FORUMS)).select("case_id", "forum", "forum_level"), "placed")
    runs = pipeline.run_cases(contexts, placed, opinions, view(spark, d, "disclosed", "case_id", "item_type", "description"), links, scores, RULES)
    return runs.groupBy("status").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("screen_hits", "n_leads", "n_gaps", "n_flags", "n_links")])


#: Statutes and the finding types that each answers.
_STATUTES = (("deprivation", ["brady", "giglio", "due_process"]), ("discrimination", ["batson"]), ("perjury", ["witness_subornation"]))


@query(
    sql("findings")
    + ", s(statute, types) AS (VALUES ('deprivation', ['brady', 'giglio', 'due_process']), ('discrimination', ['batson']), ('perjury', ['witness_subornation'])), t AS (SELECT DISTINCT office, finding_type FROM findings WHERE review_status = 'substantiated' AND office IS NOT NULL) SELECT DISTINCT office, statute FROM t JOIN s ON list_contains(types, finding_type)"
)
def statute_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Statutes that answer any finding type of an office: the overlap of two lists as an equi-join of their elements."""
    statutes = spark.createDataFrame(_STATUTES, "statute string, types array<string>").select("statute", F.explode("types").alias("finding_type"))
    f = register.gated(view(spark, d, "findings", "office", "finding_type", "review_status")).filter("office is not null").select("office", "finding_type").distinct()
    return f.join(statutes, "finding_type").select("office", "statute").distinct()


@query(sql("findings") + "SELECT office, array_to_string(list_sort(list(DISTINCT review_status || '=' || n)), ';') AS by_status FROM (SELECT office, review_status, count(*) AS n FROM findings WHERE office IS NOT NULL AND review_status IS NOT NULL GROUP BY ALL) GROUP BY office")
def status_map(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every office by state, as a map written out."""
    f = view(spark, d, "findings", "office", "review_status").dropna(subset=["office", "review_status"]).groupBy("office", "review_status").agg(F.count("*").alias("n"))
    m = f.groupBy("office").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_status", "n")))).alias("m"))
    return m.select("office", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("by_status"))


# -- grid, ledger, simulation ---------------------------------------------------------------------------------------


@query(sql("cases") + ", pts AS (SELECT case_id, court_location_lat AS lat, court_location_lng AS lng FROM cases) SELECT * FROM (" + " UNION ALL ".join(f"SELECT case_id, {r}::INTEGER AS res, {_sql_cell(r)} AS cell FROM pts" for r in geo.LADDER) + ") WHERE cell IS NOT NULL")
def hex_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The grid cells of every case at three resolutions."""
    c = view(spark, d, "cases", "court_location_lat", "court_location_lng")
    return c.select("case_id", F.explode(geo.ladder(F.col("court_location_lat"), F.col("court_location_lng"))).alias("l")).select("case_id", "l.res", "l.cell")


@query(
    sql("cases")
    + f", pts AS (SELECT outcome, court_location_lat AS lat, court_location_lng AS lng FROM cases), c AS (SELECT {_sql_cell(2)} AS cell, outcome FROM pts), b AS (SELECT cell, count(*) AS n, count(*) FILTER (WHERE outcome = 'conviction') AS k FROM c WHERE cell IS NOT NULL GROUP BY cell), "
    + "s(dq, dr) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)), x AS (SELECT b.cell, 'hx2_' || (split_part(b.cell, '_', 2)::BIGINT + dq) || '_' || (split_part(b.cell, '_', 3)::BIGINT + dr) AS near FROM b, s) "
    + "SELECT x.cell, sum(n)::BIGINT AS n_cases, sum(k)::BIGINT AS n_convictions, count(*) AS n_cells, round(sum(k) / nullif(sum(n), 0), 6) AS rate FROM x LEFT JOIN b ON b.cell = x.near GROUP BY x.cell"
)
def hex_kring(spark: SparkSession, d: str) -> DataFrame:
    """Cases and convictions of every cell together with its neighbours."""
    c = view(spark, d, "cases", "court_location_lat", "court_location_lng", "outcome")
    by = c.select(geo.cell_for(F.col("court_location_lat"), F.col("court_location_lng"), 2).alias("cell"), "outcome").filter("cell is not null").groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "conviction").alias("k"))
    ring = by.select("cell", F.explode(geo.k_ring(F.col("cell"), 1)).alias("near"))
    seen = ring.join(by.select(F.col("cell").alias("near"), "n", "k"), "near", "left").groupBy("cell").agg(F.sum("n").alias("n_cases"), F.sum("k").alias("n_convictions"), F.count("*").alias("n_cells"))
    return seen.withColumn("rate", F.round(F.col("n_convictions") / F.nullif("n_cases", F.lit(0)), 6))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    payload = hashing.canonical_json(event=F.col("event_id"), kind=F.col("event_type"), user=F.col("user_id"))
    return e.select("event_id", "event_type", payload.alias("payload"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_micros"))


@query("SELECT event_id, sha256('{\"event\":' || event_id || ',\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}') AS payload_hash FROM events")
def payload_hash_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of canonical payloads."""
    return _events(spark, d).select("event_id", hashing.payload_hash(F.col("payload")).alias("payload_hash"))


@query("SELECT count(*) AS entries, TRUE AS valid, 0::BIGINT AS first_bad_seq FROM events")
def ledger_verify_lag(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of all events, appended in order and verified; 0 for no bad entry."""
    return ledger.verify(ledger.append(_events(spark, d), ["event_id"])).na.fill(0, ["first_bad_seq"])


@query("WITH e AS (SELECT max(event_id) // 2 AS middle FROM events) SELECT count(*) AS entries, FALSE AS valid, (SELECT count(*) FROM events, e WHERE event_id <= middle)::BIGINT AS first_bad_seq FROM events")
def ledger_verify_tampered(spark: SparkSession, d: str) -> DataFrame:
    """The same with one payload changed after it was written: the first bad entry is named."""
    e = _events(spark, d)
    half = F.floor(F.get_json_object("payload", "$.event").cast("bigint") - F.lit(e.agg(F.max("event_id")).first()[0] // 2))
    return ledger.verify(ledger.append(e, ["event_id"]).withColumn("payload", F.when(half == 0, F.lit("{}")).otherwise(F.col("payload"))))


@query(
    "WITH u AS (SELECT range AS t, "
    + ", ".join(f"((('0x' || substr(md5('42:' || range || ':{k}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(16**13)!r} AS u{k}" for k in range(7))
    + " FROM range(2000)), n AS (SELECT *, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS z0, sqrt(-2 * ln(u5)) * cos(2 * pi() * u6) AS z5 FROM u), "
    + "e AS (SELECT *, greatest(0.0, least(1.0, 0.5 + z0 * 0.1)) AS e FROM n), p AS (SELECT *, greatest(0.0, least(1.0, 0.05 - 0.08 * 0.5 - 0.05 * 0.5)) AS pd, 24.0 * (0.7 + 0.6 * 0.5) AS offer, 72.0 * (0.5 + 0.9 * 0.5) AS ex, greatest(0.0, least(1.0, 0.62 * (0.8 + 0.4 * 0.5) * (0.8 + 0.4 * 0.5) * (0.9 + 0.2 * 0.5) * (1.35 - 0.55 * e))) AS pc FROM e), "
    + "o AS (SELECT *, CASE WHEN u2 < pd THEN 'dismissal' WHEN u3 < greatest(0.0, least(1.0, 0.35 + (ex * pc - offer) / 48.0 + 0.15 * 0.5 - 0.15 * e)) THEN 'plea' WHEN u4 < pc THEN 'conviction' ELSE 'acquittal' END AS outcome FROM p), "
    + "m AS (SELECT *, CASE outcome WHEN 'plea' THEN offer WHEN 'conviction' THEN greatest(ex * (1 + 0.15 * 0.2) + z5 * ex * 0.15, 0.0) ELSE 0.0 END AS months FROM o) "
    + "SELECT outcome, count(*) AS n, round(avg(months), 6) AS mean_months FROM m GROUP BY 1"
)
def simulate_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of 2,000 seeded trials under the default priors."""
    t = simulate.trials(spark, simulate.Priors(), simulate.Strategy(), 2000, 42)
    return t.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("months"), 6).alias("mean_months"))


@query(
    sql("cases", "prosecutors")
    + ", o AS (SELECT p.office, count(*) FILTER (WHERE outcome = 'conviction')::DOUBLE / nullif(count(outcome), 0) AS r, avg(sentence_months) FILTER (WHERE plea_accepted) AS a, avg(sentence_months) FILTER (WHERE NOT plea_accepted AND outcome = 'conviction') AS b FROM cases JOIN prosecutors p USING (prosecutor_id) GROUP BY 1) "
    + "SELECT case_id, CASE lower(evidence_strength) WHEN 'weak' THEN 0.3 WHEN 'mixed' THEN 0.55 WHEN 'strong' THEN 0.8 ELSE 0.5 END::DOUBLE AS evidence, round(coalesce(r, 0.5), 6) AS aggressiveness, round(coalesce(a, plea_offer_months, 24.0), 6) AS base_plea, round(coalesce(b, sentence_months, 72.0), 6) AS base_trial, CASE WHEN r IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) THEN 'calibrated' ELSE 'fallback' END AS source FROM cases LEFT JOIN prosecutors p USING (prosecutor_id) LEFT JOIN o ON o.office = p.office"
)
def sim_priors(spark: SparkSession, d: str) -> DataFrame:
    """Priors of every case from its office's record."""
    from docketry.plans.statistics import S

    c = view(spark, d, "cases", "prosecutor_id", "evidence_strength", "charge_category", "outcome", "plea_accepted", "plea_offer_months", "sentence_months")
    p = view(spark, d, "prosecutors", "office")
    convicted = F.col("outcome") == "conviction"
    o = c.join(p, "prosecutor_id").groupBy("office").agg(S.rate(S.count_where(convicted), F.count("outcome")).alias("r"), S.avg_where(F.col("plea_accepted"), F.col("sentence_months")).alias("a"), S.avg_where(~F.col("plea_accepted") & convicted, F.col("sentence_months")).alias("b"))
    rows = c.join(p, "prosecutor_id", "left").join(o, "office", "left")
    x = simulate.priors(F.col("evidence_strength"), F.col("charge_category"), F.col("r"), F.col("a"), F.col("b"), F.lit(None).cast("double"), F.col("plea_offer_months"), F.col("sentence_months"))
    return rows.select("case_id", x.alias("x")).select("case_id", F.col("x.evidence_strength").alias("evidence"), *[F.round(f"x.{a}", 6).alias(b) for a, b in (("prosecutor_aggressiveness", "aggressiveness"), ("base_plea_months", "base_plea"), ("base_trial_months", "base_trial"))], "x.source")


# -- extensions over the event stream's table -----------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly counts and sums."""
    e = table(spark, d, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("w.start").cast("string").alias("hour"), "event_type", "n", "total")


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts)::VARCHAR AS first_ts, count(*) AS n FROM s GROUP BY user_id, sid"
)
def events_session(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions of a user with a gap of six hours."""
    e = table(spark, d, "events")
    w = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").cast("string").alias("first_ts"), F.count("*").alias("n"))
    return w.select("user_id", "first_ts", "n")


