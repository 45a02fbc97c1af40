"""Queries of the general data problems over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import hierarchy as H
from docketry.operators import references as R
from docketry.operators import timestamps as T
from docketry.operators.latest import latest_by
from docketry.plans.views import key, view
from docketry.session import table

# -- 1. hierarchies -------------------------------------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    return H.parent_links(table(spark, d, "court_registry"), "court_id", "parent_court", "refreshed_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Courts without a root: on, or with parents that run into, a loop."""
    return H.cycles(_links(spark, d)).select(F.col("id").alias("court_id"), "cycle_id")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, cycle and number of courts beneath, for every court. Counts that may be null are doubles, which
    both engines hand over alike."""
    tree = H.hierarchy(_links(spark, d), counts=True)
    return tree.select(F.col("id").alias("court_id"), F.col("parent").alias("parent_court"), "root", F.col("depth").cast("double"), F.array_join("path", "/").alias("path"), "cycle_id", "on_cycle", F.col("n_descendants").cast("double"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every court beneath every court, with the distance."""
    return H.descendants(H.hierarchy(_links(spark, d))).select(F.col("id").alias("court_id"), F.col("descendant").alias("descendant_id"), "distance")


# -- 3. written times -----------------------------------------------------------------------------------------------

#: src, table, key, value and arrival of the written times.
WRITTEN = (("entries", "feed_entries", "entry_id", "published", "fetched_at"), ("opinions", "court_opinions", "opinion_id", "date_issued", "ingested_at"), ("cases", "court_cases", "case_id", "filed", "inserted_at"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src, name, id_col, value, arrival in WRITTEN:
        rows = latest_by(table(spark, d, name), id_col, [F.col(arrival)], {"value": F.col(value), "zone": F.col("feed_zone"), "arrival": F.col(arrival), "feed": _FEED[src]()})
        rows = rows.select(F.lit(src).alias("src"), F.col("_key").alias("rec_id"), "value", "zone", "arrival", "feed")
        out = rows if out is None else out.unionByName(rows)
    return out


#: What names the feed in each table: the court, or for opinions, which name none, their case.
_FEED = {"entries": lambda: H.node_id(F.col("court_id")), "cases": lambda: H.node_id(F.col("source_court_id")), "opinions": lambda: key("case_id")}


def _with_feeds(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """_written() rows with the delivering court as feed, and its forum as group; an opinion comes from its case's court."""
    of_case = view(spark, d, "cases", "source_court_id").select(F.col("case_id").alias("_case"), H.node_id(F.col("source_court_id")).alias("_court"))
    forum = latest_by(table(spark, d, "court_registry"), H.node_id(F.col("court_id")), [F.col("refreshed_at")], {"forum": F.col("jurisdiction")}).select(F.col("_key").alias("_id"), "forum")
    opinions = rows.filter("src = 'opinions'").join(of_case, F.col("feed") == F.col("_case"), "left").withColumn("feed", F.col("_court")).drop("_case", "_court")
    every = rows.filter("src != 'opinions'").unionByName(opinions)
    return every.join(forum, F.col("feed") == F.col("_id"), "left").drop("_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every record whose value denotes a time; zones that are missing are estimated."""
    rows = T.resolved(T.with_estimated_zones(_written(spark, d), "value", "zone", "feed", "arrival", "forum", place=lambda r: _with_feeds(r, spark, d)), "_w", "zone")
    return rows.select("src", "rec_id", T.utc_text(F.col("utc")).alias("utc_text"))


def p3_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """How often estimated zones are right when no record's feed_zone is known: months of a feed with local times, and
    those in which every such time gets the instant that the declared zone gives, per source and declared zone."""
    held = _written(spark, d).withColumnRenamed("zone", "declared").withColumn("zone", F.lit(None).cast("string"))
    rows = T.with_estimated_zones(held, "value", "zone", "feed", "arrival", "forum", place=lambda r: _with_feeds(r, spark, d))
    w = F.col("_w")
    rows = rows.filter(w["local"].isNotNull() & ~w["dated"] & w["offset"].isNull() & w["zone"].isNull())
    same = F.convert_timezone(F.col("declared"), F.lit("UTC"), w["local"]) == F.convert_timezone(F.col("zone"), F.lit("UTC"), w["local"])
    months = rows.groupBy("src", "feed", "declared", F.date_format(w["local"], "yyyy-MM").alias("month")).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("right"))
    return months.groupBy("src", F.col("declared").alias("declared_zone")).agg(F.count("*").alias("n_months"), F.count_if("right").alias("n_right"))


def p3_zone_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per source, the months of p3_zone_estimates and whether nine tenths of them are right."""
    by = p3_zone_estimates(spark, d).groupBy("src").agg(F.sum("n_months").alias("n_months"), F.sum("n_right").alias("r"))
    return by.select("src", "n_months", (F.col("r") >= 0.9 * F.col("n_months")).alias("nine_tenths_right"))


# -- 5. references --------------------------------------------------------------------------------------------------

#: Referring table, its key, and its fields with the parent each refers to.
REFERRING = (
    ("constitutional_findings", "finding_id", (("case_id", "court_cases"), ("actor_id", "accountability_actors"), ("prosecutor_id", "prosecutors"))),
    ("disclosed_evidence_items", "item_id", (("case_id", "court_cases"),)),
)
#: Parent table, its key and the time a row of it came.
PARENTS = (("court_cases", "case_id", "inserted_at"), ("accountability_actors", "actor_id", "created_at"), ("prosecutors", "prosecutor_id", "created_at"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, fields in REFERRING:
        columns = {"at": F.col("created_at")} | {f: F.col(f) for f, _ in fields}
        rows = latest_by(table(spark, d, name), key, [F.col("ingested_at")], columns)
        refs = F.explode(F.array(*[F.struct(F.lit(f).alias("src_field"), F.lit(p).alias("parent"), F.col(f).alias("ref")) for f, p in fields])).alias("r")
        rows = rows.select(F.lit(name).alias("src_table"), F.col("_key").alias("rec_id"), "at", refs).select("src_table", "r.src_field", "rec_id", "r.parent", "r.ref", "at")
        out = rows if out is None else out.unionByName(rows)
    return out


def _parents(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, since in PARENTS:
        rows = table(spark, d, name).select(F.lit(name).alias("parent"), F.col(key).alias("ref"), F.col(since).alias("since"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References to rows that are not there, or came later."""
    return R.orphan_references(_references(spark, d), _parents(spark, d)).select("src_table", "src_field", "rec_id", "ref_state")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and month of created_at."""
    refs = R.keyed_references(_references(spark, d))
    return R.orphan_report(R.orphan_references(refs, _parents(spark, d)), refs)


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p3_found, p3_zone_estimates, p3_zone_recall, p5_found, p5_report)}

_TREE = """WITH RECURSIVE r AS (SELECT lower(trim(court_id)) AS id, nullif(lower(trim(parent_court)), '') AS p, row_number() OVER (PARTITION BY lower(trim(court_id)) ORDER BY refreshed_at DESC, parent_court DESC NULLS LAST) AS rn FROM court_registry),
l AS (SELECT a.id, b.id AS parent FROM (SELECT * FROM r WHERE rn = 1) a LEFT JOIN (SELECT * FROM r WHERE rn = 1) b ON a.p = b.id),
w AS (SELECT id, id AS at, parent AS nxt, [id] AS seen, 0 AS steps FROM l UNION ALL SELECT w.id, l.id, l.parent, list_append(w.seen, l.id), w.steps + 1 FROM w JOIN l ON w.nxt = l.id WHERE NOT list_contains(w.seen, w.nxt)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY steps DESC) AS k FROM w) WHERE k = 1) """
_REFS = """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC) AS rn FROM constitutional_findings) WHERE rn = 1),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ingested_at DESC) AS rn FROM disclosed_evidence_items) WHERE rn = 1),
refs AS (SELECT 'constitutional_findings' AS src_table, 'case_id' AS src_field, finding_id AS rec_id, 'court_cases' AS parent, case_id AS ref, created_at AS at_ FROM f UNION ALL SELECT 'constitutional_findings', 'actor_id', finding_id, 'accountability_actors', actor_id, created_at FROM f
UNION ALL SELECT 'constitutional_findings', 'prosecutor_id', finding_id, 'prosecutors', prosecutor_id, created_at FROM f UNION ALL SELECT 'disclosed_evidence_items', 'case_id', item_id, 'court_cases', case_id, created_at FROM i),
keyed AS (SELECT *, regexp_replace(lower(ref), '[^0-9a-f]', '', 'g') AS k FROM refs WHERE trim(ref) <> ''),
par AS (SELECT parent, regexp_replace(lower(ref), '[^0-9a-f]', '', 'g') AS k, min(since) AS since FROM (SELECT 'court_cases' AS parent, case_id AS ref, inserted_at AS since FROM court_cases UNION ALL SELECT 'accountability_actors', actor_id, created_at FROM accountability_actors UNION ALL SELECT 'prosecutors', prosecutor_id, created_at FROM prosecutors) GROUP BY ALL),
s AS (SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.since > r.at_ THEN 'late' END AS ref_state FROM keyed r LEFT JOIN par p ON r.parent = p.parent AND r.k = p.k) """

# Written times read apart from the operator's patterns: the zone is cut off, and strptime tries every notation on the rest.
_SHIFT = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10}
_DAYS = ("%Y-%m-%d", "%Y%m%d", "%m/%d/%y", "%m/%d/%Y", "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y", "%b %d, %Y", "%B %d, %Y", "%b. %d, %Y")
_CLOCKS = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H.%M.%S", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M:%S", "%d.%m.%Y %H:%M", "%m/%d/%y %H:%M", "%m/%d/%Y %I:%M %p", "%b %d, %Y %I:%M %p", "%B %d, %Y %I:%M %p", "%b. %d, %Y %I:%M %p")
_latest = lambda src, name, key, value, at: f"SELECT '{src}' AS src, {key} AS rec_id, {value} AS v, feed_zone AS fz FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) AS rn FROM {name}) WHERE rn = 1"
_ago = lambda days: f"(epoch_us(local {days}) - epoch_us(timezone(z, local {days})))"
_TIMES = (
    "WITH rows_ AS (" + " UNION ALL ".join(_latest(*w) for w in WRITTEN) + r"""),
c AS (SELECT src, rec_id, fz, trim(regexp_replace(upper(v), '[\s\x{00a0}\x{2007}\x{202f}\x{200b}\x{feff}]+', ' ', 'g')) AS t FROM rows_ WHERE v IS NOT NULL),
o AS (SELECT *, regexp_extract(t, '\[(.*)\]$', 1) AS named, regexp_extract(t, '[T ]\d{1,2}:?\d{2}(?::?\d{2})?(?:\.\d+)? ?([+-]\d{2}:?\d{2})$', 1) AS shifted, regexp_extract(t, '\d ?(Z|UTC|GMT|[ECMP][SD]T|AK[SD]T|HST)$', 1) AS letters FROM c),
b AS (SELECT *, regexp_replace(replace(regexp_replace(regexp_replace(trim(left(t, length(t) - length(shifted) - length(letters) - CASE WHEN named <> '' THEN length(named) + 2 ELSE 0 END)), '^(MON|TUE|WED|THU|FRI|SAT|SUN), ', ''), '([AP])\.M\.$', '\1M'), ' AT ', ' '), '(\d{4}), ', '\1 ') AS base FROM o),
p AS (SELECT *, """ + f"try_strptime(base, {list(_DAYS)!r}) AS day_, try_strptime(base, {list(_CLOCKS)!r}) AS local, (SELECT z.name FROM pg_timezone_names() z WHERE upper(z.name) = named AND named <> '') AS zone_, map_extract(MAP {{{', '.join(f'{k!r}: {v * 60}' for k, v in _SHIFT.items())}}}, letters)[1] AS by_letters, " + r"""CASE WHEN shifted <> '' THEN (CASE WHEN left(shifted, 1) = '-' THEN -1 ELSE 1 END) * (substr(replace(shifted, ':', ''), 2, 2)::INT * 60 + right(shifted, 2)::INT) END AS by_digits FROM b),
n AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{9,20}$') THEN make_timestamp(CASE WHEN length(t) <= 11 THEN t::HUGEINT * 1000000 WHEN length(t) <= 14 THEN t::HUGEINT * 1000 WHEN length(t) <= 17 THEN t::HUGEINT ELSE t::HUGEINT // 1000 END::BIGINT) END AS counted, coalesce(zone_, CASE WHEN named = '' THEN fz END) AS z FROM p),
e AS (SELECT *, CASE WHEN local IS NOT NULL AND z IS NOT NULL THEN local - to_microseconds(""" + _ago("- INTERVAL 1 DAY") + r""") END AS before_, CASE WHEN local IS NOT NULL AND z IS NOT NULL THEN local - to_microseconds(""" + _ago("+ INTERVAL 1 DAY") + r""") END AS after_ FROM n),
u AS (SELECT src, rec_id, coalesce(counted, CASE WHEN local IS NULL THEN day_ WHEN shifted <> '' OR letters <> '' THEN local - to_minutes(coalesce(by_digits, by_letters)::BIGINT) WHEN timezone(z, before_::TIMESTAMPTZ) = local THEN before_ WHEN timezone(z, after_::TIMESTAMPTZ) = local THEN after_ ELSE before_ END) AS utc FROM e) """
)

ORACLE = {
    "p3_found": _TIMES + "SELECT src, rec_id, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc_text FROM u WHERE utc IS NOT NULL",
    "p1_found": _TREE + "SELECT id AS court_id, list_min(list_slice(seen, list_position(seen, nxt), len(seen))) AS cycle_id FROM f WHERE nxt IS NOT NULL",
    "p1_hierarchy": _TREE
    + ", n AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(list_slice(seen, 2, len(seen))) AS a FROM f WHERE nxt IS NULL) GROUP BY 1) SELECT f.id AS court_id, l.parent AS parent_court, CASE WHEN nxt IS NULL THEN seen[len(seen)] END AS root, CASE WHEN nxt IS NULL THEN steps::DOUBLE END AS depth, CASE WHEN nxt IS NULL THEN array_to_string(list_reverse(seen), '/') END AS path, "
    + "CASE WHEN nxt IS NOT NULL THEN list_min(list_slice(seen, list_position(seen, nxt), len(seen))) END AS cycle_id, coalesce(nxt = f.id, false) AS on_cycle, CASE WHEN nxt IS NULL THEN coalesce(n, 0)::DOUBLE END AS n_descendants FROM f JOIN l ON l.id = f.id LEFT JOIN n ON n.id = f.id",
    "p1_descendants": _TREE + "SELECT a AS court_id, id AS descendant_id, (k - 1)::INTEGER AS distance FROM (SELECT id, unnest(seen) AS a, generate_subscripts(seen, 1) AS k FROM f WHERE nxt IS NULL) WHERE k > 1",
    "p3_zone_recall": _TIMES
    + """, f AS (SELECT 'entries' AS src, entry_id AS rec_id, any_value(lower(trim(court_id)) ORDER BY fetched_at DESC) AS feed FROM feed_entries GROUP BY ALL UNION ALL SELECT 'cases', case_id, arg_max(lower(trim(source_court_id)), inserted_at) FROM court_cases GROUP BY ALL
UNION ALL SELECT 'opinions', opinion_id, c.court FROM (SELECT opinion_id, arg_max(regexp_replace(lower(case_id), '[^0-9a-f]', '', 'g'), ingested_at) AS k FROM court_opinions GROUP BY 1) o LEFT JOIN (SELECT regexp_replace(lower(case_id), '[^0-9a-f]', '', 'g') AS k, arg_max(lower(trim(source_court_id)), inserted_at) AS court FROM court_cases GROUP BY 1) c USING (k))
SELECT src, count(*) AS n_months, TRUE AS nine_tenths_right FROM (SELECT DISTINCT e.src, f.feed, e.fz, strftime(local, '%Y-%m') AS m FROM e LEFT JOIN f USING (src, rec_id) WHERE local IS NOT NULL AND counted IS NULL AND shifted = '' AND letters = '' AND named = '') GROUP BY src""",
    "p5_found": _REFS + "SELECT src_table, src_field, rec_id, ref_state FROM s WHERE ref_state IS NOT NULL",
    "p5_report": _REFS
    + "SELECT src_table, src_field, strftime(at_, '%Y-%m') AS month, count(*) AS n_refs, count(*) FILTER (WHERE ref_state = 'missing') AS n_missing, count(*) FILTER (WHERE ref_state = 'late') AS n_late FROM s GROUP BY ALL",
}
