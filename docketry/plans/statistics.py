"""Statistics over cases and findings, each with the SQL it is checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import geo
from docketry.functions import stats as S
from docketry.operators.cases import penalty_ratio, penalty_window
from docketry.operators.register import gated
from docketry.plans.catalogs import TACTICS
from docketry.plans.views import AS_OF, sql, view
from docketry.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Fewest cases of a cell that is shown, and the ratio above which a penalty is severe.
LEAST_CASES, SEVERE = 3, 2.0
#: Resolution of the map, coarse enough that cells hold several cases.
CELL_RES = 2
_WINDOW = "plea_offered AND NOT plea_accepted AND outcome = 'conviction' AND plea_offer_months > 0 AND sentence_months > 0"
_PENALTY = ("plea_offered", "plea_accepted", "outcome", "plea_offer_months", "sentence_months")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: Views and plain tables that are counted.
_COUNTED, _PLAIN = ("cases", "findings", "opinions", "disclosed", "entries", "prosecutors", "actors"), ("court_registry", "documents", "labels", "events")


def _round(c, n: int = 6):
    return F.round(c, n)


def _with_office(cases: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return cases.join(view(spark, d, "prosecutors", "office", "jurisdiction").withColumnRenamed("jurisdiction", "p_jurisdiction"), "prosecutor_id")


def _distribution(rows: DataFrame, by: str) -> DataFrame:
    r = rows.filter(penalty_window()).withColumn("ratio", penalty_ratio())
    q = F.percentile("ratio", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = r.groupBy(by).agg(F.count("*").alias("n"), F.avg("ratio").alias("m"), q.alias("q"), F.avg("plea_offer_months").alias("o"), F.avg("sentence_months").alias("s"))
    return out.select(by, "n", _round("m").alias("mean_ratio"), *[_round(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((50, 90, 95))], _round("o").alias("mean_offer"), _round("s").alias("mean_sentence"))


_DISTRIBUTION = (
    "count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.9), 6) AS p90, round(quantile_cont(ratio, 0.95), 6) AS p95, "
    "round(avg(plea_offer_months), 6) AS mean_offer, round(avg(sentence_months), 6) AS mean_sentence"
)
_RATIO = f"e AS (SELECT *, sentence_months::DOUBLE / plea_offer_months AS ratio FROM cases WHERE {_WINDOW}) "


@query(sql("cases", "prosecutors") + f", {_RATIO} SELECT p.office, {_DISTRIBUTION} FROM e JOIN prosecutors p USING (prosecutor_id) GROUP BY p.office")
def penalty_by_office(spark: SparkSession, d: str) -> DataFrame:
    """Trial penalty per office: count, mean and exact percentiles of sentence over offer."""
    return _distribution(_with_office(view(spark, d, "cases", "prosecutor_id", *_PENALTY), spark, d), "office")


@query(sql("cases") + f", {_RATIO} SELECT judge, {_DISTRIBUTION} FROM e GROUP BY judge")
def penalty_by_judge(spark: SparkSession, d: str) -> DataFrame:
    """The same per judge as written; null is a group."""
    return _distribution(view(spark, d, "cases", "judge", *_PENALTY), "judge")


def _sql_cell(res: int) -> str:
    size = geo.edge_degrees(res)
    q, r = f"((({3**0.5 / 3!r} * lng) - (lat / 3.0)) / {size!r})", f"(({2.0 / 3!r} * lat) / {size!r})"
    rq, rr, rs = f"floor({q} + 0.5)", f"floor({r} + 0.5)", f"floor(-{q} - {r} + 0.5)"
    dq, dr, ds = f"abs({rq} - {q})", f"abs({rr} - {r})", f"abs({rs} + {q} + {r})"
    cq = f"CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{rr} - {rs} ELSE {rq} END"
    cr = f"CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN {rr} WHEN {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END"
    return f"CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN 'hx{res}_' || ({cq})::BIGINT || '_' || ({cr})::BIGINT END"


_POINTS = "pts AS (SELECT *, court_location_lat AS lat, court_location_lng AS lng FROM cases) "


@query(sql("cases") + f", {_POINTS}, c AS (SELECT {_sql_cell(CELL_RES)} AS cell, sentence_months::DOUBLE / plea_offer_months AS ratio FROM pts WHERE {_WINDOW}) SELECT cell, count(*) AS n, round(avg(ratio), 6) AS mean_ratio FROM c WHERE cell IS NOT NULL GROUP BY cell HAVING count(*) >= {LEAST_CASES}")
def penalty_heatmap_having(spark: SparkSession, d: str) -> DataFrame:
    """Mean trial penalty of grid cells with enough cases."""
    rows = view(spark, d, "cases", "court_location_lat", "court_location_lng", *_PENALTY).filter(penalty_window())
    cells = rows.select(geo.cell_for(F.col("court_location_lat"), F.col("court_location_lng"), CELL_RES).alias("cell"), penalty_ratio().alias("ratio")).filter("cell is not null")
    return cells.groupBy("cell").agg(F.count("*").alias("n"), _round(F.avg("ratio")).alias("mean_ratio")).filter(F.col("n") >= LEAST_CASES)


@query(
    sql("cases")
    + f", e AS (SELECT defendant_race, sentence_months::DOUBLE / plea_offer_months AS ratio FROM cases WHERE {_WINDOW} AND charge_category = 'drug' AND defendant_race IN ('group_a', 'group_b')), "
    + f"g AS (SELECT count(*) FILTER (WHERE defendant_race = 'group_a') AS n_a, count(*) FILTER (WHERE defendant_race = 'group_b') AS n_b, coalesce(avg(ratio) FILTER (WHERE defendant_race = 'group_a'), 0.0) AS mean_a, coalesce(avg(ratio) FILTER (WHERE defendant_race = 'group_b'), 0.0) AS mean_b, count(*) FILTER (WHERE defendant_race = 'group_a' AND ratio > {SEVERE}) AS severe_a, count(*) FILTER (WHERE defendant_race = 'group_b' AND ratio > {SEVERE}) AS severe_b FROM e), "
    + "h AS (SELECT *, CASE WHEN severe_a = 0 OR severe_b = 0 OR n_a = severe_a OR n_b = severe_b THEN 0.5 ELSE 0.0 END AS fix FROM g) "
    + "SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, severe_a, severe_b, CASE WHEN n_a > 0 AND n_b > 0 THEN round((severe_a + fix) * (n_b - severe_b + fix) / ((n_a - severe_a + fix) * (severe_b + fix)), 6) END AS odds_ratio FROM h"
)
def disparity_two_group(spark: SparkSession, d: str) -> DataFrame:
    """Trial penalty of two groups in one charge category: means, severe counts (above the threshold) and their odds ratio."""
    e = view(spark, d, "cases", "charge_category", "defendant_race", *_PENALTY).filter(penalty_window() & (F.col("charge_category") == "drug") & F.col("defendant_race").isin("group_a", "group_b"))
    e = e.select("defendant_race", penalty_ratio().alias("ratio"))
    is_, hard = lambda g: F.col("defendant_race") == g, F.col("ratio") > SEVERE
    g = e.agg(
        *[S.count_where(is_(f"group_{x}")).alias(f"n_{x}") for x in "ab"],
        *[F.coalesce(S.avg_where(is_(f"group_{x}"), F.col("ratio")), F.lit(0.0)).alias(f"m_{x}") for x in "ab"],
        *[S.count_where(is_(f"group_{x}") & hard).alias(f"severe_{x}") for x in "ab"],
    )
    ratio = S.odds_ratio(F.col("severe_a"), F.col("n_a") - F.col("severe_a"), F.col("severe_b"), F.col("n_b") - F.col("severe_b"))
    return g.select("n_a", "n_b", _round("m_a").alias("mean_a"), _round("m_b").alias("mean_b"), "severe_a", "severe_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), _round(ratio["odds_ratio"])).alias("odds_ratio"))


@query(
    sql("cases")
    + ", t AS (SELECT jurisdiction, count(*) FILTER (WHERE e AND o) AS a, count(*) FILTER (WHERE e AND NOT o) AS b, count(*) FILTER (WHERE NOT e AND o) AS c, count(*) FILTER (WHERE NOT e AND NOT o) AS d FROM (SELECT jurisdiction, evidence_strength = 'weak' AS e, outcome = 'conviction' AS o FROM cases) GROUP BY jurisdiction), "
    + "x AS (SELECT *, (a = 0 OR b = 0 OR c = 0 OR d = 0) AS corrected, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END AS k FROM t), y AS (SELECT *, (a + k) * (d + k) / ((b + k) * (c + k)) AS r, 1.959963984540054 * sqrt(1 / (a + k) + 1 / (b + k) + 1 / (c + k) + 1 / (d + k)) AS h FROM x) "
    + "SELECT jurisdiction, a, b, c, d, round(r, 6) AS odds_ratio, round(exp(ln(r) - h), 6) AS ci_low, round(exp(ln(r) + h), 6) AS ci_high, corrected FROM y"
)
def contingency_odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Weak evidence against conviction per jurisdiction: the 2x2 table, odds ratio and its interval."""
    rows = view(spark, d, "cases", "jurisdiction", "evidence_strength", "outcome")
    cells = S.contingency(F.col("evidence_strength") == "weak", F.col("outcome") == "conviction")
    t = rows.groupBy("jurisdiction").agg(*[c.alias(n) for c, n in zip(cells, "abcd", strict=True)])
    o = t.withColumn("o", S.odds_ratio(*[F.col(c) for c in "abcd"]))
    return o.select("jurisdiction", "a", "b", "c", "d", *[_round(F.col(f"o.{c}")).alias(c) for c in ("odds_ratio", "ci_low", "ci_high")], "o.corrected")


@query(
    sql("cases", "prosecutors")
    + ", c AS (SELECT p.office, count(*) AS n, corr(sentence_months::DOUBLE, plea_offer_months::DOUBLE) AS r, stddev_pop(plea_offer_months) AS sx, stddev_pop(sentence_months) AS sy FROM cases JOIN prosecutors p USING (prosecutor_id) WHERE plea_offer_months IS NOT NULL AND sentence_months IS NOT NULL GROUP BY p.office) "
    + "SELECT office, n, CASE WHEN ok THEN round(r, 6) END AS r, CASE WHEN ok THEN round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) END AS ci_low, CASE WHEN ok THEN round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) END AS ci_high FROM (SELECT *, n >= 4 AND sx > 0 AND sy > 0 AS ok FROM c)"
)
def plea_sentence_pearson(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of offer and sentence per office with Fisher's interval."""
    rows = _with_office(view(spark, d, "cases", "prosecutor_id", "plea_offer_months", "sentence_months"), spark, d)
    n, r = S.pearson(F.col("plea_offer_months"), F.col("sentence_months"))
    out = rows.groupBy("office").agg(n.alias("n"), r.alias("r")).filter("n > 0").withColumn("ci", S.fisher_interval(F.col("r"), F.when(F.col("n") >= 4, F.col("n"))))
    return out.select("office", "n", _round("r").alias("r"), _round("ci.low").alias("ci_low"), _round("ci.high").alias("ci_high"))


_ERF = "(1 - (((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t) * exp(-(x * x)))"
_FINGERPRINT = (
    sql("cases", "prosecutors", "findings")
    + ", oc AS (SELECT p.office, p.jurisdiction, count(*) AS n FROM cases JOIN prosecutors p USING (prosecutor_id) GROUP BY ALL), jc AS (SELECT jurisdiction, sum(n)::BIGINT AS n FROM oc GROUP BY jurisdiction), "
    + "f AS (SELECT office, jurisdiction, finding_type, count(*) AS k FROM findings WHERE review_status = 'substantiated' AND office IS NOT NULL AND jurisdiction IS NOT NULL AND finding_type IS NOT NULL GROUP BY ALL), jf AS (SELECT jurisdiction, finding_type, sum(k)::BIGINT AS k FROM f GROUP BY ALL), "
    + "g AS (SELECT oc.office, oc.jurisdiction, jf.finding_type, coalesce(f.k, 0) AS office_count, jf.k - coalesce(f.k, 0) AS state_count, oc.n AS office_n, jc.n - oc.n AS state_n FROM oc JOIN jc USING (jurisdiction) JOIN jf USING (jurisdiction) LEFT JOIN f ON f.office = oc.office AND f.jurisdiction = oc.jurisdiction AND f.finding_type = jf.finding_type) "
)


def _fingerprint(spark: SparkSession, d: str) -> DataFrame:
    cases = _with_office(view(spark, d, "cases", "prosecutor_id"), spark, d).groupBy("office", F.col("p_jurisdiction").alias("jurisdiction")).agg(F.count("*").alias("office_n"))
    whole = cases.groupBy("jurisdiction").agg(F.sum("office_n").alias("all_n"))
    f = gated(view(spark, d, "findings", "office", "jurisdiction", "finding_type", "review_status")).dropna(subset=["office", "jurisdiction", "finding_type"])
    f = f.groupBy("office", "jurisdiction", "finding_type").agg(F.count("*").alias("k"))
    types = f.groupBy("jurisdiction", "finding_type").agg(F.sum("k").alias("all_k"))
    g = cases.join(whole, "jurisdiction").join(types, "jurisdiction").join(f, ["office", "jurisdiction", "finding_type"], "left")
    k = F.coalesce("k", F.lit(0).cast("bigint"))
    return g.select("office", "jurisdiction", "finding_type", k.alias("office_count"), (F.col("all_k") - k).alias("state_count"), "office_n", (F.col("all_n") - F.col("office_n")).alias("state_n"))


@query(_FINGERPRINT + "SELECT office, jurisdiction, finding_type, office_count, state_count, CASE WHEN office_n > 0 THEN round(office_count * 1000.0 / office_n, 6) ELSE 0.0 END AS office_rate, CASE WHEN state_n > 0 THEN round(state_count * 1000.0 / state_n, 6) ELSE 0.0 END AS state_rate FROM g")
def office_fingerprint_types(spark: SparkSession, d: str) -> DataFrame:
    """Substantiated findings by type of every office against the rest of its jurisdiction, per 1,000 cases."""
    per = lambda k, n: F.when(F.col(n) > 0, _round(F.col(k) * 1000.0 / F.col(n))).otherwise(0.0)
    return _fingerprint(spark, d).select("office", "jurisdiction", "finding_type", "office_count", "state_count", per("office_count", "office_n").alias("office_rate"), per("state_count", "state_n").alias("state_rate"))


@query(
    _FINGERPRINT
    + ", v AS (SELECT *, (office_count + state_count)::DOUBLE / nullif(office_n + state_n, 0) AS p FROM g), w AS (SELECT *, p * (1 - p) * (1.0 / nullif(office_n, 0) + 1.0 / nullif(state_n, 0)) AS var FROM v), "
    + "z AS (SELECT *, CASE WHEN office_n <= 0 OR state_n <= 0 OR var <= 0 THEN 0.0 ELSE (office_count::DOUBLE / office_n - state_count::DOUBLE / state_n) / sqrt(var) END AS z, (office_n <= 0 OR state_n <= 0 OR var <= 0) AS none FROM w), t AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM z), u AS (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM t) "
    + f"SELECT office, jurisdiction, finding_type, round(z, 6) AS z, CASE WHEN none THEN 0.5 ELSE round((1 - {_ERF}) / 2, 6) END AS p FROM u"
)
def fingerprint_z_test(spark: SparkSession, d: str) -> DataFrame:
    """The two-proportion test behind every office's fingerprint."""
    g = _fingerprint(spark, d).withColumn("t", S.two_proportion_z(*[F.col(c) for c in ("office_count", "office_n", "state_count", "state_n")]))
    return g.select("office", "jurisdiction", "finding_type", _round("t.z").alias("z"), _round("t.p").alias("p"))


@query(sql("findings") + f"SELECT office, count(*) AS n FROM findings WHERE review_status = 'substantiated' AND finding_date >= DATE '{AS_OF}' - INTERVAL 5 YEAR GROUP BY office")
def recent_5yr_by_office(spark: SparkSession, d: str) -> DataFrame:
    """Substantiated findings of the last five years per office."""
    f = gated(view(spark, d, "findings", "office", "finding_date", "review_status"))
    return f.filter(F.col("finding_date") >= F.lit(AS_OF).cast("date") - F.expr("INTERVAL '5' YEAR")).groupBy("office").agg(F.count("*").alias("n"))


@query(sql("findings") + "SELECT judge, count(*) AS n FROM findings WHERE review_status = 'substantiated' GROUP BY judge ORDER BY n DESC, judge NULLS LAST LIMIT 10")
def top_judges(spark: SparkSession, d: str) -> DataFrame:
    """The ten judges, as written, with most substantiated findings; null is a group, ties by name."""
    return gated(view(spark, d, "findings", "judge", "review_status")).groupBy("judge").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("judge")).limit(10)


@query(sql("findings", "prosecutors") + "SELECT p.name, count(*) AS n FROM findings f LEFT JOIN prosecutors p USING (prosecutor_id) WHERE review_status = 'substantiated' GROUP BY p.name ORDER BY n DESC, p.name NULLS LAST LIMIT 10")
def top_prosecutors(spark: SparkSession, d: str) -> DataFrame:
    """The ten prosecutors with most substantiated findings; findings without one are a group."""
    f = gated(view(spark, d, "findings", "prosecutor_id", "review_status")).groupBy("prosecutor_id").agg(F.count("*").alias("k"))
    named = f.join(view(spark, d, "prosecutors", "name"), "prosecutor_id", "left")
    return named.groupBy("name").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("name")).limit(10)


@query(
    sql("cases", "findings", "prosecutors")
    + ", c AS (SELECT prosecutor_id, count(*) AS n_cases, count(*) FILTER (WHERE outcome = 'conviction') AS n_convictions, count(*) FILTER (WHERE plea_offered) AS n_offers, count(*) FILTER (WHERE plea_accepted) AS n_accepted, avg(sentence_months) FILTER (WHERE plea_accepted) AS a, avg(sentence_months) FILTER (WHERE NOT plea_accepted) AS b FROM cases GROUP BY prosecutor_id), "
    + "f AS (SELECT prosecutor_id, count(*) FILTER (WHERE review_status = 'pending') AS n_pending, count(*) FILTER (WHERE review_status = 'substantiated') AS n_substantiated FROM findings GROUP BY prosecutor_id) "
    + "SELECT p.prosecutor_id, p.name, coalesce(n_cases, 0) AS n_cases, coalesce(n_convictions, 0) AS n_convictions, coalesce(n_offers, 0) AS n_offers, coalesce(n_accepted, 0) AS n_accepted, round(a, 6) AS mean_plea_months, round(b, 6) AS mean_trial_months, coalesce(n_pending, 0) AS n_pending, coalesce(n_substantiated, 0) AS n_substantiated FROM prosecutors p LEFT JOIN c USING (prosecutor_id) LEFT JOIN f USING (prosecutor_id)"
)
def prosecutor_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and means of every prosecutor's cases, with findings by state: correlated counts as joins of aggregates."""
    c = view(spark, d, "cases", "prosecutor_id", "outcome", "plea_offered", "plea_accepted", "sentence_months").groupBy("prosecutor_id").agg(
        F.count("*").alias("n_cases"), S.count_where(F.col("outcome") == "conviction").alias("n_convictions"), S.count_where(F.col("plea_offered")).alias("n_offers"), S.count_where(F.col("plea_accepted")).alias("n_accepted"),
        _round(S.avg_where(F.col("plea_accepted"), F.col("sentence_months"))).alias("mean_plea_months"), _round(S.avg_where(~F.col("plea_accepted"), F.col("sentence_months"))).alias("mean_trial_months"),
    )
    f = view(spark, d, "findings", "prosecutor_id", "review_status").groupBy("prosecutor_id").agg(*[S.count_where(F.col("review_status") == s).alias(f"n_{s}") for s in ("pending", "substantiated")])
    out = view(spark, d, "prosecutors", "name").join(c, "prosecutor_id", "left").join(f, "prosecutor_id", "left")
    return out.na.fill(0, ["n_cases", "n_convictions", "n_offers", "n_accepted", "n_pending", "n_substantiated"])


@query(
    sql("cases", "prosecutors")
    + "SELECT p.office, round(count(*) FILTER (WHERE outcome = 'conviction')::DOUBLE / nullif(count(outcome), 0), 6) AS conviction_rate, round(avg(sentence_months) FILTER (WHERE plea_accepted), 6) AS mean_plea_months, round(avg(sentence_months) FILTER (WHERE NOT plea_accepted AND outcome = 'conviction'), 6) AS mean_trial_months FROM cases JOIN prosecutors p USING (prosecutor_id) GROUP BY p.office"
)
def office_calibration(spark: SparkSession, d: str) -> DataFrame:
    """What a simulation takes from an office's record."""
    rows = _with_office(view(spark, d, "cases", "prosecutor_id", "outcome", "plea_accepted", "sentence_months"), spark, d)
    convicted = F.col("outcome") == "conviction"
    return rows.groupBy("office").agg(
        _round(S.rate(S.count_where(convicted), F.count("outcome"))).alias("conviction_rate"), _round(S.avg_where(F.col("plea_accepted"), F.col("sentence_months"))).alias("mean_plea_months"), _round(S.avg_where(~F.col("plea_accepted") & convicted, F.col("sentence_months"))).alias("mean_trial_months")
    )


@query(sql("cases") + "SELECT judge, round(count(*) FILTER (WHERE outcome = 'conviction')::DOUBLE / nullif(count(outcome), 0), 6) AS conviction_rate FROM cases GROUP BY judge")
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Conviction rate per judge as written."""
    return view(spark, d, "cases", "judge", "outcome").groupBy("judge").agg(_round(S.rate(S.count_where(F.col("outcome") == "conviction"), F.count("outcome"))).alias("conviction_rate"))


@query(
    sql("cases", "findings")
    + ", n AS (SELECT count(*) AS all_cases, count(*) FILTER (WHERE plea_offered) AS _o, count(*) FILTER (WHERE "
    + _WINDOW
    + ") AS pen, count(*) FILTER (WHERE "
    + _WINDOW
    + f" AND sentence_months::DOUBLE / plea_offer_months >= {SEVERE}) AS pen_hits, count(*) FILTER (WHERE len(charges) > 1) AS stacked FROM cases), f AS (SELECT finding_type, count(*) AS k FROM findings WHERE review_status = 'substantiated' GROUP BY finding_type), "
    + f"t(tactic, signal) AS (VALUES {', '.join(repr(t) for t in TACTICS)}) "
    + "SELECT tactic, CASE WHEN signal LIKE 'finding:%' OR signal = 'charge_stack' THEN all_cases WHEN signal = 'trial_penalty' THEN pen ELSE 0 END AS data_points, CASE WHEN signal LIKE 'finding:%' THEN coalesce(k, 0) WHEN signal = 'charge_stack' THEN stacked WHEN signal = 'trial_penalty' THEN pen_hits ELSE 0 END AS hits, "
    + "round(CASE WHEN signal LIKE 'finding:%' THEN coalesce(k, 0)::DOUBLE / nullif(all_cases, 0) WHEN signal = 'charge_stack' THEN stacked::DOUBLE / nullif(all_cases, 0) WHEN signal = 'trial_penalty' THEN pen_hits::DOUBLE / nullif(pen, 0) END, 6) AS rate FROM t LEFT JOIN f ON 'finding:' || f.finding_type = t.signal JOIN n ON true"
)
def tactic_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often every tactic's signal occurs. Finding signals count findings over all cases, so a rate may exceed 1."""
    c = view(spark, d, "cases", "charges", *_PENALTY)
    hard = penalty_window() & (penalty_ratio() >= SEVERE)
    n = c.agg(F.count("*").alias("all_cases"), S.count_where(penalty_window()).alias("pen"), S.count_where(hard).alias("pen_hits"), S.count_where(F.size("charges") > 1).alias("stacked"))
    cases = n.select(F.explode(F.array(F.struct(F.lit("trial_penalty").alias("signal"), F.col("pen").alias("data_points"), F.col("pen_hits").alias("hits")), F.struct(F.lit("charge_stack").alias("signal"), F.col("all_cases").alias("data_points"), F.col("stacked").alias("hits")))).alias("x")).select("x.*")
    f = gated(view(spark, d, "findings", "finding_type", "review_status")).groupBy(F.concat(F.lit("finding:"), F.col("finding_type")).alias("signal")).agg(F.count("*").alias("hits"))
    tactics = spark.createDataFrame(TACTICS, "tactic string, signal string")
    of_finding = F.startswith("signal", F.lit("finding:"))
    measured = n.select(F.lit("finding").alias("kind"), "all_cases")
    found = tactics.filter(of_finding).withColumn("kind", F.lit("finding")).join(measured, "kind").join(f, "signal", "left").select("tactic", F.col("all_cases").alias("data_points"), F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"))
    others = tactics.filter(~of_finding).join(cases, "signal", "left").select("tactic", *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("data_points", "hits")])
    return found.unionByName(others).withColumn("rate", _round(S.rate(F.col("hits"), F.col("data_points"))))


@query(sql("cases") + "SELECT jurisdiction, count(DISTINCT case_id) AS n_cases, count(DISTINCT judge) AS n_judges, count(DISTINCT CASE WHEN len(charges) > 1 THEN case_id END) AS n_multi FROM cases GROUP BY jurisdiction")
def multi_charge_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cases, judges and cases of several charges per jurisdiction."""
    c = view(spark, d, "cases", "jurisdiction", "judge", "charges")
    return c.groupBy("jurisdiction").agg(F.countDistinct("case_id").alias("n_cases"), F.countDistinct("judge").alias("n_judges"), F.countDistinct(F.when(F.size("charges") > 1, F.col("case_id"))).alias("n_multi"))


@query(sql("opinions") + "SELECT count(*) AS n, count(*) FILTER (WHERE text_completeness = 'full') AS n_full, count(*) FILTER (WHERE text_completeness <> 'full') AS n_partial, coalesce(quantile_disc(length(full_text), 0.5), 0)::BIGINT AS median_chars, round(quantile_cont(length(full_text), 0.5))::BIGINT AS middle_chars FROM opinions")
def corpus_shape(spark: SparkSession, d: str) -> DataFrame:
    """How many opinions are whole, and the median length: an existing one, and the rounded mean of the middle two."""
    o = view(spark, d, "opinions", "text_completeness", "full_text").select("text_completeness", F.length("full_text").alias("n"))
    disc = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)")
    return o.agg(F.count("*").alias("n"), S.count_where(F.col("text_completeness") == "full").alias("n_full"), S.count_where(F.col("text_completeness") != "full").alias("n_partial"), F.coalesce(disc, F.lit(0)).cast("bigint").alias("median_chars"), F.round(F.percentile("n", F.lit(0.5))).cast("bigint").alias("middle_chars"))


@query(sql("findings") + "SELECT office, coalesce(bool_or(death_resulted), false) AS any_death, coalesce(bool_or(bodily_injury), false) AS any_injury FROM findings WHERE review_status = 'substantiated' GROUP BY office")
def aggravators_bool_or(spark: SparkSession, d: str) -> DataFrame:
    """Whether any substantiated finding of an office has an aggravator."""
    f = gated(view(spark, d, "findings", "office", "death_resulted", "bodily_injury", "review_status"))
    return f.groupBy("office").agg(F.coalesce(F.bool_or("death_resulted"), F.lit(False)).alias("any_death"), F.coalesce(F.bool_or("bodily_injury"), F.lit(False)).alias("any_injury"))


@query(
    sql(*_COUNTED) + " UNION ALL ".join([f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _COUNTED] + [f"SELECT '{n}', count(*) FROM {n}" for n in _PLAIN])
)
def engine_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every view and table in one plan."""
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
    return reduce(DataFrame.unionByName, [*[one(view(spark, d, n), n) for n in _COUNTED], *[one(table(spark, d, n), n) for n in _PLAIN]])


@query(sql("findings") + "SELECT office, finding_type, count(*) AS n, grouping_id(office, finding_type)::BIGINT AS level FROM findings WHERE review_status = 'substantiated' GROUP BY ROLLUP (office, finding_type)")
def fingerprint_rollup(spark: SparkSession, d: str) -> DataFrame:
    """An extension: findings by office and type with subtotals."""
    f = gated(view(spark, d, "findings", "office", "finding_type", "review_status"))
    return f.rollup("office", "finding_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
