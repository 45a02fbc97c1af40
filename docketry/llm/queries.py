"""Queries of the training-data operators over the tables of a data folder, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import abuse, name_links, near_duplicates, packing, tokens
from docketry.operators.latest import latest_by
from docketry.session import table

CAPACITY = 2048


#: Opinions are alike if they share at least half of their runs of three words.
OPINIONS_ALIKE = near_duplicates.Likeness(run=3, share=(1, 2))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every opinion and the number of other texts its text is alike."""
    out = near_duplicates.groups(table(spark, d, "court_opinions"), "opinion_id", "full_text", OPINIONS_ALIKE)
    return out.withColumnRenamed("id", "opinion_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of opinions in the same group."""
    rows = near_duplicates.membership(table(spark, d, "court_opinions"), "opinion_id", "full_text", OPINIONS_ALIKE)
    return near_duplicates.pairs(rows).select(F.col("a").alias("opinion_a"), F.col("b").alias("opinion_b"))


def _actors(spark: SparkSession, d: str):
    actors = table(spark, d, "accountability_actors")
    return name_links.entities(actors, "actor_id", [F.col("role"), F.col("jurisdiction")], F.col("display_name"), [F.col("bar_number"), F.col("badge_number"), F.col("prosecutor_id")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The registered judge that cases and findings name, and the first row of every actor's entity."""
    rows, forms = _actors(spark, d)
    out = rows.filter("entity != id").select(F.lit("actors").alias("src"), F.col("id").alias("rec_id"), F.col("entity").alias("actor_id"))
    named = None
    for src, name, key, order in (("cases", "court_cases", "case_id", "inserted_at"), ("findings", "constitutional_findings", "finding_id", "ingested_at")):
        held = latest_by(table(spark, d, name), key, [F.col(order)], {"judge": F.col("judge"), "jurisdiction": F.col("jurisdiction")})
        held = held.select(F.lit(src).alias("src"), F.col("_key").alias("rec_id"), "judge", "jurisdiction")
        named = held if named is None else named.unionByName(held)
    scope = [F.lit("judge"), F.col("jurisdiction")]
    judges = forms.filter(F.startswith("scope", F.lit("judge\x1f")))
    found = name_links.match(name_links.spellings(named, scope, F.col("judge")), judges)
    keyed = named.withColumn("scope", F.concat_ws("\x1f", *scope))
    linked = keyed.join(found, (keyed.scope == found.scope) & (keyed.judge == found.text)).select("src", "rec_id", F.col("entity").alias("actor_id"))
    return out.unionByName(linked)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether their ids decode to their text again."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return docs.join(back, "doc_id").groupBy((F.col("was") == F.col("text")).alias("same")).agg(F.count("*").alias("n_docs"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.token_counts(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size"))
    return packing.pack(sized, CAPACITY)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, and of every part of one that alone is too long."""
    return _packed(spark, d).select(F.col("id").alias("doc_id"), "part", F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(_packed(spark, d), CAPACITY)


def _abuse(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score(docs, abuse.fit(docs, table(spark, d, "labels")), keep=keep)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document and whether it holds a toxic passage."""
    return _abuse(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a toxic passage."""
    return p8_scores(spark, d).filter("toxic").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents per source."""
    return abuse.rates(_abuse(spark, d, "source"))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_scores, p8_rates)}

# Opinions by definition: sets of three-word runs, all pairs that share a run, and the closure of what is alike.
_ALIKE = r"""WITH RECURSIVE w AS (SELECT DISTINCT opinion_id AS id, full_text AS t, regexp_extract_all(lower(full_text), '[\p{L}\p{N}]+') AS ws FROM court_opinions WHERE full_text IS NOT NULL AND opinion_id IS NOT NULL),
g AS (SELECT id, t, list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])) AS gs FROM w),
k AS (SELECT id, CASE WHEN len(gs) > 0 THEN md5(array_to_string(gs, '|')) ELSE '=' || t END AS k, gs FROM g), s AS (SELECT k, any_value(gs) AS gs, min(id) AS id FROM k GROUP BY k),
e AS (SELECT k, unnest(gs) AS x FROM s), shared AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN s sa ON sa.k = a JOIN s sb ON sb.k = b WHERE 2 * n >= len(sa.gs) + len(sb.gs) - n),
r AS (SELECT k AS a, k AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(s.id) AS group_id FROM r JOIN s ON s.k = r.b GROUP BY 1), m AS (SELECT k.id, k.k, c.group_id FROM k JOIN c USING (k)) """

ORACLE = {
    "p2_groups": _ALIKE + "SELECT id AS opinion_id, group_id, (SELECT count(*) FROM l WHERE l.a = m.k) AS n_links FROM m",
    "p2_found": _ALIKE + "SELECT DISTINCT a.id AS opinion_a, b.id AS opinion_b FROM m a JOIN m b ON a.group_id = b.group_id AND a.id < b.id",
    "p6_round_trip": "SELECT TRUE AS same, count(*) AS n_docs FROM documents",
}
