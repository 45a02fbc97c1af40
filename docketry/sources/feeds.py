"""Recorded feed pages to cases, opinions and courts. Every reader takes files, so that a poll is a batch of a stream."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text

SEARCH_SCHEMA = "next string, results array<struct<court_id string, docket_id bigint, docketNumber string, caseName string, judge string, dateFiled string, absolute_url string, blocked boolean, score double, opinions array<struct<id bigint, snippet string>>>>"
DOCKET_SCHEMA = "docket_number string, court_id string, court string, assigned_to_str string, date_filed string, absolute_url string, blocked boolean"
OPINION_SCHEMA = "id bigint, blocked boolean, plain_text string, html_with_citations string, html string, docket_number string, citation string, author_str string, date_created string, absolute_url string, cluster struct<docket_number string, case_name string, date_filed string>"
COURT_SCHEMA = "id string, full_name string, short_name string, citation_string string, jurisdiction string, in_use boolean, parent_court string, start_date string, end_date string"
ATOM_SCHEMA = "title string, link array<struct<_rel string, _href string>>, published string, updated string, author struct<name string>, id string, summary string, category struct<_term string>"


def _filled(c: Column) -> Column:
    """A trimmed text; null if nothing is left."""
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def _case(docket: Column, court: Column, judge: Column, filed: Column, url: Column, raw: Column) -> list[Column]:
    return [docket.alias("docket_number"), F.coalesce(court, F.lit("unknown")).alias("jurisdiction"), _filled(court).alias("source_court_id"), judge.alias("judge"), filed.alias("filed"), url.alias("source_url"), raw.alias("raw_data")]


def _opinion(docket: Column, citation: Column, judge: Column, issued: Column, body: Column, completeness: str, url: Column, ref: Column) -> list[Column]:
    return [docket.alias("docket_number"), citation.alias("citation"), judge.alias("judge"), issued.alias("date_issued"), body.alias("full_text"), F.lit(completeness).alias("text_completeness"), url.alias("source_url"), ref.alias("source_ref")]


def search_hits(spark: SparkSession, path: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Cases and snippet opinions of search pages. A hit without a docket number takes its docket id, without either it is
    skipped; so are hits that must not be shown and opinions without a snippet."""
    hits = spark.read.schema(SEARCH_SCHEMA).json(path, multiLine=True).select(F.explode("results").alias("r"))
    docket = F.coalesce(_filled(F.col("r.docketNumber")), F.concat(F.lit("cl-docket:"), F.col("r.docket_id").cast("string")))
    hits = hits.withColumn("docket", docket).withColumn("raw", F.to_json("r")).filter(F.col("docket").isNotNull())
    hits = hits.filter(~text.is_excluded(F.col("docket"), F.col("raw")))
    url, filed, judge = text.absolute_url(F.col("r.absolute_url"), base), text.first_date(F.col("r.dateFiled")), _filled(F.col("r.judge"))
    cases = hits.select(*_case(F.col("docket"), F.col("r.court_id"), judge, filed, url, F.col("raw")))
    each = hits.withColumn("o", F.explode("r.opinions")).withColumn("snippet", _filled(F.col("o.snippet"))).filter("snippet is not null")
    ref = F.concat(F.lit("cl-opinion:"), F.col("o.id").cast("string"))
    opinions = each.select(*_opinion(F.col("docket"), F.coalesce(F.nullif(F.col("r.caseName"), F.lit("")), F.col("docket")), judge, filed, F.col("snippet"), "snippet", url, ref))
    return cases, opinions


def hit_rows(spark: SparkSession, path: str, base: str, limit: int = 50) -> DataFrame:
    """(docket_number, caption, court_id, filed, url, snippet, chars) of search pages as a result list of 1 to 50 rows, best
    first. Hits with an excluding word are left out; whether one is blocked is not looked at here."""
    r = spark.read.schema(SEARCH_SCHEMA).json(path, multiLine=True).select(F.explode("results").alias("r")).withColumn("raw", F.to_json(F.col("r").dropFields("blocked")))
    docket = F.coalesce(_filled(F.col("r.docketNumber")), F.concat(F.lit("cl-docket:"), F.col("r.docket_id").cast("string")))
    r = r.withColumn("docket_number", docket).filter(~text.is_excluded(F.col("docket_number"), F.col("raw")))
    snippet = _filled(F.try_element_at("r.opinions", F.lit(1))["snippet"])
    out = r.select("docket_number", F.coalesce(_filled(F.col("r.caseName")), F.col("docket_number")).alias("caption"), _filled(F.col("r.court_id")).alias("court_id"), text.first_date(F.col("r.dateFiled")).alias("filed"), text.absolute_url(F.col("r.absolute_url"), base).alias("url"), snippet.alias("snippet"), F.length(snippet).alias("chars"), "r.score")
    return out.orderBy(F.desc_nulls_last("score"), "docket_number").limit(max(1, min(50, limit))).drop("score")


def court(registry: DataFrame, court_id: str) -> DataFrame:
    """The registry rows of one court, as the id is compared; an id with other characters than letters, digits, dots, dashes
    and underscores is an error."""
    wanted = court_id.strip().lower()
    if not re.fullmatch(r"[a-z0-9._-]{1,80}", wanted):
        raise ValueError(f"{court_id!r} is no court id")
    return registry.filter(F.lower(F.trim("court_id")) == wanted)


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published, author, category, summary) of Atom files; entries without an alternate link are dropped."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    alternate = F.filter("link", lambda x: (x["_href"] != "") & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"))
    link = F.try_element_at(alternate, F.lit(1))["_href"]
    return e.select("title", link.alias("link"), F.coalesce("published", "updated").alias("published"), F.col("author.name").alias("author"), F.col("category._term").alias("category"), "summary").filter("link is not null")


def court_feed(entries: DataFrame, court: str) -> tuple[DataFrame, DataFrame]:
    """Cases and summary opinions of a court's feed. The docket number is the one printed in the text, else the opinion's
    reference, else a hash of the link; entries without text and those that must not be shown are skipped."""
    e = entries.withColumn("body", text.summary_text(F.col("summary"))).filter(F.length(F.trim("body")) > 0)
    ref = F.concat(F.lit("cl-opinion:"), text.opinion_number(F.col("link")))
    docket = F.coalesce(text.docket_from_text(F.col("body")), ref, F.concat(F.lit("cl-feed:"), F.substring(F.sha2(F.to_json(F.struct("link")).cast("binary"), 256), 1, 16)))
    raw = F.to_json(F.struct(F.lit(court).alias("court_id"), "title", "link", "published", "author", "category"))
    e = e.withColumn("docket", docket).withColumn("raw", raw).filter(~text.is_excluded(F.col("docket"), F.col("raw")))
    none, filed = F.lit(None).cast("string"), text.first_date(F.col("published"))
    cases = e.select(*_case(F.col("docket"), F.lit(court), none, filed, F.col("link"), F.col("raw")))
    return cases, e.select(*_opinion(F.col("docket"), F.col("title"), none, filed, F.col("body"), "summary", F.col("link"), ref))


def dockets(rows: DataFrame, base: str) -> DataFrame:
    """Cases of docket records given as JSON text (column value)."""
    r = rows.select("value", F.from_json("value", DOCKET_SCHEMA).alias("r")).withColumn("docket", _filled(F.col("r.docket_number")))
    r = r.filter(F.col("docket").isNotNull() & ~text.is_excluded(F.col("docket"), F.col("value")))
    segment = F.regexp_extract(F.col("r.court"), r"([^/]+)/*$", 1)
    court = F.coalesce("r.court_id", F.nullif(segment, F.lit("")))
    return r.select(*_case(F.col("docket"), court, _filled(F.col("r.assigned_to_str")), text.first_date(F.col("r.date_filed")), text.absolute_url(F.col("r.absolute_url"), base), F.col("value")))


def opinions(rows: DataFrame, base: str) -> DataFrame:
    """Full opinions of opinion records given as JSON text (column value): plain text first, then the HTML ones."""
    r = rows.select(F.from_json("value", OPINION_SCHEMA).alias("r")).filter(~F.coalesce("r.blocked", F.lit(False)))
    body = _filled(F.coalesce(_filled(F.col("r.plain_text")), F.col("r.html_with_citations"), F.col("r.html")))
    ref = F.concat(F.lit("cl-opinion:"), F.col("r.id").cast("string"))
    issued = text.first_date(F.coalesce("r.date_created", "r.cluster.date_filed"))
    return r.withColumn("body", body).filter("body is not null").select(
        *_opinion(F.coalesce("r.cluster.docket_number", "r.docket_number"), F.coalesce("r.citation", "r.cluster.case_name"), _filled(F.col("r.author_str")), issued, F.col("body"), "full", text.absolute_url(F.col("r.absolute_url"), base), ref)
    )


def courts(rows: DataFrame, base: str) -> DataFrame:
    """Registry rows of court records given as JSON text (column value); records without an id are dropped."""
    r = rows.select("value", F.from_json("value", COURT_SCHEMA).alias("r")).filter("r.id is not null")
    return r.select(
        F.col("r.id").alias("court_id"), F.coalesce("r.full_name", "r.id").alias("full_name"), "r.short_name", F.nullif(F.col("r.citation_string"), F.lit("")).alias("citation_string"), F.col("r.jurisdiction").alias("source_class"), F.coalesce("r.in_use", F.lit(False)).alias("in_use"), "r.parent_court",
        text.first_date(F.col("r.start_date")).alias("start_date"), text.first_date(F.col("r.end_date")).alias("end_date"), F.concat(F.lit(f"{base}/courts/"), F.col("r.id"), F.lit("/")).alias("source_url"), F.col("value").alias("raw"),
    )
