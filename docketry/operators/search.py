"""Full-text search: English stems, an inverted index as a table, and BM25 ranking.

Ranks are this engine's own; which texts match is decided by stems, quoted phrases, OR and minus as in web search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.stemmer import STOP_WORDS, stem
from docketry.session import materialize

K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def stems(text: str | None) -> list[str | None]:
    """Stem of every word, None in place of stop words, so that positions stay."""
    return [None if w in STOP_WORDS else stem(w) for w in words(text)]


def _postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, str | None] = {}
    for f in frames:
        ids, terms, places, lengths = [], [], [], []
        for i, t in zip(f["id"], f["text"], strict=True):
            at: dict[str, list[int]] = {}
            all_ = words(t)
            for n, w in enumerate(all_):
                if w not in known:
                    known[w] = None if w in STOP_WORDS else stem(w)
                if (s := known[w]) is not None:
                    at.setdefault(s, []).append(n)
            for s, p in at.items():
                ids.append(i)
                terms.append(s)
                places.append(p)
                lengths.append(len(all_))
        if ids:
            yield pd.DataFrame({"id": ids, "term": terms, "places": places, "length": lengths})


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, places, length): one row per text and stem; null and empty texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(_postings, f"id {kind}, term string, places array<int>, length int")


def stored(postings: DataFrame) -> DataFrame:
    """Postings as a table in the shared folder, a stem's together and files in the order of stems: a search reads the row
    groups of its own."""
    return materialize(postings.repartition("term").sortWithinPartitions("term", "id"), "postings")


def corpus(postings: DataFrame) -> tuple[int, float]:
    """The number of texts with postings and their mean length in words, as ranks need them."""
    one = postings.groupBy("id").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return one["n"], one["mean"] or 1.0


@dataclass(frozen=True)
class Query:
    """Alternatives of required phrases (lists of stems with their distances), and excluded phrases."""

    alternatives: tuple[tuple[tuple[str | None, ...], ...], ...]
    excluded: tuple[tuple[str | None, ...], ...]


def parse(text: str) -> Query:
    """Words and quoted phrases are required, OR divides alternatives, a minus excludes."""
    groups: list[list[tuple[str | None, ...]]] = [[]]
    excluded = []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        phrase = tuple(stems(quoted or word))
        while phrase and phrase[-1] is None:
            phrase = phrase[:-1]
        while phrase and phrase[0] is None:
            phrase = phrase[1:]
        if phrase:
            (excluded if minus else groups[-1]).append(phrase)
    return Query(tuple(tuple(g) for g in groups if g), tuple(excluded))


def _has(by: dict[str, list[int]], phrase: tuple[str | None, ...]) -> bool:
    starts = set(by.get(phrase[0], ()))
    for k, term in enumerate(phrase):
        if term is not None:
            starts &= {p - k for p in by.get(term, ())}
    return bool(starts)


def search(spark: SparkSession, postings: DataFrame, query: str, n_docs: int, mean_length: float, limit: int = 20) -> DataFrame:
    """(id, rank) of the best texts that match, 1 to 100 of them; none for a query of stop words only.

    n_docs, mean_length: corpus(). Only postings of the query's stems are read and grouped; a text contributes one row per
    stem of the query."""
    return _ranked(spark, postings, query, n_docs, mean_length).orderBy(F.desc("rank"), "id").limit(max(1, min(100, limit)))


def search_records(spark: SparkSession, postings: DataFrame, records: DataFrame, fields: tuple[str, ...], query: str, n_docs: int, mean_length: float, limit: int = 20) -> DataFrame:
    """(id, rank, matched_on): texts that match by their stems, and records (id, *fields) one of whose fields holds the whole
    query as it is typed, case aside, at rank 0. A record that matches both ways is one row, by its text; a blank query
    matches nothing."""
    asked = query.strip().lower()
    by_text = _ranked(spark, postings, query, n_docs, mean_length).withColumn("matched_on", F.lit("text"))
    on = F.coalesce(*[F.when(F.contains(F.lower(F.col(f)), F.lit(asked)), F.lit(f)) for f in fields])
    by_field = records.select("id", F.lit(0.0).alias("rank"), on.alias("matched_on")).filter(F.col("matched_on").isNotNull() & F.lit(bool(asked)))
    best = by_text.unionByName(by_field).groupBy("id").agg(F.max(F.struct("rank", "matched_on")).alias("m"))
    return best.select("id", "m.rank", "m.matched_on").orderBy(F.desc("rank"), "id").limit(max(1, min(100, limit)))


def _ranked(spark: SparkSession, postings: DataFrame, query: str, n_docs: int, mean_length: float) -> DataFrame:
    q = parse(query)
    wanted = sorted({t for g in (*q.alternatives, q.excluded) for p in g for t in p if t})
    scored = sorted({t for g in q.alternatives for p in g for t in p if t})
    kind = postings.schema["id"].dataType.simpleString()
    if not q.alternatives:
        return spark.createDataFrame([], f"id {kind}, rank double")
    hits = postings.filter(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row per stem of the query
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.size("places")
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / max(mean_length, 1e-9)))
    ranked = hits.join(F.broadcast(df), "term").withColumn("w", F.when(F.col("term").isin(scored), weight).otherwise(0.0))
    grouped = ranked.groupBy("id").agg(F.collect_list(F.struct("term", "places")).alias("at"), F.sum("w").alias("rank"))

    def matches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for at in f["at"]:
                by = {x["term"]: list(x["places"]) for x in at}
                keep.append(any(all(_has(by, p) for p in g) for g in q.alternatives) and not any(_has(by, p) for p in q.excluded))
            yield f.loc[keep, ["id", "rank"]]

    return grouped.mapInPandas(matches, f"id {kind}, rank double")
