"""Evidence that opinions mention, and what of it was not disclosed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Item types, their patterns and descriptions; {} is the pattern's first group.
PATTERNS = (
    ("witness_interview", r"(?:interview(?:ed)?|statement(?:s)?)\s+(?:with\s+)?([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})", "Interview/statement of {}"),
    ("bodycam", r"body[- ]?worn\s+(?:camera|video|footage)", "Body-worn camera footage"),
    ("lab_report", r"(?:lab(?:oratory)?|forensic)\s+report(?:s)?", "Laboratory/forensic report"),
    ("chain_of_custody", r"chain\s+of\s+custody", "Chain-of-custody documentation"),
    ("informant_benefit", r"(?:informant|cooperat(?:ing|or)|cooperator)\s+(?:received|was\s+promised|benefits?|leniency|immunity|deal)", "Informant/cooperator benefit disclosures"),
    ("911_call", r"911\s+(?:call|recording|dispatch)", "911 call/recording"),
    ("forensic_worksheet", r"forensic\s+worksheet|analyst\s+notes|bench\s+notes", "Forensic analyst worksheets/notes"),
)


def _found(text: Column, number: int, item_type: str, pattern: str, template: str) -> Column:
    """Items of one pattern in the order in which they stand in the text."""
    named = "{}" in template
    matches = F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(1 if named else 0))
    item = lambda m, i: F.struct(
        F.lit(number).alias("pattern"), i.alias("at"), F.lit(item_type).alias("item_type"), (F.replace(F.lit(template), F.lit("{}"), F.trim(m)) if named else F.lit(template)).alias("description")
    )
    return F.transform(matches, item)


def expected_items(texts: DataFrame, keep: list[str], text: str, patterns=PATTERNS) -> DataFrame:
    """keep columns, item_type and description: what a text mentions, the first of items that differ in case only.

    Null and empty texts mention nothing. The work is inside each row, so nothing is shuffled."""
    items = F.flatten(F.array(*[_found(F.col(text), i, *p) for i, p in enumerate(patterns)]))
    # the first of equal items: those before it in the list have another key
    key = lambda x: F.concat_ws("|", x["item_type"], F.lower(x["description"]))
    first = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: key(y) == key(x)))
    deduped = F.element_at(F.transform(F.array(items), first), 1)
    return texts.select(*keep, F.explode(deduped).alias("_i")).select(*keep, "_i.item_type", "_i.description")


def first_wins(rows: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def gaps(expected: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Expected items (case_id, item_type, description) for which nothing was disclosed: no item of the same case and type
    whose lower-case description contains, or is contained in, theirs. Descriptions that are null match nothing.

    The equi-key is case and type; disclosed items are first made distinct, so repeats of one item cost nothing."""
    have = disclosed.select("case_id", "item_type", F.lower("description").alias("_d")).filter("_d is not null").distinct()
    want = F.lower(expected.description)
    matched = (expected.case_id == have.case_id) & (expected.item_type == have.item_type) & (F.contains(want, have["_d"]) | F.contains(have["_d"], want))
    return expected.join(have, matched, "left_anti").withColumn("request", F.concat(F.lit("Please provide any "), F.replace("item_type", F.lit("_"), F.lit(" ")), F.lit(" records: "), F.col("description")))
