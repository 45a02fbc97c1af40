"""Placing a court in a forum: an ordered decision table over its id, class, name and citation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels, and the classes of state courts by level.
SUPREME, APPELLATE, TRIAL = "state_supreme", "state_appellate", "state_trial"
CIRCUIT_LEVEL, DISTRICT_LEVEL, SCOTUS = "federal_circuit", "federal_district", "scotus"
LEVEL_CLASSES = ((SUPREME, ("S", "TS")), (APPELLATE, ("SA", "TA")), (TRIAL, ("ST", "SS", "SAG", "TT", "TSP")))


def state_level(source_class: Column) -> Column:
    out = F.lit(None).cast("string")
    for level, classes in LEVEL_CLASSES:
        out = F.when(source_class.isin(*classes), level).otherwise(out)
    return out


def is_state_forum(level: Column) -> Column:
    """Whether a level is a state's: false only for the three federal ones, so null and unknown levels are."""
    return F.coalesce(~F.lower(F.trim(level)).isin(CIRCUIT_LEVEL, DISTRICT_LEVEL, SCOTUS), F.lit(True))


def state_from_federal_id(court_id: Column, codes: tuple[str, ...]) -> Column:
    """The code that a federal district or bankruptcy court's id begins with, or null."""
    part = F.upper(F.regexp_extract(F.lower(F.trim(court_id)), r"^(?=[a-z]{3,5}$)([a-z]{2})[nsewmc]?(?:d|bc|b)$", 1))
    return F.when(part.isin(*codes), part)


def state_from_name(text: Column, forums: tuple[tuple[str, str], ...]) -> Column:
    """The code of the longest forum name that stands in text as a word; names are also met without a leading "u.s. ".

    forums: (code, name), a fixed catalog, tried longest name first."""
    out = F.lit(None).cast("string")
    for code, name in sorted(forums, key=lambda f: len(f[1])):
        forms = {name.lower(), name.lower().removeprefix("u.s. ")}
        pattern = "|".join(sorted(f.replace(".", r"\.") for f in forms))
        out = F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])"), code).otherwise(out)
    return out


def derive(court_id: Column, source_class: Column, full_name: Column, citation: Column, forums: tuple[tuple[str, str], ...]) -> Column:
    """struct(jurisdiction, level, method): where a court sits and by which rule; all null but the method if unplaced."""
    codes = tuple(c for c, _ in forums)
    cid, cls = F.lower(F.trim(court_id)), F.upper(F.trim(F.coalesce(source_class, F.lit(""))))
    name = F.coalesce(full_name, F.lit(""))
    to = lambda jur, level, method: F.struct(jur.cast("string").alias("jurisdiction"), level.cast("string").alias("level"), F.lit(method).alias("method"))
    us = F.lit("US")
    numbered = cid.rlike(r"^ca\d{1,2}$")
    federal = F.startswith(cls, F.lit("F")) | F.startswith(cls, F.lit("MA")) | numbered
    circuit = (cls == "F") | cid.isin("cafc", "cadc", "cavc") | numbered
    district = cls.isin("FD", "FB")
    by_id, by_name, by_citation = state_from_federal_id(court_id, codes), state_from_name(name, forums), state_from_name(citation, forums)
    stateish = F.startswith(cls, F.lit("S")) | F.startswith(cls, F.lit("T")) | (cls == "")
    level = state_level(cls)
    return (
        F.when((cid == SCOTUS) | (F.lower(name) == "supreme court of the united states"), to(us, F.lit(SCOTUS), "scotus"))
        .when(federal & circuit, to(us, F.lit(CIRCUIT_LEVEL), "federal_circuit"))
        .when(federal & district & by_id.isNotNull() & (cls == "FB"), to(by_id, F.lit(DISTRICT_LEVEL), "federal_bankruptcy_id"))
        .when(federal & district & by_id.isNotNull(), to(by_id, F.lit(DISTRICT_LEVEL), "federal_district_id"))
        .when(federal & district & by_name.isNotNull(), to(by_name, F.lit(DISTRICT_LEVEL), "federal_district_name"))
        .when(federal & (cls == "FBP"), to(us, F.lit(CIRCUIT_LEVEL), "federal_bankruptcy_appellate"))
        .when(federal & (cls == "FS"), to(us, F.lit(CIRCUIT_LEVEL), "federal_special"))
        .when(federal & F.startswith(cls, F.lit("MA")), to(us, F.lit(CIRCUIT_LEVEL), "military_appellate"))
        .when(federal, to(us, F.lit(CIRCUIT_LEVEL), "federal_other"))
        .when(F.startswith(cls, F.lit("TR")), to(F.lit(None), F.lit(None), "tribal_sovereign"))
        .when(stateish & by_name.isNotNull(), to(by_name, level, "state_name"))
        .when(stateish & by_citation.isNotNull(), to(by_citation, level, "state_citation"))
        .when(stateish & F.upper(cid).isin(*codes), to(F.upper(cid), level, "state_id"))
        .otherwise(to(F.lit(None), F.lit(None), "unmapped"))
    )
