"""Seed rows and a fixture poll, as DataFrames: what tests and demonstrations start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CASE = "case_id string, docket_number string, jurisdiction string, court_level string, case_type string, charge_category string, charges array<string>, prosecutor_id string, judge string, defendant_race string, evidence_strength string, outcome string, plea_offered boolean, plea_accepted boolean, plea_offer_months int, sentence_months int, sentence_type string"
#: Docket, group, evidence, charge, judge, accepted, offer, sentence, prosecutor.
_ROWS = (
    ("DEMO-2024-001", "Black", "weak", "drug", "Smith J.", False, 12, 36, "p1"),
    ("DEMO-2024-002", "White", "mixed", "drug", "Smith J.", False, 12, 18, "p1"),
    ("DEMO-2024-003", "Black", "strong", "assault", "Lee J.", True, 24, 24, "p1"),
    ("OTHER-2024-001", "Hispanic", "weak", "drug", "Nguyen J.", False, 6, 8, "p2"),
)


def demo_cases(spark: SparkSession) -> DataFrame:
    """Four convictions in one state; all were offered a plea."""
    rows = [(f"c{i}", r[0], "CA", "superior", "criminal", r[3], [r[3], "other"] if not i else [r[3]], r[8], r[4], r[1], r[2], "conviction", True, r[5], r[6], r[7], "custody") for i, r in enumerate(_ROWS)]
    return spark.createDataFrame(rows, _CASE)


def demo_prosecutors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p1", "Demo Prosecutor", "Demo County DA", "CA"), ("p2", "Other Prosecutor", "Other County DA", "CA")], "prosecutor_id string, name string, office string, jurisdiction string")


def fixture_poll(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """One case and one full opinion."""
    cases = spark.createDataFrame([("FIXTURE-2024-001", "cand", "cand", 37.7849, -122.4094)], "docket_number string, jurisdiction string, source_court_id string, lat double, lng double")
    body = "The interview with Officer Jane Roe and the body-worn camera footage were requested. A forensic report existed; the chain of custody documentation was not produced."
    opinions = spark.createDataFrame([("FIXTURE-2024-001", "full", body)], "docket_number string, text_completeness string, full_text string")
    return cases, opinions
