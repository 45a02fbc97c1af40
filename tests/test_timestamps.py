import datetime as dt
import os

import pytest

from docketry.operators import timestamps as T
from pyspark.sql import functions as F

NY = "America/New_York"
CASES = [
    ("2024-11-16T01:16:23-05:00", NY, "2024-11-16T06:16:23.000000Z"),
    ("2023-07-16T19:29:55.913-06:00", NY, "2023-07-17T01:29:55.913000Z"),
    ("2024-10-11t18:05:02z", NY, "2024-10-11T18:05:02.000000Z"),
    ("20191022T161115Z", NY, "2019-10-22T16:11:15.000000Z"),
    ("20250828T101134-0400", NY, "2025-08-28T14:11:34.000000Z"),
    ("2025-06-23 09:16:32", NY, "2025-06-23T13:16:32.000000Z"),
    ("Tue, 23 Jul 2024 08:00:05 -0500", NY, "2024-07-23T13:00:05.000000Z"),
    ("Wed, 1 Jul 2025 08:25:23 EST", NY, "2025-07-01T13:25:23.000000Z"),
    ("2024-12-23 18:30:38 UTC", NY, "2024-12-23T18:30:38.000000Z"),
    ("1744075037", NY, "2025-04-08T01:17:17.000000Z"),
    ("1533073524236", NY, "2018-07-31T21:45:24.236000Z"),
    ("1586939536777066", NY, "2020-04-15T08:32:16.777066Z"),
    ("1586939536777066123", NY, "2020-04-15T08:32:16.777066Z"),
    ("10.09.2021 15:26", NY, "2021-09-10T19:26:00.000000Z"),
    ("11/01/20 01:52", NY, "2020-11-01T05:52:00.000000Z"),  # occurs twice: the first
    ("2024-03-10T02:30", NY, "2024-03-10T07:30:00.000000Z"),  # skipped: moves on
    ("8/29/2023 8:58 PM", NY, "2023-08-30T00:58:00.000000Z"),
    ("12/1/2023 12:05 am", NY, "2023-12-01T05:05:00.000000Z"),
    ("2023-11-30 21.56.37", NY, "2023-12-01T02:56:37.000000Z"),
    ("2024-03-01T12:35:08[America/Phoenix]", NY, "2024-03-01T19:35:08.000000Z"),
    (" November 1, 2025 at 4:06 p.m.\n", NY, "2025-11-01T20:06:00.000000Z"),
    ("Jul. 31, 2025", NY, "2025-07-31T00:00:00.000000Z"),
    ("09-NOV-2025", NY, "2025-11-09T00:00:00.000000Z"),
    ("20220827", NY, "2022-08-27T00:00:00.000000Z"),
    ("3/13/22", NY, "2022-03-13T00:00:00.000000Z"),
    ("2024-02-29", None, "2024-02-29T00:00:00.000000Z"),
    ("2024-07-01 10:00 CEST", NY, "2024-07-01T08:00:00.000000Z"), ("2024-07-01 10:00:00 JST", NY, "2024-07-01T01:00:00.000000Z"), ("2024-07-01 10:00 Europe/Paris", NY, "2024-07-01T08:00:00.000000Z"),
    ("2023-02-29", NY, None), ("2022-06-31T10:00:00Z", NY, None), ("20221301", NY, None), ("2024-01-01 25:00", NY, None), ("1/2/2024 13:00 PM", NY, None),
    ("2024-01-01T10:00:00[Mars/Base]", NY, None), ("2024-01-01 10:00:00 XQT", NY, None), ("2024-01-01 10:00", "nowhere", None), ("2024-01-01 10:00", None, None),
    ("TBD", NY, None), ("see docket", NY, None), ("--", NY, None), ("", NY, None), (None, NY, None), ("12345", NY, None), ("x" * 100_000, NY, None),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles"])
def test_every_notation(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(i, v, z, "x", 1) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string, utc string, text int")
        got = {r["i"]: r["u"] for r in T.instants(df, "v", "z").select("i", T.utc_text(F.col("utc")).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for i, (v, _, want) in enumerate(CASES):
        assert got.get(i) == want, v


def _feed(spark, zone, moved=None):
    """Records of one feed, half with an offset, that arrive between one and three hours after; moved: the zone from July on."""
    from zoneinfo import ZoneInfo

    out = []
    for i in range(360):
        at = dt.datetime(2024, 1, 5, 12, tzinfo=dt.timezone.utc) + dt.timedelta(days=i % 350, minutes=37 * i)
        z = moved if moved and at.month >= 7 else zone
        local = at.astimezone(ZoneInfo(z))
        text = local.strftime("%Y-%m-%d %H:%M:%S") if i % 2 else at.strftime("%Y-%m-%dT%H:%M:%SZ")
        out.append((zone, text, (at + dt.timedelta(minutes=60 + 7 * (i % 17))).replace(tzinfo=None), None))
    return out


def test_missing_zones_are_estimated_from_arrivals(spark):
    data = _feed(spark, "America/New_York") + _feed(spark, "Europe/Berlin") + _feed(spark, "Pacific/Honolulu", "America/Chicago")
    df = spark.createDataFrame(data, "feed string, v string, arrival timestamp_ntz, z string")
    filled = T.with_estimated_zones(df, "v", "z", "feed", "arrival")
    assert filled.count() == df.count() and filled.filter("z is null and _w.instant is null and _w.offset is null").count() == 0
    assert T.resolved(filled, "_w", "z").count() == df.count()
    # no row of these feeds wrote an offset: arrivals alone tell the offset, for some place
    lag = F.timestamp_diff("MINUTE", F.col("utc"), F.col("arrival"))
    fair = T.resolved(filled, "_w", "z").groupBy("feed").agg(F.avg((lag.between(60, 172)).cast("int")).alias("ok")).collect()
    assert all(r["ok"] > 0.97 for r in fair)
    months = T.estimate_zones(df.filter("feed = 'Pacific/Honolulu'"), "v", "feed", "arrival", zones=("Pacific/Honolulu", "America/Chicago"))
    zones = [r["zone"] for r in months.orderBy("week").collect()]
    assert zones == sorted(zones, reverse=True) and set(zones) == {"Pacific/Honolulu", "America/Chicago"}


def test_evidence_of_a_feed_of_its_group_and_of_declared_zones(spark):
    at = dt.datetime(2024, 1, 10, 12)
    rows = [("a", "g", "2024-01-10T07:00:00-05:00", at, None), ("a", "g", "2024-07-10T07:00:00-04:00", at, None), ("a", "g", "2024-03-01 09:00", None, None), ("b", "g", "2024-02-01 08:00", None, " "), ("c", "h", "2024-02-01 08:00", at, "Asia/Tokyo"), ("c", "h", "2024-02-02 08:00", at, None), (None, None, "2024-02-03 08:00", at, None)]
    df = spark.createDataFrame(rows, "feed string, grp string, v string, arrival timestamp_ntz, z string").withColumn("week", F.lit(1)).withColumn("wrote", F.lit("x"))
    got = {r["v"]: r["z"] for r in T.with_estimated_zones(df, "v", "z", "feed", "arrival", "grp").collect()}
    new_york = dt.datetime(2024, 3, 1, 14)
    at_utc = lambda v: {r["utc"] for r in T.resolved(T.with_estimated_zones(df, "v", "z", "feed", "arrival", "grp").filter(F.col("v") == v), "_w", "z").collect()}
    assert at_utc("2024-03-01 09:00") == {new_york} and at_utc("2024-02-01 08:00") == {dt.datetime(2024, 2, 1, 13), dt.datetime(2024, 1, 31, 23)}
    assert got["2024-02-02 08:00"] == "Asia/Tokyo" and got["2024-02-03 08:00"] is not None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_a_feed_that_moved_to_another_zone(spark):
    """Entries of two courts of different zones as one feed: the first court's until the middle of 2022, the second's after."""
    entries = spark.read.parquet("/root/testdata/sf0.1/feed_entries.parquet").dropDuplicates(["entry_id"])
    early, late, moves = "avlkessary", "yrltemh-4", "2022-07-01"
    one = entries.filter((F.col("court_id") == early) & (F.col("fetched_at") < moves)).unionByName(entries.filter((F.col("court_id") == late) & (F.col("fetched_at") >= moves)))
    rest = entries.filter(~F.col("court_id").isin(early, late))
    df = one.withColumn("court_id", F.lit("moved")).unionByName(rest).withColumn("z", F.lit(None).cast("string"))
    rows = T.with_estimated_zones(df, "published", "z", "court_id", "fetched_at")
    w = F.col("_w")
    rows = rows.filter((F.col("court_id") == "moved") & ~w["dated"] & w["local"].isNotNull() & w["offset"].isNull() & w["zone"].isNull() & (F.timestamp_diff("DAY", w["local"], F.col("fetched_at").cast("timestamp_ntz")) < 20))
    same = F.convert_timezone(F.col("z"), F.lit("UTC"), w["local"]) == F.convert_timezone(F.col("feed_zone"), F.lit("UTC"), w["local"])
    n = rows.groupBy("feed_zone").agg(F.count("*").alias("n"), F.count_if(same).alias("right")).collect()
    assert len(n) == 2 and all(r["n"] > 10 and r["right"] >= 0.9 * r["n"] for r in n), n


def test_empty_tables(spark):
    df = spark.createDataFrame([], "feed string, v string, arrival timestamp_ntz, z string")
    assert T.instants(df, "v", "z").count() == 0
    assert T.with_estimated_zones(df, "v", "z", "feed", "arrival").count() == 0
