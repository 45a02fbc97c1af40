"""Written times of many kinds to the one instant they denote.

A value is rewritten by one regular expression per family of notations into the same list of fields, all in the JVM. A
zone written in the value holds; else the zone column of the row; where both are missing the zone is estimated for the
feed. Every zone is an offset history, one offset a week. A history is violated by a local time that would come after its
own arrival, and by a local time of the feed that wrote another offset; how likely the lags to the arrivals are tells
histories apart that are violated alike, and what the other feeds of the same group show tells the rest. The sequence
of histories with the least cost is chosen, a change of history having a price of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialize

# Zone abbreviations and their offsets in minutes. Where several zones share one (CST, BST, AST, MST), the
# American one holds, and for BST the British.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "SST": -660, "CHST": 600,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "SAST": 120, "PKT": 300, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Cost of a time after its own arrival or of another written offset; no lag costs more. A change of history costs as much.
VIOLATION = 12.0
#: Feeds that a group's own are weighed against: what all feeds show counts as so many more in a group.
PRIOR_FEEDS = 0.5
#: Weeks begin on Sundays, when clocks change; those before 1970 and after 2099 count as the first and the last.
FIRST_WEEK, LAST_WEEK = 0, 6783
#: Lag bins per doubling of one hour plus the lag.
BINS = 6

_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_ZONE = r"(z|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z0-9_+-]+)+|\[[^\]]*\])?"
_TIME = rf"(?:(?:\s*t|,?\s+(?:at\s+)?)(\d{{1,2}})[:.](\d{{2}})(?:[:.](\d{{2}})(?:[.,](\d{{1,9}}))?)?\s*([ap]\.?m\b\.?)?\s*{_ZONE})?"
#: Family, pattern, and where year, month and day stand; the rest of the groups are those of _TIME.
_FAMILIES = (
    ("iso", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_TIME}", ("$1", "$2", "$3")),
    ("compact", rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?()\s*{_ZONE})?", ("$1", "$2", "$3")),
    ("day_month", rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH}\.?,?[\s-]+(\d{{4}}|\d{{2}}){_TIME}", ("$3", "$2", "$1")),
    ("month_day", rf"{_WEEKDAY}{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}", ("$3", "$1", "$2")),
    ("slash", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_TIME}", ("$3", "$1", "$2")),
    ("dot", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_TIME}", ("$3", "$2", "$1")),
)


def zone_names(spark) -> Column:
    """The zone names the JVM knows, as one array. It is split from one literal, which keeps plans small."""
    names = sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.split(F.lit("|".join(names)), r"\|")


def _fields(text: Column) -> Column:
    """year|month|day|hour|minute|second|fraction|am or pm|zone of a lower-case value, null if no family fits."""
    out = F.lit(None).cast("string")
    for _, pattern, (y, m, d) in reversed(_FAMILIES):
        full = f"^{pattern}$"
        out = F.when(text.rlike(full), F.regexp_replace(text, full, "|".join((y, m, d, "$4", "$5", "$6", "$7", "$8", "$9")))).otherwise(out)
    return F.split(out, r"\|")


def _number(col: Column) -> Column:
    return F.when(col != "", col.try_cast("int"))


def _month(col: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), col)
    return F.when(at > 0, at.cast("int")).otherwise(_number(col))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the optimizer would else copy it to each place it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parsed(f: Column, names: Column) -> Column:
    """The struct of parse() from the fields of a value."""
    year = _number(f[0]) + F.when(F.length(f[0]) == 2, 2000).otherwise(0)
    half, hour = F.substring(f[7], 1, 1), _number(f[3])
    hour24 = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    dated = f[3] == ""
    second, minute = F.coalesce(_number(f[5]), F.lit(0)), _number(f[4])
    timed = (hour24 <= 23) & (minute <= 59) & (second <= 59)
    micros = F.rpad(F.substring(f[6], 1, 6), 6, "0").try_cast("int")
    seconds = (second + F.coalesce(micros, F.lit(0)) / F.lit(1_000_000)).cast("decimal(16,6)")
    at = lambda h, m, s: F.try_make_timestamp_ntz(year, _month(f[1]), _number(f[2]), h, m, s)
    local = F.when(dated, at(F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))).when(timed, at(hour24, minute, seconds))
    zone = F.regexp_replace(f[8], r"^\[|\]$", "")
    named = F.startswith(f[8], F.lit("[")) | F.contains(f[8], F.lit("/"))
    signed = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    part = lambda i: F.regexp_extract(zone, signed, i)
    minutes = F.coalesce(_number(part(2)), F.lit(0)) * 60 + F.coalesce(_number(part(3)), F.lit(0))
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k.lower()), F.lit(v))])
    offset = F.when(zone.rlike(signed), F.when(minutes <= 1080, F.when(part(1) == "-", -minutes).otherwise(minutes))).when(~named, F.try_element_at(table, zone))
    name = F.when(named, F.try_element_at(F.filter(names, lambda n: F.lower(n) == zone), F.lit(1)))
    meant = (zone == "") | offset.isNotNull() | name.isNotNull()
    return F.when(meant & local.isNotNull(), F.struct(local.alias("local"), F.when(zone != "", offset).alias("offset"), name.alias("zone"), dated.alias("dated"), F.lit(None).cast("timestamp_ntz").alias("instant")))


def parse(value: Column, names: Column) -> Column:
    """struct(local, offset, zone, dated, instant) of a written value; null where it is null, blank, meaningless or
    impossible (a 31st of June, hour 25, an unknown zone).

    local is the timestamp_ntz as written, offset the minutes of a written offset or abbreviation, zone a written zone
    name, dated whether it is a date alone; instant is set, and the rest null, for numbers counted since 1970 UTC. names:
    the zone names that are known (see zone_names)."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(value, r"[\s\u00a0\u2007\u202f\u200b\ufeff]+", " "), r"^ | $", ""))
    # seconds, or thousandths, millionths, billionths by the number's length; whole seconds and millionths apart
    n = F.length
    count = lambda t: F.when(n(t) <= 11, F.rpad(t, n(t) + 6, "0")).when(n(t) <= 14, F.rpad(t, n(t) + 3, "0")).when(n(t) <= 17, t).otherwise(F.substring(t, F.lit(1), n(t) - 3)).try_cast("bigint")
    instant = lambda c: F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    numeric = lambda t: F.when(
        count(t).isNotNull(),
        F.struct(F.lit(None).cast("timestamp_ntz").alias("local"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("string").alias("zone"), F.lit(False).alias("dated"), instant(count(t)).alias("instant")),
    )
    return _once(clean, lambda t: F.when(t.rlike(r"^\d{9,20}$"), numeric(t)).otherwise(_once(_fields(t), lambda f: _parsed(f, names))))


def _instant(parsed: Column, zone: Column, names: Column) -> Column:
    known = F.when(F.array_contains(names, zone), zone)
    local, offset = parsed["local"], parsed["offset"]
    return (
        F.when(parsed["instant"].isNotNull(), parsed["instant"])
        .when(parsed["dated"], local)
        .when(offset.isNotNull(), local - F.make_dt_interval(F.lit(0), F.lit(0), offset))
        .otherwise(F.convert_timezone(F.coalesce(parsed["zone"], known), F.lit("UTC"), local))
    )


def parsed(df: DataFrame, value: str, out: str = "written") -> DataFrame:
    """The rows of df whose value can be read, with out, the struct of parse()."""
    read = F.filter(F.array(parse(F.col(value), zone_names(df.sparkSession))), lambda p: p.isNotNull())
    # generated, not projected: a later filter is then not pushed into another copy of the expression
    return df.select(*[c for c in df.columns if c != out], F.explode(read).alias(out))


def instants(df: DataFrame, value: str, zone: str, out: str = "utc") -> DataFrame:
    """The rows of df whose value denotes a time, with out, its instant, as a timestamp_ntz in UTC.

    A written offset, name or abbreviation overrides the zone column. A date alone is midnight UTC. Of a local time that
    occurs twice the first is meant, a skipped one moves on by the skipped hour. Values that are null, blank, meaningless
    or impossible give no row, nor do local times whose zone is null, blank or unknown."""
    return resolved(parsed(df, value, "_w"), "_w", zone, out).drop("_w")


def resolved(df: DataFrame, written: str, zone: str, out: str = "utc") -> DataFrame:
    """Rows of parsed() whose instant is known, with out: see instants(). A column named out is replaced."""
    at = _instant(F.col(written), F.col(zone), zone_names(df.sparkSession))
    return df.select(*[c for c in df.columns if c != out], F.explode(F.filter(F.array(at), lambda x: x.isNotNull())).alias(out))


def utc_text(at: Column) -> Column:
    """A timestamp_ntz as 2024-03-05T14:03:22.000000Z, whatever the session's zone."""
    text = at.cast("string")
    return F.when(at.isNotNull(), F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z")))


def _week(local: Column) -> Column:
    """The number of the week of a local time, the first beginning on the Sunday before 1970."""
    days = F.date_diff(local.cast("date"), F.lit("1970-01-01").cast("date")) + 4
    return F.greatest(F.lit(FIRST_WEEK), F.least(F.lit(LAST_WEEK), F.floor(days / 7).cast("int")))


def _offset_at(zone: Column, local: Column) -> Column:
    """Minutes by which a zone is ahead of UTC at one of its local times."""
    return F.timestamp_diff("MINUTE", F.convert_timezone(zone, F.lit("UTC"), local), local).cast("int")


def zone_histories(spark, first: int, last: int, zones: list[str]) -> tuple[list[str], np.ndarray]:
    """The different offset histories of zones between two weeks: a zone of each, the first of the list, and a matrix of
    minutes, weeks by histories. It has no more columns than there are zones, and no more rows than weeks from 1970 to
    2099."""
    listed = spark.createDataFrame([(i, z) for i, z in enumerate(zones)], "rank int, zone string")
    noon = F.to_timestamp_ntz(F.lit("1969-12-31 12:00:00"))
    mid = lambda w: noon + F.make_dt_interval(w * 7)
    each = listed.select("rank", "zone", F.transform(F.sequence(F.lit(first), F.lit(last)), lambda w: _offset_at(F.col("zone"), mid(w))).alias("minutes"))
    rows = sorted(each.groupBy("minutes").agg(F.min(F.struct("rank", "zone")).alias("r")).collect(), key=lambda r: r["r"]["rank"])
    return [r["r"]["zone"] for r in rows], np.array([r["minutes"] for r in rows], np.int32).reshape(len(rows), -1).T


class _Fit:
    """What an estimate is made with: sent to tasks, as large as the histories' matrix."""

    def __init__(self, first: int, names: list[str], minutes: np.ndarray, lags: dict[int, int]):
        self.first, self.names, self.minutes = first, names, minutes
        # density of lags per hour, so that bins of different widths compare; smoothed by a slowly falling share
        n = np.zeros(max([*lags, 0]) + 2)
        for b, k in lags.items():
            n[b] += k
        edges = np.exp2(np.arange(len(n) + 1) / BINS)
        density = (n + 0.5) / (n.sum() + 0.5 * len(n)) / np.diff(edges)
        self.lag_cost = np.minimum(np.log(density.max() / density), VIOLATION)
        self.prior = np.full(len(names), 1 / max(1, len(names)))

    def costs(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Weeks with evidence, in order, and the cost of every history in each."""
        weeks, at = np.unique(rows["week"].to_numpy(), return_inverse=True)
        out = np.zeros((len(weeks), len(self.names)))
        minutes = self.minutes[weeks - self.first]
        wrote, naive, n = (rows[c].to_numpy(np.float64) for c in ("wrote", "naive", "n"))
        for i in range(0, len(rows), 4096):
            part = slice(i, i + 4096)
            of = minutes[at[part]]
            lag = naive[part, None] + of
            bins = np.clip((np.log2(1 + np.maximum(lag, 0) / 60) * BINS), 0, len(self.lag_cost) - 1)
            late = np.where(lag < 0, VIOLATION, self.lag_cost[np.nan_to_num(bins).astype(int)])
            cost = np.where(np.isnan(wrote[part, None]), np.where(np.isnan(lag), 0.0, late), np.where(of != wrote[part, None], VIOLATION, 0.0))
            np.add.at(out, at[part], cost * n[part, None])
        return weeks, out

    def shares(self, total: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """How likely each history is, by its cost and what is known beforehand."""
        cost = total - np.log(prior + 1e-9)
        p = np.exp(cost.min() - cost)
        return p / p.sum()

    def path(self, cost: np.ndarray, prior: np.ndarray, switch_cost: float) -> np.ndarray:
        """The cheapest history per week (Viterbi)."""
        start = -np.log(prior + 1e-9)
        best, back = cost[0] + start, []
        for row in cost[1:]:
            jump = best.min() + switch_cost + start
            back.append(np.where(best <= jump, np.arange(len(start)), best.argmin()))
            best = row + np.minimum(best, jump)
        at = [int(best.argmin())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return np.array(at[::-1])


def _evidence(read: DataFrame, zone: str | None, feed: str, arrival: str, group: str | None) -> DataFrame:
    """(feed, group, week, wrote, naive, lag) of rows of parsed(): the week of a local time and the offset it wrote, or its
    distance to the arrival as if it were UTC, in minutes; lag is that of a row whose instant is known."""
    names = zone_names(read.sparkSession)
    w = F.col("_w")
    declared = F.when(F.array_contains(names, F.col(zone)), F.col(zone)) if zone else F.lit(None).cast("string")
    name = F.coalesce(w["zone"], F.when(w["offset"].isNull(), declared))
    arrived = F.col(arrival).cast("timestamp_ntz")
    local = F.when(~w["dated"], w["local"])
    # an offset of nothing is how UTC is written, and says nothing of the feed
    wrote = F.coalesce(F.nullif(w["offset"], F.lit(0)), F.when(w["offset"].isNull() & name.isNotNull(), _offset_at(name, local)))
    bare = w["offset"].isNull() & name.isNull() & local.isNotNull()
    instant = F.when(bare, F.lit(None)).otherwise(F.coalesce(w["instant"], local - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(w["offset"], wrote))))
    minutes = F.timestamp_diff("MINUTE", local, arrived)
    # to a quarter of an hour in the first four days, to two per cent beyond
    near = F.when(F.abs(minutes) < 5760, F.round(minutes / 15) * 15).otherwise(F.signum(minutes.cast("double")) * F.exp(F.round(F.log(F.abs(minutes).cast("double")) * 50) / 50))
    return read.select(
        F.coalesce(F.col(feed).cast("string"), F.lit("")).alias("feed"),
        (F.col(group).cast("string") if group else F.lit("")).alias("group"),
        F.when(local.isNotNull(), _week(local)).alias("week"),
        wrote.cast("double").alias("wrote"),
        F.when(bare, near).cast("double").alias("naive"),
        F.when(~w["dated"], F.timestamp_diff("MINUTE", instant, arrived)).alias("lag"),
        bare.alias("bare"),
    )


def zone_estimates(read: DataFrame, feed: str, arrival: str, zone: str | None = None, group: str | None = None, zones: tuple[str, ...] | None = None, switch_cost: float = VIOLATION) -> DataFrame:
    """(feed, week, zone) of rows of parsed(), for every feed and week with a local time that has no zone.

    zones: the zones that may be estimated, by default all that the JVM knows; of zones with the same offsets the one that
    the data name most stands for all. group: a column whose feeds are likely to share a zone. zone: the zone column, where
    some rows have one. A null feed is one feed, written ''. Rows without an arrival are judged by the rest of their feed,
    a feed without evidence by its group, that by all feeds. Evidence is added up per feed, week, offset and lag before
    anything is grouped, so what one task sees of a feed with a third of all rows is bounded by weeks and bins."""
    spark = read.sparkSession
    seen = materialize(_evidence(read, zone, feed, arrival, group), "evidence")
    span = seen.agg(F.min("week"), F.max("week")).first()
    schema = "feed string, week int, zone string"
    if span[0] is None:
        return spark.createDataFrame([], schema)
    bins = F.when(F.col("lag") >= 0, F.floor(F.log2(1 + F.col("lag") / 60) * BINS).cast("int"))
    lags = {r["b"]: r["n"] for r in seen.groupBy(bins.alias("b")).agg(F.count("*").alias("n")).collect() if r["b"] is not None}  # as many rows as doublings of the longest lag, times BINS
    if zones is None:
        every = sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
        named = read.select(F.coalesce("_w.zone", F.col(zone) if zone else F.lit(None)).alias("z")).groupBy("z").agg(F.count("*").alias("n")).filter(F.array_contains(zone_names(spark), F.col("z")))
        often = {r["z"]: r["n"] for r in named.collect()}  # names of zones, of which there are about 600
        # places before abbreviations and links that no place has
        zones = tuple(sorted(every, key=lambda z: (-often.get(z, 0), "/" not in z or z.startswith(("Etc/", "SystemV/")), z)))
    fit = _Fit(span[0], *zone_histories(spark, span[0], span[1], list(zones)), lags)
    rows = seen.filter("week is not null").groupBy("feed", "week", "wrote", "naive").agg(F.count("*").alias("n"), F.max("group").alias("group"), F.max("bare").alias("bare"))
    rows = materialize(rows.filter("wrote is not null or bare"), "evidence")

    def totals(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feed": [f["feed"].iloc[0]], "group": [f["group"].dropna().max() if f["group"].notna().any() else None], "cost": [fit.costs(f)[1].sum(axis=0).astype(np.float32)]})

    of_feed = materialize(rows.groupBy("feed").applyInPandas(totals, "feed string, group string, cost array<float>"), "feeds")

    def likely(prior: np.ndarray):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                p = np.array([fit.shares(np.asarray(c), prior) for c in f["cost"]]).reshape(len(f), -1)
                i, h = np.nonzero(p > 0.001)
                yield pd.DataFrame({"group": f["group"].to_numpy()[i], "h": h, "p": p[i, h]})

        return run

    prior = fit.prior
    for _ in range(3):  # what all feeds show, from what each of them shows by itself
        p = of_feed.mapInPandas(likely(prior), "group string, h int, p double").groupBy("h").agg(F.sum("p").alias("p")).collect()  # a row per history
        share = np.full(len(prior), 1e-6)
        for r in p:
            share[r["h"]] += r["p"]
        prior = share / share.sum()
    by_group = of_feed.mapInPandas(likely(prior), "group string, h int, p double").filter("group is not null").groupBy("group", "h").agg(F.sum("p").alias("p"))
    by_group = by_group.groupBy("group").agg(F.collect_list(F.struct("h", "p")).alias("shares"))
    with_prior = rows.drop("group").join(of_feed.select("feed", "group"), "feed").join(by_group, "group", "left")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        own = prior * PRIOR_FEEDS
        for r in f["shares"].iloc[0] if f["shares"].iloc[0] is not None else ():
            own[r["h"]] += r["p"]
        weeks, cost = fit.costs(f)
        at = fit.path(cost, own / own.sum(), switch_cost)
        wanted = np.isin(weeks, f["week"].to_numpy()[f["bare"].to_numpy(bool)])
        return pd.DataFrame({"feed": f["feed"].iloc[0], "week": weeks[wanted], "zone": np.array(fit.names, object)[at[wanted]]})

    return with_prior.groupBy("feed").applyInPandas(solve, schema)


def estimate_zones(df: DataFrame, value: str, feed: str, arrival: str, zone: str | None = None, group: str | None = None, zones: tuple[str, ...] | None = None, switch_cost: float = VIOLATION) -> DataFrame:
    """zone_estimates() of written values."""
    return zone_estimates(materialize(parsed(df, value, "_w"), "written"), feed, arrival, zone, group, zones, switch_cost)


def with_estimated_zones(df: DataFrame, value: str, zone: str, feed: str, arrival: str, group: str | None = None, zones: tuple[str, ...] | None = None, place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of df whose value can be read, with _w (see parse()) and the zone column filled from the feed's estimated
    history (zone_estimates()) where it is null or blank. Values are read once, into a table in the shared folder. place adds
    or replaces the feed and group columns; it is called only if some row needs an estimate."""
    read = materialize(parsed(df, value, "_w"), "written")
    blank = F.coalesce(F.trim(F.col(zone)), F.lit("")) == ""
    # an instant, a date alone or a written zone needs no estimate
    open_ = blank & F.col("_w.local").isNotNull() & ~F.col("_w.dated") & F.col("_w.offset").isNull() & F.col("_w.zone").isNull()
    if read.filter(open_).isEmpty():
        return read
    read = place(read) if place else read
    found = zone_estimates(read, feed, arrival, zone, group, zones).select(F.col("feed").alias("_feed"), F.col("week").alias("_week"), F.col("zone").alias("_zone"))
    on = (F.coalesce(F.col(feed).cast("string"), F.lit("")) == F.col("_feed")) & (_week(F.col("_w.local")) == F.col("_week"))
    # only rows that lack a zone meet the histories
    filled = read.filter(open_).join(found, on, "left").withColumn(zone, F.col("_zone")).drop("_feed", "_week", "_zone")
    return read.filter(~open_).unionByName(filled)
