import hashlib
import math

import pytest
from pyspark.sql import functions as F

from docketry.functions import forum, geo, hashing, names, stats, text
from docketry.functions.stemmer import stem
from docketry.plans.catalogs import US_FORUMS


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_odds_ratio(spark):
    r = one(spark, stats.odds_ratio(*map(F.lit, (10, 20, 30, 40))), stats.odds_ratio(*map(F.lit, (0, 5, 5, 10))))
    assert r[0]["odds_ratio"] == pytest.approx(0.6667, abs=1e-4) and not r[0]["corrected"]
    assert r[1]["corrected"] and r[1]["odds_ratio"] == pytest.approx(0.5 * 10.5 / (5.5 * 5.5))


def test_correlation_needs_four_pairs_and_variation(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("b", 1, 2), ("b", 1, 3), ("b", 1, 4), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3), ("c", 4, 5), ("c", None, 9)], "g string, x int, y int")
    n, r = stats.pearson(F.col("x"), F.col("y"))
    got = {x["g"]: (x["n"], x["r"]) for x in df.groupBy("g").agg(n.alias("n"), r.alias("r")).collect()}
    assert got["a"] == (2, None) and got["b"] == (4, None) and got["c"][0] == 4 and got["c"][1] == pytest.approx(0.98270763)
    ci = one(spark, stats.fisher_interval(F.lit(1.0), F.lit(9)), stats.fisher_interval(F.lit(0.5), F.lit(103)))
    assert tuple(ci[0]) == (1.0, 1.0) and ci[1]["low"] == pytest.approx(math.tanh(math.atanh(0.5) - stats.Z95 / 10))


def test_contingency_and_proportions(spark):
    df = spark.createDataFrame([(True, True), (True, True), (True, False), (False, True), (False, False), (None, True)], "e boolean, o boolean")
    assert tuple(df.agg(*stats.contingency(F.col("e"), F.col("o"))).first()) == (2, 1, 1, 1)
    z = one(spark, stats.two_proportion_z(*map(F.lit, (10, 100, 10, 100))), stats.two_proportion_z(*map(F.lit, (1, 0, 1, 9))), stats.two_proportion_z(*map(F.lit, (5, 100, 20, 100))), stats.erf(F.lit(1.0)), stats.erf(F.lit(-1.0)))
    assert abs(z[0]["z"]) < 1e-9 and z[0]["p"] == pytest.approx(0.5, abs=1e-6) and tuple(z[1]) == (0.0, 0.5)
    assert z[2]["z"] < 0 and z[2]["p"] < 0.5 and z[3] == pytest.approx(0.8427, abs=1e-4) and z[4] == -z[3]


def test_text_functions(spark):
    r = one(
        spark,
        text.strip_html(F.lit("<p>A &amp; B&nbsp;&#169; &#39;x&#39;</p>\n<b>c</b> &lt;tag&gt;")),
        text.docket_from_text(F.lit("In re X. Nos. 12 and no. ab. Case No.  24-7676. See")),
        text.docket_from_text(F.lit("no docket here")),
        text.slug(F.lit("  Smith v. Jones & Co.  ")),
        text.url_encode(F.lit("a b~c*d/é")),
        text.opinion_number(F.lit("https://x/opinion/11435101/some-slug/")),
        text.opinion_number(F.lit("https://x/opinion/12a/")),
        text.is_excluded(F.lit("d"), F.lit('{"blocked": true}')),
        text.is_excluded(F.lit("Unsealed"), F.lit(None).cast("string")),
        text.is_excluded(F.lit(None).cast("string"), F.lit("{}")),
        text.contains_word(F.lit("State of Indiana,"), F.lit("indiana")),
        text.contains_word(F.lit("Indianapolis"), F.lit("indiana")),
        text.first_date(F.lit("2024-02-30T00")),
        text.mentions_search(F.lit(None).cast("string")),
    )
    assert list(r) == ["A & B © 'x' c <tag>", "24-7676", None, "smith-v-jones-co", "a+b~c%2Ad%2F%C3%A9", "11435101", None, True, True, False, True, False, None, False]


@pytest.mark.parametrize(
    "raw,kind,found",
    [
        ("Smith J.", "individuals", ["Smith"]), ("Mathias, DeBoer, Kenworthy", "individuals", ["Mathias", "DeBoer", "Kenworthy"]), ("Smith, John", "ambiguous", []), ("Per Curiam", "collective", []), ("Form Field 44Cabret, Maria M.", "individuals", ["Maria M. Cabret"]),
        ("Before: Judge Alexander and Lee; Park", "individuals", ["Alexander", "Lee", "Park"]), ("", "collective", []), (None, "collective", []), ("Judge", "collective", []), ("Lee & Smith, John", "ambiguous", []),
    ],
)
def test_parse_officials(spark, raw, kind, found):
    r = one(spark, names.parse_officials(F.lit(raw).cast("string")))[0]
    assert (r["kind"], r["names"]) == (kind, found)


def test_names(spark):
    r = one(spark, names.normalize_name(F.lit("The Honorable Associate Judge Ann  O'Neil, Jr.")), names.normalize_name(F.lit("Smith J.")), names.display_name(F.lit("Chief Judge Mullins, JJ.")), names.name_similarity(F.lit("lee"), F.lit("lea")), names.name_similarity(F.lit(""), F.lit("")), names.normalize_name(F.lit("")), names.fingerprint(F.lit("judge"), F.lit("lee"), F.lit(" CA "), F.lit(None).cast("string"), F.lit("B1")))
    # a title stands in front only while nothing else does
    assert list(r)[1:] == ["smith", "Mullins", pytest.approx(2 / 3), 1.0, "", "judge|lee|ca||b1"] and r[0] == "ann o neil"


@pytest.mark.parametrize(
    "court,cls,name,citation,want",
    [
        ("cand", "FD", "", None, ("CA", "federal_district", "federal_district_id")), ("dcd", "FD", "", None, ("DC", "federal_district", "federal_district_id")), ("canb", "FB", "", None, ("CA", "federal_district", "federal_bankruptcy_id")), ("wva", "S", "Supreme Court of Appeals of West Virginia", None, ("WV", "state_supreme", "state_name")),
        ("scotus", None, "", None, ("US", "scotus", "scotus")), ("ca9", "", "", None, ("US", "federal_circuit", "federal_circuit")), ("navajo", "TRS", "Navajo Nation Supreme Court", None, (None, None, "tribal_sovereign")), ("visuper", "TT", "Superior Court of the Virgin Islands", None, ("VI", "state_trial", "state_name")),
        ("ny", "S", "Court of Appeals", None, ("NY", "state_supreme", "state_id")), ("xx", "SA", "Court", "Ohio Ct. App.", ("OH", "state_appellate", "state_citation")), ("indy", "ST", "Indianapolis Court", None, (None, None, "unmapped")), ("cand", None, "", None, (None, None, "unmapped")), ("x", "MA", "", None, ("US", "federal_circuit", "military_appellate")),
    ],
)
def test_forum(spark, court, cls, name, citation, want):
    s = lambda v: F.lit(v).cast("string")
    assert tuple(one(spark, forum.derive(s(court), s(cls), s(name), s(citation), tuple((c, n) for c, n, _ in US_FORUMS)))[0]) == want


def test_grid(spark):
    lat, lng = F.lit(37.7849), F.lit(-122.4094)
    r = one(spark, geo.ladder(lat, lng), geo.k_ring(geo.cell_for(lat, lng, 7), 1), geo.k_ring(geo.cell_for(lat, lng, 7), 0), geo.boundary(geo.cell_for(lat, lng, 7)), geo.k_ring(F.lit("garbage"), 1), geo.cell_for(F.lit(91.0), lng, 7), geo.cell_for(lat, lng, 7))
    assert [x["res"] for x in r[0]] == [5, 7, 9] and len(set(r[1])) == 7 and r[6] in r[1] and r[2] == [r[6]] and len(r[3]) == 6 and r[4] is None and r[5] is None
    with pytest.raises(ValueError):
        geo.edge_degrees(16)


def test_hashes(spark):
    assert hashing.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    # a published vector: bytes 0, 1, ... 250, 0, ... of this length
    data = bytes(i % 251 for i in range(2049))
    assert hashing.blake3_hex(data) == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"
    r = one(spark, hashing.canonical_json(b=F.lit(1), a=F.lit('x"y'), c=F.lit(None).cast("int"), d=F.lit(True)), hashing.payload_hash(F.lit("{}")), hashing.blake3(F.lit("")))
    assert r[0] == '{"a":"x\\"y","b":1,"c":null,"d":true}' and r[1] == hashlib.sha256(b"{}").hexdigest() and r[2].startswith("af1349b9")


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "adjustment": "adjust", "controller": "control", "at": "at"}
    assert {w: stem(w) for w in pairs} == pairs
