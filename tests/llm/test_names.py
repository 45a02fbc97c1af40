import pytest
from pyspark.sql import functions as F

from docketry.llm import name_links as L
from docketry.llm import names as N


@pytest.mark.parametrize(
    "text,form",
    [
        ("Dulesby, Orsolya V.", "person|dulesby|orsolya v||"), ("Hon. ORSOLYA V. DULESBY", "person|dulesby|orsolya v||"), ("Nexson, T.G.", "person|nexson|t g||"), ("Stinneckick, RW", "person|stinneckick|r w||"), ("Graxard J.", "person|graxard|||"), ("Graxard, J.", "person|graxard|||"),
        ("C. F. Treareltin, Sr.", "person|treareltin|c f|sr|"), ("Nexs0n", "person|nexson|||"), ("Per Curiam", "nobody||||"), ("N/A", "nobody||||"), ("", "nobody||||"), (None, "nobody||||"), ("-", "nobody||||"), ("Judge", "nobody||||"), ("Yaltman Co. Crime Lab", "body||||county crime laboratory yaltman"),
        ("Crime Laboratory of Yaltman County", "body||||county crime laboratory yaltman"), ("Haiskuxard County Sheriff's Office", "body||||county haiskuxard sheriff"), ("X", "nobody||||"), ("a, b, c", "nobody||||"),
    ],
)
def test_reading(text, form):
    assert N.read(text).form == form and N.from_form(form).form == form


def test_likeness():
    like = lambda a, b: N.likeness(N.read(a), N.read(b), lambda t: 1.0 if t in N.BODY_WORDS.values() else 5.0)
    same = [("Orsolya Dulesby", "Dulesby, O."), ("Bob Yainnixez", "Robert C. Yainnixez"), ("Dulesby", "Judge Orsolya V. Dulesby"), ("Wernman, Ambrose", "Ambrose Wemman"), ("Ksetrel Tralliñ", "Tralllin, Kestrel P."), ("T. Rolathara", "Anthony Rolathara"), ("Yaltamn Co. Crime Lab", "Crime Laboratory of Yaltman County")]
    other = [("Yolanda Jirnesez", "Nathaniel Jirnesez"), ("Ursula A. Trundernman", "Ursula D. Trundernman"), ("Yaltman County Crime Laboratory", "Yaltman County Public Defender"), ("John Smith, Jr.", "John Smith, Sr."), ("Per Curiam", "Per Curiam"), ("Yaltman County Crime Lab", "Breathosby County Crime Lab")]
    assert all(like(a, b) >= L.LINK for a, b in same) and all(like(a, b) < L.LINK for a, b in other)
    import itertools

    few = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)] + ["abcd", "abdc", "acbd", "bacd", "abcde"]
    assert all(N.within_one(a, b) == (N.edits(a, b) <= 1) for a in few for b in few)
    assert N.edits("abcd", "abdc") == 1 and N.edits("", "ab") == 2 and N.edits("vockez", "vckez") == 1


SCHEMA = "actor_id string, role string, jurisdiction string, display_name string, number string, scope int"
ACTORS = [
    ("a1", "judge", "X", "Orsolya V. Dulesby", "7", 0), ("a2", "judge", "X", "DULESBY, ORSOLYA", None, 0), ("a3", "judge", "X", "Hon. Dulseby", None, 0), ("a4", "judge", "Y", "Orsolya V. Dulesby", None, 0), ("a5", "officer", "X", "Orsolya V. Dulesby", None, 0),
    ("b1", "judge", "X", "Nestor Bathirvson", "1", 0), ("b2", "judge", "X", "Nadia Bathirvson", "2", 0), ("b3", "judge", "X", "Bathirvson", None, 0), ("c1", "judge", "X", "K. Zzyzx", "9", 0), ("c2", "judge", "X", "Quite Another", "9", 0), ("d1", "judge", "X", None, None, 0), ("d2", "judge", None, "Per Curiam", None, 0), ("d3", "judge", "X", "", None, 0),
]


def link(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return L.entities(df, "actor_id", [F.col("role"), F.col("jurisdiction")], F.col("display_name"), [F.col("number")])


def test_entities(spark):
    rows, _ = link(spark, ACTORS)
    got = {r["id"]: r["entity"] for r in rows.collect()}
    assert got["a1"] == got["a2"] == got["a3"] == "a1" and got["a4"] == "a4" and got["a5"] == "a5"
    assert got["b1"] == "b1" and got["b2"] == "b2" and got["b3"] == "b3" and got["c1"] == got["c2"] == "c1" and (got["d1"], got["d2"], got["d3"]) == ("d1", "d2", "d3")
    assert len(got) == len(ACTORS)


def test_match(spark):
    _, forms = link(spark, ACTORS)
    texts = ["dulesby, o. v.", "Judge Dulesby", "Dulezby", "N. Bathirvson", "Bathirvson", "Nestor Bathirvson", "Orsolya B. Dulesby", "Someone Else", "Per Curiam", "Dulesby County Sheriff's Office", None, "", "dulesby, o. v."]
    q = spark.createDataFrame([(t, "X") for t in texts] + [("Judge Dulesby", "Q"), ("Judge Dulesby", None)], "judge string, jurisdiction string")
    found = L.match(L.spellings(q, [F.lit("judge"), F.col("jurisdiction")], F.col("judge")), forms)
    assert {(r["text"], r["entity"]) for r in found.collect()} == {("dulesby, o. v.", "a1"), ("Judge Dulesby", "a1"), ("Dulezby", "a1"), ("Nestor Bathirvson", "b1")}


def test_empty(spark):
    rows, forms = link(spark, [])
    assert rows.count() == 0 and forms.count() == 0


def test_prefixes_lose_no_pair(spark):
    """Every pair of surnames as close as SURNAME_CLOSE asks for is a candidate."""
    import random

    r = random.Random(3)
    words = {"".join(r.choice("abcdrn") for _ in range(r.randrange(2, 14))) for _ in range(60)}
    for w in sorted(words):
        for _ in range(6):
            t = list(w)
            for _ in range(r.randrange(1, 4)):
                k = r.randrange(len(t))
                edit = r.choice(["swap", "drop", "add", "change"])
                if edit == "swap" and k + 1 < len(t):
                    t[k], t[k + 1] = t[k + 1], t[k]
                elif edit == "drop" and len(t) > 2:
                    del t[k]
                elif edit == "add":
                    t.insert(k, r.choice("abcdrn"))
                else:
                    t[k] = r.choice("abcdrn")
            words.add("".join(t))
    names = {f"person|{w}|||": w for w in words}
    forms = spark.createDataFrame([("s", f, N.heads(N.from_form(f))) for f in names], "scope string, form string, heads array<string>")
    got = {(x["form_a"], x["form_b"]) for x in L.candidates(forms, forms, L.gram_order(forms)).collect()}
    need = {(a, b) for a in names for b in names if N.closeness(names[a], names[b]) >= N.SURNAME_CLOSE}
    assert need <= got and len(need) > len(names)


def test_other_orders_and_scripts(spark):
    like = lambda a, b: N.likeness(N.read(a), N.read(b), lambda t: 5.0)
    same = [("Smith John", "John Smith"), ("Smith John A.", "John A. Smith"), ("Van der Berg, Jan", "Jan van der Berg"), ("José García López", "Jose Garcia"), ("Иванов Пётр", "Пётр Иванов"), ("Παπαδόπουλος, Νίκος", "Νίκος Παπαδόπουλος"), ("王伟", "王伟")]
    assert all(like(a, b) >= L.LINK and not N.contradict(N.read(a), N.read(b)) for a, b in same)
    other = [("Smith John", "Brown Smith"), ("Иванов Пётр", "Иванов Сергей"), ("王伟", "李娜"), ("John Allen Smith", "Mary Allen")]
    assert all(like(a, b) < L.LINK for a, b in other)
    rows = [(f"r{i}", "judge", "X", t, None, 0) for i, t in enumerate(["Иванов, Пётр", "Пётр Иванов", "John Smith", "Smith John", "王伟", "王 伟", "李娜"])]
    got = {r["id"]: r["entity"] for r in link(spark, rows)[0].collect()}
    assert got["r0"] == got["r1"] == "r0" and got["r2"] == got["r3"] == "r2" and len({got["r4"], got["r6"], "r0"}) == 3


def test_equal_names_with_different_numbers_are_two(spark):
    rows = [("a", "judge", "X", "J. Quill", "1", 0), ("b", "judge", "X", "J. Quill", "2", 0), ("c", "judge", "X", "J. Quill", "2", 0), ("d", "judge", "X", "Jay Quill", "1", 0), ("e", "judge", "X", "J. Quill", None, 0)]
    ids, forms = link(spark, rows)
    got = {r["id"]: r["entity"] for r in ids.collect()}
    assert got["a"] == got["d"] == "a" and got["b"] == got["c"] == "b" and got["e"] == "e"
    q = L.spellings(spark.createDataFrame([("J. Quill", "X"), ("Jay Quill", "X")], "judge string, jurisdiction string"), [F.lit("judge"), F.col("jurisdiction")], F.col("judge"))
    assert {(r["text"], r["entity"]) for r in L.match(q, forms).collect()} == {("Jay Quill", "a")}


def test_nicknames_are_a_parameter():
    given = N.Given({"tolya": ("anatoly",)})
    read = lambda t: N.read(t)
    weight = lambda t: 1.0
    assert N.likeness(read("Tolya Brin"), read("Anatoly Brin"), weight, given) >= L.LINK > N.likeness(read("Tolya Brin"), read("Anatoly Brin"), weight)
    assert N.likeness(read("Bob Brin"), read("Robert Brin"), weight, N.Given({})) < L.LINK
