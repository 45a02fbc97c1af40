import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry.operators import authority, cases, evidence, ledger, register, search, simulate, upsert
from docketry.operators.latest import latest_by
from docketry.plans.catalogs import RULES
from docketry.plans.statistics import _distribution
from docketry.rules.compile import flags
from docketry.sources import fixtures, sinks

AS_OF = "2025-06-01"


def test_latest_row_per_key(spark, as_rows):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", [1]), ("a", 2, "z", None), ("b", None, None, None), (None, 9, "q", None)], "k string, at int, v string, extra array<int>")
    assert as_rows(latest_by(df, "k", [F.col("at")], {"v": F.col("v")})) == [("a", "z"), ("b", None)]
    assert latest_by(df.limit(0), "k", [F.col("at")], {"v": F.col("v")}).count() == 0


def test_demo_cases_give_the_known_numbers(spark):
    rows = fixtures.demo_cases(spark).join(fixtures.demo_prosecutors(spark).select("prosecutor_id", "office"), "prosecutor_id")
    got = {r["office"]: (r["n"], r["mean_ratio"]) for r in _distribution(rows, "office").collect()}
    assert got["Demo County DA"] == (2, 2.25)
    context = cases.context(fixtures.demo_cases(spark), fixtures.demo_prosecutors(spark))
    first = context.filter("case_id = 'c0'").first()
    assert first["case"]["plea_sentence_ratio"] == pytest.approx(12 / 36) and first["features"]["trial_pressure"] and first["features"]["due_process"] and first["features"]["equal_protection"]
    assert {(r["case_id"], r["rule"]) for r in flags(context, RULES, ["case_id"]).collect()} >= {("c0", "plea-coercion"), ("c0", "trial-pressure")}


def test_queue_and_placement(spark, as_rows):
    c = spark.createDataFrame([("a", 3, " CAND ", "ca", None), ("b", 1, None, "QQ", "x"), ("c", 2, "zz", "ny", "x")], "case_id string, inserted_at int, source_court_id string, jurisdiction string, court_level string")
    runs = spark.createDataFrame([("b", "failed"), ("c", "ok"), ("c", "failed")], "case_id string, status string")
    assert [r["case_id"] for r in cases.queue(c, runs, 5000).collect()] == ["b", "a"]
    courts = spark.createDataFrame([("cand", "CA", "federal_district", "federal_district_id")], "court_id string, jurisdiction string, level string, method string")
    got = {r["case_id"]: (r["forum"], r["forum_level"], r["forum_method"]) for r in cases.placed(c, courts, ("CA", "NY")).collect()}
    assert got == {"a": ("CA", "federal_district", "federal_district_id"), "b": ("unknown", "x", "unknown"), "c": ("NY", "x", "claimed")}


def test_evidence_and_gaps(spark, as_rows):
    _, opinions = fixtures.fixture_poll(spark)
    texts = opinions.withColumn("case_id", F.lit("c")).unionByName(spark.createDataFrame([("d", None), ("e", ""), ("f", "x " * 200_000 + "CHAIN of custody, chain of  Custody")], "case_id string, full_text string"), allowMissingColumns=True)
    items = evidence.expected_items(texts, ["case_id"], "full_text")
    got = as_rows(items)
    assert {t for c, t, _ in got if c == "c"} >= {"witness_interview", "bodycam", "lab_report", "chain_of_custody"}
    assert [r for r in got if r[0] == "f"] == [("f", "chain_of_custody", "Chain-of-custody documentation")] and not [r for r in got if r[0] in "de"]
    want = spark.createDataFrame([("c", "bodycam", "Body-worn camera footage"), ("c", "lab_report", "DNA"), ("c", "911_call", None), ("d", "bodycam", "X")], "case_id string, item_type string, description string")
    have = spark.createDataFrame([("c", "bodycam", "footage"), ("c", "chain", "DNA"), ("c", "911_call", "call"), ("d", "bodycam", None), ("c", "lab_report", "full dna report of 2 May")], "case_id string, item_type string, description string")
    assert as_rows(evidence.gaps(want, have).select("case_id", "item_type")) == [("c", "911_call"), ("d", "bodycam")]
    assert evidence.gaps(want, have.limit(0)).count() == 4


def test_search(spark):
    docs = [(1, "The prosecutor withheld the chain of custody."), (2, "Custody of the chain; prosecutors withholding."), (3, "A jury was chosen by the prosecutor"), (4, None), (5, ""), (6, "suppress suppressed suppression"), (6, "suppress")]
    df = spark.createDataFrame(docs, "id int, text string")
    postings = search.index(df, "id", "text")
    find = lambda q: [r["id"] for r in search.search(spark, postings, q, 7, 5.0).collect()]
    assert set(find("custody prosecutors")) == {1, 2} and find('"chain of custody"') == [1] and set(find("prosecutor -jury")) == {1, 2}
    assert set(find("jury OR suppressing")) == {3, 6} and find("the of") == [] and find("nothing here") == []


def test_upserts(spark, as_rows):
    s = "k string, new string, old string, rep string"
    held = spark.createDataFrame([("a", "1", "1", "1"), ("b", "2", None, "2"), ("z", None, None, None)], s)
    new = spark.createDataFrame([("a", None, "9", None), ("b", "8", "8", "8"), ("c", "7", None, "7"), ("c", "6", None, "6"), ("b", "8", "8", "8")], s)
    got = as_rows(upsert.upsert(held, new, ["k"], {"new": "new", "old": "old", "rep": "replace"}))
    assert got == [("a", "1", "1", None), ("b", "8", "8", "8"), ("c", "7", None, "7"), ("z", None, None, None)]
    assert as_rows(upsert.inserted(held, new, ["k"]).select("k")) == [("c",)]
    o = spark.createDataFrame([("1", "r", "full"), ("2", "r", "snippet"), ("3", "q", "summary"), ("4", None, "snippet"), ("5", "r", None)], "id string, source_ref string, text_completeness string")
    assert as_rows(upsert.without_superseded(o).select("id")) == [("1",), ("3",), ("4",)]


def test_ledger(spark):
    e = spark.createDataFrame([(i, "kind", f'{{"case_id":"c{i % 3}"}}', 1_700_000_000_000_000 + i) for i in range(50)], "n int, event_type string, payload string, created_micros bigint").repartition(4)
    chain = ledger.append(e, ["n"]).cache()
    assert tuple(ledger.verify(chain).first()) == (50, True, None) and tuple(ledger.verify(chain, slice_rows=7).first()) == (50, True, None)
    for change, bad in ((F.when(F.col("seq") == 20, "{}").otherwise(F.col("payload")).alias("payload"), 20), (F.when(F.col("seq") == 8, F.lit("x")).otherwise(F.col("prev_hash")).alias("prev_hash"), 8)):
        cols = [change if c == change._jc.toString().split(" AS ")[-1] or f"AS {c}" in str(change) else F.col(c) for c in chain.columns]
        assert ledger.verify(chain.select(*cols), slice_rows=7).first()["first_bad_seq"] == bad
    assert ledger.verify(chain.filter("seq != 15"), slice_rows=7).first()["first_bad_seq"] == 16
    assert tuple(ledger.verify(chain.limit(0)).first()) == (0, True, None)
    more = ledger.append(e.limit(2), ["n"], 50, chain.orderBy(F.desc("seq")).first()["entry_hash"])
    assert ledger.verify(chain.unionByName(more)).first()["valid"]
    assert [r["seq"] for r in ledger.entries_for(chain, "case_id", "c0").limit(3).collect()] == [1, 4, 7]


def test_scores_register_and_gates(spark, as_rows):
    actors = spark.createDataFrame([("p", "P1", "A"), ("j", None, "B"), ("q", "P2", "C")], "actor_id string, prosecutor_id string, display_name string")
    f = spark.createDataFrame([("f1", None, "P1", "brady", dt.date(2024, 11, 2), "substantiated"), ("f2", "j", "P1", "giglio", None, "pending"), ("f3", None, "P2", "brady", dt.date(2010, 1, 1), "substantiated"), ("f4", None, None, "x", None, "substantiated")], "finding_id string, actor_id string, prosecutor_id string, finding_type string, finding_date date, review_status string")
    none = spark.createDataFrame([], "actor_id string, prosecutor_id string, label string, review_status string")
    assert {r["actor_id"]: r["score"] for r in register.scores(actors, f, none, AS_OF).collect()} == {"p": 28.0, "j": 0.0, "q": 18.0}
    r = spark.range(1).select(*[register.points(*map(F.lit, x)).alias(str(i)) for i, x in enumerate([(1, 0, 1, 1), (0, 0, 0, 0), (99, 99, 99, 99)])]).first()
    assert tuple(r) == (28.0, 0.0, 100.0)
    holds = spark.createDataFrame([("q", False), ("p", True)], "actor_id string, approved boolean")
    assert as_rows(register.publishable(actors, f, holds).select("actor_id")) == [("p",)]
    assert as_rows(register.publishable(actors, f, holds.limit(0)).select("actor_id")) == [("p",), ("q",)]
    assert register.wall(actors, f, holds).first()["n_findings"] > 0 and register.wall_records(actors, f, holds).first()["records"][0]["finding_id"] == "f1"


def test_simulation(spark):
    run = lambda p, s, seed=42: simulate.distribution(simulate.trials(spark, p, s, 3000, seed)).first()
    base = run(simulate.Priors(), simulate.Strategy())
    assert base == run(simulate.Priors(), simulate.Strategy()) and base != run(simulate.Priors(), simulate.Strategy(), 7)
    assert base["p_dismissal"] + base["p_plea"] + base["p_acquittal"] + base["p_conviction"] == pytest.approx(1.0)
    assert run(simulate.Priors(), simulate.Strategy(suppression_bonus=0.3))["p_dismissal"] > base["p_dismissal"]
    assert run(simulate.Priors(), simulate.Strategy(acquittal_bonus=1.0))["p_conviction"] == 0
    assert simulate.distribution(simulate.trials(spark, simulate.Priors(), simulate.Strategy(), 0, 1)).first()["expected_months"] == 0
    with pytest.raises(ValueError):
        simulate.trials(spark, simulate.Priors(evidence_strength=1.1), simulate.Strategy(), 1, 1)


def test_authority(spark):
    clauses = spark.createDataFrame([("04.search", "incorporated"), ("14.dp", "not_applicable"), ("05.grand_jury", "not_incorporated"), ("07.x", "incorporated")], "clause_id string, incorporation string")
    forums = spark.createDataFrame([("TX", "CA5", False), ("CA", "CA9", False), ("US", "CAFC", True)], "code string, circuit string, is_federal boolean")
    h = spark.createDataFrame(
        [("wolf", ["04.search"], "scotus", None, 1949, "overruled", "mapp", 0), ("mapp", ["04.search"], "scotus", None, 1961, "binding", None, 1), ("carpenter", ["04.search"], "scotus", None, 2018, "binding", None, 2), ("c5", ["07.x"], "circuit", "CA5", 2000, "binding", None, 3)],
        "holding_id string, clause_ids array<string>, court_kind string, court_id string, year int, authority string, superseded_by string, ordinal int",
    )
    splits = spark.createDataFrame([("14.dp", ["CA9"], ["CA5"])], "clause_id string, side_a array<string>, side_b array<string>")
    asked = spark.createDataFrame([("04.search", "TX", "superior"), ("14.dp", "CA", None), ("05.grand_jury", "CA", "superior"), ("05.grand_jury", "US", "federal_district"), ("07.x", "TX", "x"), ("07.x", "CA", "x"), ("nope", "CA", "x")], "clause_id string, code string, court_level string")
    got = {(r["clause_id"], r["code"]): r for r in authority.resolve(asked, clauses, forums, h, splits).collect()}
    assert got[("04.search", "TX")]["binding"] == "carpenter" and got[("04.search", "TX")]["status"] == "controlling"
    assert got[("14.dp", "CA")]["status"] == "unsettled" and got[("14.dp", "CA")]["forum_side"] == "a"
    assert got[("05.grand_jury", "CA")]["status"] == "inapplicable" and got[("05.grand_jury", "US")]["status"] == "no_holding"
    assert got[("07.x", "TX")]["status"] == "circuit_binding" and got[("07.x", "CA")]["status"] == "no_holding" and len(got) == 6
    early = authority.resolve(asked, clauses, forums, h, splits, as_of=1970)
    assert early.filter("clause_id = '04.search'").first()["binding"] == "mapp"
    assert authority.broken_references(h, clauses, splits).count() == 0
    assert authority.broken_references(h.filter("holding_id != 'mapp'"), clauses, splits).first()["refers_to"] == "mapp"


def test_reports_and_public_views(spark, tmp_path):
    df = spark.createDataFrame([("Office", 3, ["a", "b"]), ("None", None, None)], "t string, n int, items array<string>")
    texts = [r[0] for r in df.select(sinks.report(F.col("t"), {"findings": F.col("n")}, F.col("items"))).collect()]
    assert texts[0].startswith("# Office\n\n- **findings:** 3\n\n* a\n* b\n\n>") and "unknown" in texts[1]
    sinks.public_view("wall")(lambda s: s.range(2))
    sinks.export("wall", str(tmp_path / "w"), spark)
    assert spark.read.json(str(tmp_path / "w")).count() == 2
    with pytest.raises(PermissionError):
        sinks.export("pipeline_runs", str(tmp_path / "x"), spark)
    with pytest.raises(ValueError):
        sinks.public_view("pipeline_runs")
    assert df.select(sinks.escape_html(F.lit("<a href='x'>&\"")).alias("h")).first()["h"] == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"


def test_runs_of_cases(spark, as_rows):
    from docketry.operators import pipeline

    c = fixtures.demo_cases(spark).withColumn("source_court_id", F.lit("x"))
    actors = spark.createDataFrame([("s", "judge", "CA", "Smith", None), ("n", "judge", "CA", "Hon. Nguyen", None), ("p", "prosecutor", "CA", "Demo Prosecutor", "p1")], "actor_id string, role string, jurisdiction string, display_name string, prosecutor_id string")
    links, queue = pipeline.actor_links(c.unionByName(c.limit(1).withColumn("case_id", F.lit("q")).withColumn("judge", F.lit("Smith, John"))), actors)
    assert as_rows(links.filter("role_in_case = 'judge'").select("case_id", "actor_id")) == [("c0", "s"), ("c1", "s"), ("c3", "n")]
    assert as_rows(links.filter("role_in_case = 'prosecutor'").select("case_id")) == [("c0",), ("c1",), ("c2",), ("q",)]
    assert as_rows(queue.select("case_id", "kind")) == [("q", "ambiguous")]
    _, opinions = fixtures.fixture_poll(spark)
    disclosed = spark.createDataFrame([("c0", "bodycam", "footage")], "case_id string, item_type string, description string")
    scores = spark.createDataFrame([("s", 28.0), ("p", 12.0)], "actor_id string, score double")
    runs = pipeline.run_cases(cases.context(c, fixtures.demo_prosecutors(spark)), c.select("case_id", F.lit("CA").alias("forum")), opinions.withColumn("case_id", F.lit("c0")), disclosed, links, scores, RULES)
    got = {r["case_id"]: r for r in runs.collect()}
    assert got["c0"]["status"] == "ok" and got["c0"]["n_gaps"] == got["c0"]["n_leads"] - 1 and got["c0"]["best_score"] == 28.0 and got["c0"]["n_flags"] == 3
    assert got["c3"]["status"] == "partial" and [s["status"] for s in got["c3"]["stages"]] == ["ok", "ok", "skipped", "ok", "ok", "skipped"]
    total = pipeline.summary(runs).first()
    assert total["by_status"] == {"ok": 1, "partial": 3} and total["runs"] == 4
    assert pipeline.public_actors(fixtures.demo_prosecutors(spark), c).count() == 5
    again = runs.withColumn("at", F.lit(1)).unionByName(runs.withColumn("at", F.lit(2)))
    assert pipeline.latest_runs(again, "at").filter("at = 2").count() == 4


def test_screen_reads_all_opinions_and_resolves_clauses(spark):
    from docketry.operators import pipeline

    c = fixtures.demo_cases(spark).unionByName(fixtures.demo_cases(spark).limit(1).withColumn("case_id", F.lit("lost")))
    placed = c.select("case_id", F.when(F.col("case_id") == "lost", "unknown").otherwise("CA").alias("forum"))
    opinions = spark.createDataFrame([("c1", "Nothing of note."), ("c1", "A motion to SUPPRESS was heard."), ("c1", None), ("c2", "The log was never disclosed."), ("lost", "a warrant")], "case_id string, full_text string")
    contexts = cases.context(c, fixtures.demo_prosecutors(spark))
    due, search_, pressure, equal = ["amend.05.due_process", "amend.14.due_process"], ["amend.04.search_seizure"], ["amend.06.counsel", "amend.06.jury"], ["amend.14.equal_protection"]
    clauses = lambda rows: {r["case_id"]: sorted(h["clause_id"] for h in r["screen"]) for r in rows}
    got = pipeline.screen(contexts, placed, opinions).collect()
    assert clauses(got) == {"c0": sorted(due + pressure + equal), "c1": sorted(search_ + equal), "c2": due, "c3": sorted(due + equal), "lost": []}
    assert {r["case_id"]: r["screened"] for r in got} == {"c0": True, "c1": True, "c2": True, "c3": True, "lost": False}
    # gaps of an earlier run are a lead; clauses that don't apply to a state are dropped, a split makes authority unsettled
    plain = pipeline.no_holdings(placed)
    kept = plain.clauses.withColumn("incorporation", F.when(F.col("clause_id") == "amend.05.due_process", "not_incorporated").otherwise(F.col("incorporation")))
    splits = spark.createDataFrame([("amend.04.search_seizure", ["CA4"], ["CA5"])], "clause_id string, side_a array<string>, side_b array<string>")
    given = pipeline.Catalogs(kept, plain.forums, plain.holdings, splits)
    again = pipeline.screen(contexts, placed, opinions, given, spark.createDataFrame([("c1", 2), ("c3", 0)], "case_id string, gaps_found int")).collect()
    assert clauses(again)["c1"] == sorted(search_ + equal + due[1:]) and clauses(again)["c2"] == due[1:]
    assert {r["case_id"]: r["screen_authority"] for r in again} == {"c0": "controlling", "c1": "unsettled", "c2": "controlling", "c3": "controlling", "lost": None}
    # the run of a case counts clauses
    none = spark.createDataFrame([], "case_id string, actor_id string, role_in_case string")
    runs = pipeline.run_cases(contexts, placed, opinions, spark.createDataFrame([], "case_id string, item_type string, description string"), none, spark.createDataFrame([], "actor_id string, score double"), RULES)
    assert {r["case_id"]: r["screen_hits"] for r in runs.collect()} == {"c0": 5, "c1": 2, "c2": 2, "c3": 3, "lost": 0}


def test_the_last_delivered_row_wins(spark, as_rows):
    held = spark.createDataFrame([("a", "z", "z")], "k string, new string, rep string")
    incoming = spark.createDataFrame([("a", "m", None, 1), ("a", None, "b", 3), ("a", "x", "y", 2), ("b", "q", "q", 1), ("b", "q", "q", 1)], "k string, new string, rep string, n int")
    rules = {"new": "new", "rep": "replace"}
    assert as_rows(upsert.upsert(held, incoming, ["k"], rules, "n")) == [("a", "z", "b"), ("b", "q", "q")]
    assert as_rows(upsert.upsert(held, incoming.drop("n"), ["k"], rules)) == [("a", "x", "y"), ("b", "q", "q")]


def test_lengths_of_a_search_are_those_of_its_postings(spark):
    docs = spark.createDataFrame([(1, "one-two three, four's"), (2, "one"), (3, None), (4, "")], "id int, text string")
    postings = search.stored(search.index(docs, "id", "text"))
    assert search.corpus(postings) == (2, 3.0)  # five words and one; null and empty texts are no texts


def test_search_by_fields(spark):
    docs = spark.createDataFrame([(1, "the court granted it", "24-100"), (2, "nothing", "X 24-1009"), (3, "granted 24-100", None), (4, None, "24-100")], "id int, text string, docket string")
    postings = search.index(docs, "id", "text")
    find = lambda q: {(r["id"], r["matched_on"]) for r in search.search_records(spark, postings, docs.select("id", "docket"), ("docket",), q, 3, 3.0).collect()}
    assert find("24-100") == {(1, "docket"), (2, "docket"), (3, "text"), (4, "docket")} and find("granted") == {(1, "text"), (3, "text")} and find(" ") == set()


def test_records_of_a_card_are_cut_into_pages(spark):
    import datetime as dt

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=(i * 17) % 100) if i % 7 else None for i in range(60)]
    f = spark.createDataFrame([(f"f{i:02d}", "a", None, "brady", day, "substantiated") for i, day in enumerate(days)] + [("x", "a", None, "brady", None, "pending")], "finding_id string, actor_id string, prosecutor_id string, finding_type string, finding_date date, review_status string")
    actors, holds = spark.createDataFrame([("a", None, "N"), ("b", None, "M")], "actor_id string, prosecutor_id string, display_name string"), spark.createDataFrame([], "actor_id string, approved boolean")
    pages = {r["page"]: [x["finding_id"] for x in r["records"]] for r in register.wall_records(actors, f, holds, 25).collect()}
    want = [f"f{i:02d}" for i in sorted(range(60), key=lambda i: (days[i] is None, days[i] or days[1], i))]
    assert [len(pages[k]) for k in sorted(pages)] == [25, 25, 10] and sum((pages[k] for k in sorted(pages)), []) == want


def test_every_code_point_is_decoded(spark):
    from docketry.functions.text import decode_entities

    df = spark.createDataFrame([("&#128512;|&#65279;|&#55296;|&#1114112;|&#65;&amp;lt;",)], "t string")
    assert df.select(decode_entities(F.col("t")).alias("d")).first()["d"] == "\U0001f600|\ufeff|&#55296;|&#1114112;|A&lt;"


def test_scratch_tables_are_removed(spark):
    import os

    from docketry.session import materialize, scratch, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert materialize(spark.range(3), "gone").count() == 3 and set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before
