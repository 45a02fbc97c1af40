import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import hashing, text
from docketry.operators import authority, cells, lists, merge, pipeline, states
from docketry.rules import registry
from docketry.rules.language import RuleError
from docketry.sources import feeds, sinks
from docketry.streaming import cycle


def test_optional_filters_add_no_predicate(spark, as_rows):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x")], "k string, v string")
    assert as_rows(lists.filtered(df, k=None, v="x")) == [("a", "x"), (None, "x")] and as_rows(lists.filtered(df, k=["a", "b"], v=None)) == [("a", "x"), ("b", "y")]
    assert lists.filtered(df, k=None, v=None) is df and lists.containing(df, " ", "k") is df
    assert as_rows(lists.containing(df, "B Y", "k", "v")) == [("b", "y")]


def test_kinds_lookups_and_checks(spark, as_rows):
    df = spark.createDataFrame([("amend.01", "amendment"), ("art.1", "article")], "code string, kind string")
    assert [r["code"] for r in lists.by_kind(df, "Article").collect()] == ["art.1"] and lists.by_kind(df, "other").count() == 2 and lists.by_kind(df, None).count() == 2
    assert [r["code"] for r in lists.by_kind(df, "rights", {"rights": ["amend.01"]}).collect()] == ["amend.01"]
    forums = spark.createDataFrame([("IN", "Indiana"), ("OR", "Oregon"), ("ME", "or")], "code string, name string")
    asked = spark.createDataFrame([(" indiana ", 1), ("in", 2), ("OR", 3), ("?", 4), (None, 5)], "t string, code int")
    assert sorted((r["t"] or "", r["code"]) for r in lists.lookup(asked, "t", forums).collect()) == [("", None), (" indiana ", "IN"), ("?", None), ("OR", "OR"), ("in", "IN")]
    assert lists.checked(df, "kind", ("amendment", "article")).count() == 2
    with pytest.raises(Exception, match="unknown kind: article"):
        lists.checked(df, "kind", ("amendment",)).collect()
    names = spark.createDataFrame([("A; B", None), ("A, B, C", None), ("A, B, C", "7"), ("Form Field 2", None), ("A, B", None), (None, None)], "display_name string, n string")
    assert as_rows(lists.without_panels(names, F.col("n").isNotNull())) == [("A, B", None), ("A, B, C", "7"), (None, None)]


def test_cells_count_a_case_once(spark):
    df = spark.createDataFrame([("c1", 10.0, 10.0, 10.0, 10.0), ("c2", 10.0, 10.0, 50.0, 50.0), ("c3", None, None, 10.0, 10.0), ("c4", 91.0, 0.0, None, None)], "case_id string, a double, b double, c double, d double")
    t = cells.touches(df, [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))], 4)
    assert sorted(t.groupBy("cell").count().toPandas()["count"]) == [1, 3] and t.count() == 4


def test_transitions_and_holds(spark, as_rows):
    rows = spark.createDataFrame([("a", "pending"), ("b", "done"), ("c", "pending"), ("d", "pending")], "id string, state string")
    asked = spark.createDataFrame([("a", "no", 1), ("a", "done", 2), ("b", "no", 1), ("c", "odd", 1), ("z", "done", 1), (None, "done", 1), ("d", "pending", 1)], "id string, to string, at int")
    changed, refused = states.transition(rows, asked, "id", "state", {"pending": ("done", "no")})
    assert as_rows(changed) == [("a", "done"), ("b", "done"), ("c", "pending"), ("d", "pending")]
    assert as_rows(refused) == [("b", "no", "not allowed"), ("c", "odd", "not allowed"), ("z", "done", "missing")]
    holds = spark.createDataFrame([("a", False), ("k", True)], "actor_id string, approved boolean")
    merged, no = states.hold(holds, spark.createDataFrame([("a", True, 1), ("b", True, 1), ("k", True, 1), ("k", False, 2)], "actor_id string, approved boolean, at int"), spark.createDataFrame([("a",), ("a",)], "actor_id string"))
    assert as_rows(merged) == [("a", True), ("k", False)] and as_rows(no) == [("b", "no grounds")]


def test_merging_takes_children_along(spark, as_rows):
    rows = spark.createDataFrame([("a", "k1", 1), ("b", "k1", 0), ("c", "k2", 0), ("d", None, 0), ("e", None, 0)], "id string, key string, rank int")
    merged = merge.survivors(rows, "id", F.col("key"), [F.col("rank")])
    assert as_rows(merged) == [("a", "b"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "e")]
    links = spark.createDataFrame([("a", "x", "of a"), ("b", "x", "of b"), ("a", "y", "of a"), ("q", "x", "of q"), (None, "x", "none")], "id string, case_id string, note string")
    assert as_rows(merge.repoint(links, merged, "id")) == [("b", "x", "of a"), ("b", "x", "of b"), ("b", "y", "of a"), ("q", "x", "of q"), (None, "x", "none")]
    assert ("b", "x", "of b") in as_rows(merge.repoint(links, merged, "id", ["id", "case_id"])) and merge.repoint(links, merged, "id", ["id", "case_id"]).count() == 4
    holds = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, approved boolean")
    assert as_rows(merge.merged_holds(holds, merged, "id")) == [("b", True), ("c", False)] and as_rows(merge.without_merged(rows, merged, "id").select("id")) == [("b",), ("c",), ("d",), ("e",)]


def test_a_cycle_goes_on_after_errors():
    def bad():
        raise OSError("down")

    asked = []
    out = cycle.run_cycle({"a": lambda: (2, 5), "b": bad, "c": lambda: (1, 1)}, lambda: 3, lambda limit: asked.append(limit) or 7, limit=9_999, declare=lambda: 3)
    assert out.new == {"a": 2, "c": 1} and out.errors == {"b": "down"} and (out.declared, out.placed, out.cases, asked) == (3, 3, 7, [2000])
    assert out.totals == {"feeds": 2, "failed": 1, "new": 3, "seen": 6, "cases": 7}
    assert cycle.run_cycle({}, bad, lambda limit: 1).errors == {"place": "down"}


def test_the_loop_outlives_a_failing_cycle():
    seen, waits, left = [], [], iter([cycle.Report(), OSError("x"), cycle.Report(), cycle.Report()])

    def one():
        r = next(left)
        if isinstance(r, Exception):
            raise r
        return r

    assert cycle.loop(one, None, seen.append) == 1
    assert cycle.loop(one, 900, seen.append, stop=lambda: len(seen) >= 4, wait=waits.append) == 3 and waits == [900, 900] and isinstance(seen[1], OSError)


def test_rule_registry(spark):
    held = spark.createDataFrame([], registry.SCHEMA)
    good = 'when case.sentence_months >= 120 then flag "Heavy sentence"'
    held = registry.added(held, "heavy", good, dt.datetime(2024, 1, 1))
    with pytest.raises(RuleError):
        registry.added(held, "bad", "when then", dt.datetime(2024, 1, 2))
    with pytest.raises(ValueError):
        registry.added(held, "heavy", good, dt.datetime(2024, 1, 2))
    assert registry.as_rules(registry.added(held, "second", good, dt.datetime(2024, 1, 3))) == {"second": good, "heavy": good}


def test_flags_get_an_actor_and_queues_grow_once(spark, as_rows):
    links = spark.createDataFrame([("c1", "j1", "judge"), ("c1", "p2", "prosecutor"), ("c1", "p1", "prosecutor"), ("c2", "j9", "judge")], "case_id string, actor_id string, role_in_case string")
    raised = spark.createDataFrame([("c1", None), ("c2", None), ("c3", None), ("c1", "own")], "case_id string, actor_id string")
    assert as_rows(pipeline.with_actors(raised, links)) == [("c1", "own"), ("c1", "p1"), ("c2", "j9"), ("c3", None)]
    queue = spark.createDataFrame([("c1", "x"), ("c1", "x"), ("c2", "y")], "case_id string, raw string")
    assert as_rows(pipeline.new_unresolved(queue.limit(1), queue)) == [("c2", "y")]


def test_hits_courts_catalogs_and_values(spark, tmp_path, as_rows):
    hits = [{"docketNumber": "1", "caseName": "A", "score": 1.0, "blocked": True, "opinions": [{"id": 1, "snippet": " words "}]}, {"docketNumber": "2", "score": 9.0}, {"docketNumber": "3", "caseName": "Sealed"}]
    (tmp_path / "p.json").write_text(json.dumps({"results": hits}))
    assert [(r["docket_number"], r["caption"], r["chars"]) for r in feeds.hit_rows(spark, str(tmp_path), "https://x").collect()] == [("2", "2", None), ("1", "A", 5)]
    courts = spark.createDataFrame([(" CA9 ",), ("ca1",)], "court_id string")
    assert feeds.court(courts, "ca9").count() == 1
    with pytest.raises(ValueError):
        feeds.court(courts, "../x")
    clauses, forums = spark.createDataFrame([("c",)], "clause_id string"), spark.createDataFrame([("F",)], "code string")
    asked = spark.createDataFrame([("c", "F"), ("c", "G")], "clause_id string, code string")
    assert authority.checked(asked.limit(1), clauses, forums).count() == 1
    with pytest.raises(ValueError, match="G"):
        authority.checked(asked, clauses, forums)
    one = spark.createDataFrame([('say "hi"', "2024-02-03")], "t string, d string").select(hashing.hash_key(F.col("t")).alias("h"), text.utc_midnight(F.col("d")).alias("m")).first()
    import hashlib

    assert one["h"] == hashlib.sha256(json.dumps('say "hi"').encode()).hexdigest()[:16] and one["m"] == dt.datetime(2024, 2, 3)
    import docketry.plans.lists  # noqa: F401

    assert {"register", "tracker", "cells"} <= set(sinks.PUBLIC_VIEWS)
