import random

import pytest

from docketry.operators import hierarchy as H


def brute(parent):
    out = {}
    for i in parent:
        seen, at = [i], i
        while True:
            at = parent[at]
            if at is None or at not in parent:
                out[i] = ("path", list(reversed(seen)))
                break
            if at in seen:
                loop = seen[seen.index(at) :]
                out[i] = ("loop", min(loop), at == i)
                break
            seen.append(at)
    return out


def solved(spark, parent, spacing):
    links = spark.createDataFrame([(k, v) for k, v in parent.items()], "id string, parent string")
    return {r["id"]: ("path", r["path"]) if r["path"] is not None else ("loop", r["cycle_id"], r["on_cycle"]) for r in H.hierarchy(links, spacing).collect()}


@pytest.mark.parametrize("seed,spacing,one_task", [(1, 2, 200_000), (2, 3, 0), (3, 8, 200_000), (4, 1000, 0), (8, 1000, 200_000)])
def test_random_graphs_match_brute_force(spark, monkeypatch, seed, spacing, one_task):
    monkeypatch.setattr(H, "ONE_TASK", one_task)
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(120)]
    parent = {i: r.choice([None, r.choice(ids), r.choice(ids), r.choice(ids)]) for i in ids}
    assert solved(spark, parent, spacing) == brute(parent)


def test_long_chain_and_rings_with_and_without_splitters(spark):
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(70)}
    parent |= {f"r{i}": f"r{(i + 1) % 30}" for i in range(30)} | {"t0": "r3", "t1": "t0", "self": "self"}
    for spacing in (2, 10_000):
        assert solved(spark, parent, spacing) == brute(parent)


def test_links_take_the_latest_row_and_compare_ids_loosely(spark, as_rows):
    schema = "court_id string, parent_court string, refreshed_at string, id string"
    data = [(" A ", "b", "2020", "x"), ("a", "C", "2021", "x"), ("b", "", "2020", None), ("C", " ", "2020", "y"), ("d", "gone", "2020", "z"), (None, "a", "2020", "q"), ("  ", "a", "2020", "q"), ("d", "gone", "2020", "z")]
    links = H.parent_links(spark.createDataFrame(data, schema), "court_id", "parent_court", "refreshed_at")
    assert as_rows(links) == [("a", "c"), ("b", None), ("c", None), ("d", None)]


def test_descendants_and_counts(spark, as_rows):
    parent = {"a": None, "b": "a", "c": "b", "d": "a", "x": "y", "y": "x"}
    tree = H.hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"))
    assert as_rows(H.descendants(tree)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]
    counts = {r["id"]: r["n_descendants"] for r in H.hierarchy(tree.select("id", "parent"), counts=True).collect()}
    assert counts == {"a": 3, "b": 1, "c": 0, "d": 0, "x": None, "y": None}


@pytest.mark.parametrize("seed,spacing", [(5, 2), (6, 4), (7, 1000)])
def test_counts_and_cycles_of_random_graphs(spark, seed, spacing):
    r = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(150)]
    parent = {i: r.choice([None, *r.choices(ids, k=6)]) if int(i[1:]) % 5 == 0 else r.choice(ids[max(0, int(i[1:]) - 9) : int(i[1:])] or [None]) for i in ids}
    want = brute(parent)
    links = spark.createDataFrame(list(parent.items()), "id string, parent string")
    beneath = {i: sum(1 for j, w in want.items() if w[0] == "path" and i in w[1] and i != j) if want[i][0] == "path" else None for i in ids}
    assert {x["id"]: x["n_descendants"] for x in H.hierarchy(links, spacing, counts=True).collect()} == beneath
    assert {x["id"]: x["cycle_id"] for x in H.cycles(links, spacing).collect()} == {i: w[1] for i, w in want.items() if w[0] == "loop"}


def test_many_short_loops_take_few_rounds(spark, monkeypatch):
    tables = []
    plain = H.materialize
    monkeypatch.setattr(H, "ONE_TASK", 0)
    monkeypatch.setattr(H, "materialize", lambda df, name="t": tables.append(name) or plain(df, name))
    parent = {f"l{i}{s}": f"l{i}{t}" for i in range(400) for s, t in (("a", "b"), ("b", "a"))}
    assert H.cycles(spark.createDataFrame(list(parent.items()), "id string, parent string"), 1000).count() == 800
    assert tables.count("bare") + tables.count("loops") < 12


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert H.hierarchy(empty).count() == 0
