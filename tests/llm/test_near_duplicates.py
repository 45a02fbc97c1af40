import random
import re

import numpy as np
import pytest

from docketry.llm import near_duplicates as ND
from docketry.llm.components import components


def brute(texts, like):
    """Groups by definition: runs of words, share of those found in either, linked directly or through others."""
    sets = {}
    for i, t in texts:
        if i is None or t is None:
            continue
        w = re.findall(r"[^\W_]+", t.lower())
        sets[i] = (t, frozenset(tuple(w[k : k + like.run]) for k in range(len(w) - like.run + 1)))
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    n, d = like.share
    for i, (t, a) in sets.items():
        for j, (u, b) in sets.items():
            if i < j and (t == u or (a | b and len(a & b) * d >= n * len(a | b))):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    return {i: find(i) for i in sets}


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 4, 12, 60, 300]))]
        out.append((f"d{i:03d}", " ".join(words)))
        for k in range(r.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(r.randrange(1 + len(words) // 6)):
                at = r.randrange(len(edited))
                edited[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [edited[at], "x"]])
            out.append((f"d{i:03d}v{k}", r.choice([" ", ", "]).join(edited).upper()))
    return out + [("e1", ""), ("e2", ""), ("n1", None), ("n2", None), ("s1", "See docket."), ("s2", "see docket"), (None, "some words without an id")]


@pytest.mark.parametrize("seed,like", [(1, ND.Likeness(run=3, share=(1, 2))), (2, ND.Likeness()), (3, ND.Likeness(run=3, share=(1, 2), block_rows=16, held=2, streamed=3, chunk_bytes=4000)), (4, ND.Likeness(run=1, share=(2, 3), block_bytes=500, chunk_bytes=500))])
def test_groups_match_brute_force(spark, seed, like):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "opinion_id string, full_text string, id string, n int").repartition(3)
    got = {r["id"]: r["group_id"] for r in ND.groups(df, "opinion_id", "full_text", like).collect()}
    assert got == brute(texts, like)


def test_copies_are_one_representative_and_links_are_between_texts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(f"c{i:03d}", text) for i in range(300)] + [("v", text + " extra"), ("far", "nothing like it at all here")]
    links, members = ND.similar_texts(spark.createDataFrame(rows, "id string, t string"), "id", "t", ND.Likeness(run=3, share=(1, 2)))
    assert links.count() == 1 and {r["representative"] for r in members.collect()} == {"c000", "v", "far"} and members.count() == 302
    out = {r["id"]: r for r in ND.groups(spark.createDataFrame(rows, "id string, t string"), "id", "t", ND.Likeness(run=3, share=(1, 2))).collect()}
    assert out["c299"]["group_id"] == out["v"]["group_id"] == "c000" and out["v"]["n_links"] == 1 and out["far"]["n_links"] == 0


def test_a_hot_family_of_variants_is_one_group(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(f"f{i:03d}", " ".join([*base, f"x{i}", f"y{i}"])) for i in range(150)]
    like = ND.Likeness(run=3, share=(1, 2), chunk_bytes=20_000)
    links, _ = ND.similar_texts(spark.createDataFrame(rows, "id string, t string"), "id", "t", like)
    assert links.count() < 150 * 149 / 4  # not all pairs
    assert {r["group_id"] for r in ND.groups(spark.createDataFrame(rows, "id string, t string"), "id", "t", like).collect()} == {"f000"}


@pytest.mark.parametrize("layout", [{}, {"block_rows": 64, "held": 1}, {"block_bytes": 8000, "chunk_bytes": 2000}])
def test_links_of_a_hot_family_are_all_counted(spark, layout):
    base = [f"w{i}" for i in range(30)]
    texts = [(f"f{i:03d}", " ".join([*base[: 12 + i % 19], f"x{i}", f"y{i}"])) for i in range(130)] + [("copy", " ".join([*base[:12], "x0", "y0"])), ("far", "nothing like it at all here")]
    like = ND.Likeness(run=3, share=(1, 2), **layout)
    sets = {i: frozenset(tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)) for i, t in texts}
    others = set(sets.values())
    want = {i: sum(1 for b in others if b != a and 2 * len(a & b) >= len(a | b)) for i, a in sets.items()}
    got = {r["id"]: r["n_links"] for r in ND.groups(spark.createDataFrame(texts, "id string, t string"), "id", "t", like).collect()}
    assert got == want and want["f000"] > 4 and want["far"] == 0 and len(set(want.values())) > 3


def test_one_id_with_two_texts_and_repeats(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [("x", a), ("x", a), ("x", b), ("y", a + " more"), ("z", b + " more"), ("q", "short"), ("q", "short"), ("r", "short")]
    out = ND.groups(spark.createDataFrame(rows, "id string, t string"), "id", "t", ND.Likeness(run=3, share=(1, 2))).collect()
    assert sorted((r["id"], r["group_id"], r["n_links"]) for r in out) == [("q", "q", 0), ("r", "q", 0), ("x", "x", 1), ("x", "x", 1), ("y", "x", 1), ("z", "x", 1)]


def test_pairs_of_a_group_are_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(ND, "PAIR_ROWS", 7)
    members = [(f"{g}{i:03d}", g) for g, n in (("a", 60), ("b", 2), ("c", 1)) for i in range(n)]
    got = [(r["a"], r["b"]) for r in ND.pairs(spark.createDataFrame(members, "id string, group_id string")).collect()]
    want = {(x, y) for x, g in members for y, h in members if g == h and x < y}
    assert len(got) == len(want) and set(got) == want


def test_every_pair_of_blocks_that_may_be_alike_meets_once():
    r = random.Random(5)
    like = ND.Likeness(run=3, share=(1, 2), held=3, streamed=4)
    meta = []
    for block in range(40):
        cls = 5 + block // 15
        n = sorted(r.randrange(1 << cls, 2 << cls) for _ in range(2))
        pop = sorted(r.randrange(n[0] // 2, n[1]) for _ in range(2))
        meta.append({"block": block, "cls": cls, "n_min": n[0], "n_max": n[1], "low": pop[0], "high": pop[1]})
    plan, by = ND._tasks(meta, like, 4), {m["block"]: m for m in meta}
    met = []
    for _, rows in plan.groupby("task"):
        held, streams = rows[~rows["streams"]]["block"], rows[rows["streams"]]["block"]
        assert len(held) <= 3 and len(streams) <= 4
        met += [(a, b) for a in held for b in streams if a <= b and not like.far(by[a], by[b])]
    assert len(met) == len(set(met)) and set(met) == {(a, b) for a in by for b in by if a <= b and not like.far(by[a], by[b])}


def test_components_in_rounds_equal_those_in_one_task(spark, monkeypatch):
    from docketry.llm import components as C

    r = random.Random(2)
    links = spark.createDataFrame([(f"{r.randrange(120):03d}", f"{r.randrange(120):03d}") for _ in range(70)], "a string, b string")
    one = {r["id"]: r["component"] for r in components(links).collect()}
    monkeypatch.setattr(C, "ONE_TASK", 0)
    assert {r["id"]: r["component"] for r in components(links).collect()} == one and len(set(one.values())) > 5


def test_empty_table(spark):
    assert ND.groups(spark.createDataFrame([], "id string, t string"), "id", "t").count() == 0
    with pytest.raises(ValueError):
        ND.Likeness(share=(1, 3))


def test_bitmaps_never_hide_likeness():
    r = random.Random(9)
    for _ in range(200):
        like = ND.Likeness(run=1, share=(1, 2))
        a = {r.randrange(10**6) for _ in range(r.randrange(1, 200))}
        b = {x for x in a if r.random() < 0.8} | {r.randrange(10**6) for _ in range(r.randrange(40))}
        ha, hb = (np.unique(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (a, b))
        bits = ND.bits_of(max(ND.size_class(len(ha)), ND.size_class(len(hb))))
        far = int(np.bitwise_count(ND.bitmap(ha, bits) ^ ND.bitmap(hb, bits)).sum())
        assert far <= len(a ^ b)
        wide = ND.bitmap(ha, 2 * bits)
        assert (wide[: len(wide) // 2] | wide[len(wide) // 2 :] == ND.bitmap(ha, bits)).all()
        if 2 * len(a & b) >= len(a | b):
            limit, scale = like.radius(len(a) + len(b))
            assert far <= limit // scale


def test_components(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("x", "x"), (None, "q"), ("a", "b")], "a string, b string")
    assert {r["id"]: r["component"] for r in components(links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(200)], "a string, b string")
    assert {r["component"] for r in components(chain).collect()} == {"000"}
    assert components(links.limit(0)).count() == 0
