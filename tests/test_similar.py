import random

import pytest

from docketry.operators.similar import similar_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("share,seed", [(0.86, 1), (0.7, 2), (1.0, 3)])
def test_no_pair_is_lost(spark, share, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(1, 22))) for _ in range(80)]
    for t in list(texts):
        e = list(t)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(e) + 1)
            e[at : at + r.randrange(2)] = [r.choice("abcd")] * r.randrange(2)
        texts.append("".join(e))
    rows = [(r.choice("xy"), t) for t in texts] + [("x", None), ("x", ""), (None, "aaa"), ("x", texts[0]), ("x", texts[0])]
    df = spark.createDataFrame(rows, "scope string, text string")
    got = {(p["scope"], p["a"], p["b"]) for p in similar_pairs(df, df, share).collect()}
    known = {(s, t) for s, t in rows if s and t}
    want = {(s, a, b) for s, a in known for q, b in known if s == q and 1 - distance(a, b) / max(len(a), len(b)) >= share - 1e-12}
    assert got == want


def test_empty_and_bad_share(spark):
    df = spark.createDataFrame([], "scope string, text string")
    assert similar_pairs(df, df, 0.9).count() == 0
    with pytest.raises(ValueError):
        similar_pairs(df, df, 0.5)
