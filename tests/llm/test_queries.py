"""Every training-data query runs on the smallest tables and is held against SQL or an independent check."""

import glob
import os

import pandas as pd
import pytest

from docketry.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(FOLDER + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def got(spark):
    held = {}

    def of(name):
        if name not in held:
            held[name] = Q.QUERIES[name](spark, FOLDER).toPandas()
        return held[name]

    return of


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["doc_id", "text", "source"])


@pytest.fixture(scope="module")
def public_ids(docs):
    """Ids by the public tokenizer, text by text."""
    from docketry.llm import tokens

    enc = tokens.encoder(tokens.rank_file())
    return {d: enc.encode_ordinary(t) if t else [] for d, t in zip(docs["doc_id"], docs["text"], strict=True)}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(got, duck, name):
    want = duck.sql(Q.ORACLE[name]).df()
    plain = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    assert sorted(want.columns) == sorted(got(name).columns) and plain(want) == plain(got(name))


def test_ids(got, public_ids):
    assert {d: list(x) for d, x in zip(got("p6_ids")["doc_id"], got("p6_ids")["ids"], strict=True)} == public_ids


def test_containers(got, public_ids):
    rows, size = got("p7_containers"), {d: len(x) for d, x in public_ids.items()}
    assert rows.groupby("doc_id")["n_tokens"].sum().to_dict() == size
    assert rows.groupby("container_id")["n_tokens"].sum().max() <= Q.CAPACITY
    cut = rows[rows.duplicated("doc_id", keep=False)]["doc_id"].unique()
    assert all(size[d] > Q.CAPACITY for d in cut)
    fill = got("p7_fill").iloc[0]
    n = rows["container_id"].nunique()
    assert fill["containers"] == n and fill["least_containers"] == -(-sum(size.values()) // Q.CAPACITY) <= n
    # no more than one container above what the sizes allow
    assert n <= fill["least_containers"] + 1


def test_scores(got, docs):
    scores, found, rates = got("p8_scores"), got("p8_found"), got("p8_rates")
    assert sorted(scores["doc_id"]) == sorted(docs["doc_id"]) and set(found["doc_id"]) == set(scores[scores["toxic"]]["doc_id"])
    merged = docs.merge(scores, on="doc_id")
    for source, n, toxic in zip(rates["source"], rates["n_docs"], rates["n_toxic"], strict=True):
        part = merged[merged["source"].isna()] if pd.isna(source) else merged[merged["source"] == source]
        assert (len(part), int(part["toxic"].sum())) == (n, toxic)


def test_names(got):
    """Rows whose typed name equals a registered one word for word, of one person alone, are linked to that person, and every
    link stays within the role and the jurisdiction."""
    from docketry.llm import names as N

    rows = got("p4_found")
    actors = pd.read_parquet(f"{FOLDER}/accountability_actors.parquet")
    cases = pd.read_parquet(f"{FOLDER}/court_cases.parquet").sort_values("inserted_at").drop_duplicates("case_id", keep="last")
    first = dict(zip(rows[rows["src"] == "actors"]["rec_id"], rows[rows["src"] == "actors"]["actor_id"], strict=True))
    assert all(b < a for a, b in first.items()) and not set(first.values()) & set(first)
    where = actors.set_index("actor_id")[["role", "jurisdiction"]]
    assert all(tuple(where.loc[a]) == tuple(where.loc[b]) for a, b in first.items())
    judges = actors[actors["role"] == "judge"]
    of_form: dict[tuple, set] = {}
    for a, t, j in zip(judges["actor_id"], judges["display_name"], judges["jurisdiction"], strict=True):
        of_form.setdefault((N.read(t).form, j), set()).add(first.get(a, a))
    linked = dict(zip(rows[rows["src"] == "cases"]["rec_id"], rows[rows["src"] == "cases"]["actor_id"], strict=True))
    jurisdiction = dict(zip(cases["case_id"], cases["jurisdiction"], strict=True))
    assert all(where.loc[a]["jurisdiction"] == jurisdiction[r] and where.loc[a]["role"] == "judge" for r, a in linked.items())
    equal = 0
    for r, t, j in zip(cases["case_id"], cases["judge"], cases["jurisdiction"], strict=True):
        n = N.read(t)
        want = of_form.get((n.form, j), set())
        if len(want) == 1 and n.kind == "person" and N.rank(n) == 3:
            equal += 1
            assert linked.get(r) in want
    assert equal > 5


def test_every_query_is_tested():
    assert set(Q.QUERIES) == set(Q.ORACLE) | {"p4_found", "p6_ids", "p7_containers", "p7_fill", "p8_scores", "p8_found", "p8_rates"}
