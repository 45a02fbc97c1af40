import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.rules.compile import flags, new_flags, readable
from docketry.rules.language import Condition, Rule, RuleError, holds, parse

GOOD = 'when case.a == "x" and case.n <= -2.5 and case.tags contains "t" and case.b in (1, "y", true) then flag "F" severity high'
BAD = ['when a = "x" then flag "f"', 'when a == "x then flag "f"', 'when a == 1 then flag "f" extra', "when then", 'when a == 1 or b == 2 then flag "f"', 'when a == 1 then flag "f" severity huge', 'when a in () then flag "f"', "", 'when a ! 1 then flag "f"', 'When a == 1 then flag "f"']


def test_parse():
    r = parse(GOOD)
    assert r == Rule((Condition("case.a", "==", ("x",)), Condition("case.n", "<=", (-2.5,)), Condition("case.tags", "contains", ("t",)), Condition("case.b", "in", (1.0, "y", True))), "F", "high")
    assert parse('when a != true then flag "f"').severity == "medium"


@pytest.mark.parametrize("source", BAD)
def test_errors(source):
    with pytest.raises(RuleError):
        parse(source)
    assert readable({"bad": source, "good": GOOD})[0] == {"good": GOOD}


SCHEMA = "id int, case struct<s:string, n:double, i:int, b:boolean, tags:array<string>>"
conditions = st.one_of(
    st.builds(Condition, st.sampled_from(["case.s", "case.n", "case.i", "case.b", "case.none", "x.y"]), st.sampled_from(["==", "!=", "<", "<=", ">", ">="]), st.tuples(st.one_of(st.sampled_from(["a", "b"]), st.sampled_from([0.0, 1.0, 2.5]), st.booleans()))),
    st.builds(Condition, st.sampled_from(["case.s", "case.tags", "case.n"]), st.just("contains"), st.tuples(st.sampled_from(["a", "b"]))),
    st.builds(Condition, st.sampled_from(["case.s", "case.n", "case.b"]), st.just("in"), st.lists(st.one_of(st.sampled_from(["a", "b"]), st.sampled_from([0.0, 1.0]), st.booleans()), min_size=1, max_size=3).map(tuple)),
)
records = st.fixed_dictionaries({"s": st.sampled_from([None, "a", "ab", "b"]), "n": st.sampled_from([None, 0.0, 1.0, 2.5]), "i": st.sampled_from([None, 0, 1, 2]), "b": st.sampled_from([None, True, False]), "tags": st.sampled_from([None, [], ["a"], ["a", "b"]])})


def _text(c):
    lit = lambda v: f'"{v}"' if isinstance(v, str) else str(v).lower()
    return f"{c.path} {c.op} ({', '.join(map(lit, c.values))})" if c.op == "in" else f"{c.path} {c.op} {lit(c.values[0])}"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(conditions, min_size=1, max_size=3), min_size=6, max_size=10), st.lists(records, min_size=8, max_size=12))
def test_compiled_rules_mean_what_the_interpreter_says(spark, all_conditions, contexts):
    rules = {f"r{k}": f"when {' and '.join(map(_text, cs))} then flag \"f\"" for k, cs in enumerate(all_conditions)}
    df = spark.createDataFrame([(i, (c["s"], c["n"], c["i"], c["b"], c["tags"])) for i, c in enumerate(contexts)], SCHEMA)
    got = {(r["id"], r["rule"]) for r in flags(df, rules, ["id"]).collect()}
    want = {(i, n) for i, c in enumerate(contexts) for n, s in rules.items() if all(holds(x, {"case": c}) for x in parse(s).conditions)}
    assert got == want


def test_reasons_no_rules_and_new_flags(spark):
    df = spark.createDataFrame([(1, ("a", 1.0, 1, None, None))], SCHEMA)
    r = flags(df, {"r": 'when case.s == "a" and case.n >= 1 then flag "L"'}, ["id"]).first()
    assert r["reasons"] == ["case.s == a (found a)", "case.n >= 1.0 (found 1.0)"] and r["severity"] == "medium"
    assert flags(df, {}, ["id"]).count() == 0
    fired = flags(df, {"r": 'when case.s == "a" then flag "L"'}, ["id"])
    assert new_flags(fired, fired.select("id", "rule"), ["id", "rule"]).count() == 0
    assert new_flags(fired.unionByName(fired), fired.select("id", "rule").limit(0), ["id", "rule"]).first()["review_status"] == "pending"
