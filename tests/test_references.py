import datetime as dt
import random

from docketry.operators import references as R

T0 = dt.datetime(2024, 1, 1)


def run(spark, refs, parents):
    r = spark.createDataFrame(refs, "src_table string, src_field string, rec_id string, parent string, ref string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "parent string, ref string, since timestamp_ntz")
    return {(x["rec_id"], x["src_field"]): x["ref_state"] for x in R.orphan_references(r, p).collect()}


def test_dense_and_sparse_keys_match_brute_force(spark):
    r = random.Random(7)
    dense = [i for i in range(65_400, 65_700) if i % 50]
    sparse = [r.getrandbits(128) for _ in range(50)] + [2**128 - 1, 0, 2**64 - 1, 2**64]
    days = lambda n: T0 + dt.timedelta(days=n)
    since = {k: days(r.randrange(10)) for k in dense + sparse}
    parents = [("p", f"{k:032X}", s) for k, s in since.items()] + [("p", f"{dense[0]:032x}", days(30)), ("p", None, T0), ("p", "", T0), ("other", f"{99:032x}", T0)]
    wanted = dense[::3] + sparse + [65_450, 65_500, 99, 12345, 2**127]
    refs = [("t", "f", f"r{i}", "p", f"{k:032x}", days(r.randrange(10))) for i, k in enumerate(wanted)]
    expect = {}
    for (_, _, rec, _, ref, at) in refs:
        k = int(ref, 16)
        if k not in since:
            expect[(rec, "f")] = "missing"
        elif since[k] > at:
            expect[(rec, "f")] = "late"
    assert run(spark, refs, parents) == expect


def test_written_forms_blanks_nulls_and_hot_keys(spark):
    key = "0123abcd-0123-abcd-0123-0123456789ab"
    parents = [("p", key.upper(), T0), ("p", key, T0 + dt.timedelta(days=2))]
    forms = [key, "{" + key + "}", f" {key.upper()} ", key.replace("-", ""), None, "", "  ", "0123", "no key"]
    refs = [("t", "f", f"r{i}", "p", v, T0) for i, v in enumerate(forms)] + [("t", "f", f"h{i}", "p", "f" * 32, T0) for i in range(500)] + [("t", "f", "n", "p", key, None)]
    got = run(spark, refs, parents)
    assert {k: v for (k, _), v in got.items() if k[0] == "r"} == {"r7": "missing", "r8": "missing"}
    assert sum(k[0] == "h" for k, _ in got) == 500 and ("n", "f") not in got
    assert run(spark, [("t", "f", "e", "p", key, T0 - dt.timedelta(days=1))], parents) == {("e", "f"): "late"}


def test_empty_parents_and_empty_references(spark):
    assert run(spark, [("t", "f", "r", "p", "a" * 32, T0)], []) == {("r", "f"): "missing"}
    assert run(spark, [], [("p", "a" * 32, T0)]) == {}


def test_report_counts_per_month(spark):
    refs = [("t", "f", "a", "p", "a" * 32, T0), ("t", "f", "b", "p", "b" * 32, T0), ("t", "f", "c", "p", "b" * 32, None)]
    r = spark.createDataFrame(refs, "src_table string, src_field string, rec_id string, parent string, ref string, at timestamp_ntz")
    p = spark.createDataFrame([("p", "a" * 32, T0)], "parent string, ref string, since timestamp_ntz")
    got = sorted(map(tuple, R.orphan_report(R.orphan_references(r, p), r).collect()), key=repr)
    assert got == [("t", "f", "2024-01", 2, 1, 0), ("t", "f", None, 1, 1, 0)]
