"""Rules as Columns: all rules are evaluated in one projection over all records, and Catalyst sees plain predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.rules.language import Condition, Rule, RuleError, parse

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _field(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _column(path: str) -> Column:
    first, *rest = path.split(".")
    out = F.col(f"`{first}`")
    for part in rest:
        out = out[part]
    return out


def _kind(kind: T.DataType | None) -> str:
    return "bool" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, _NUMBERS) else "text" if isinstance(kind, T.StringType) else "other"


def _literal_kind(value) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"


def condition_column(c: Condition, schema: T.StructType) -> Column:
    """A condition as a boolean that is never null: missing fields, nulls and kinds that differ are false, for != too."""
    kind = _field(schema, c.path)
    if kind is None:
        return F.lit(False)
    value = _column(c.path)
    if c.op == "contains":
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.array_contains(value, c.values[0]), F.lit(False))
        return F.coalesce(F.contains(value, F.lit(c.values[0])), F.lit(False)) if _kind(kind) == "text" else F.lit(False)
    if c.op == "in":
        same = [v for v in c.values if _literal_kind(v) == _kind(kind)]
        number = value.cast("double") if _kind(kind) == "number" else value
        return F.coalesce(number.isin(*same), F.lit(False)) if same else F.lit(False)
    want = c.values[0]
    if _kind(kind) != _literal_kind(want) or c.op not in ("==", "!=") and _kind(kind) != "number":
        return F.lit(False)
    left = value.cast("double") if _kind(kind) == "number" else value
    ops = {"==": left == want, "!=": left != want, "<": left < want, "<=": left <= want, ">": left > want, ">=": left >= want}
    return F.coalesce(ops[c.op], F.lit(False))


def fires(rule: Rule, schema: T.StructType) -> Column:
    """Whether all conditions of a rule hold."""
    out = F.lit(True)
    for c in rule.conditions:
        out = out & condition_column(c, schema)
    return out


def _reasons(rule: Rule, schema: T.StructType) -> Column:
    """One line per condition with the value that was found."""
    lines = []
    for c in rule.conditions:
        want = ", ".join(str(v) for v in c.values)
        found = _column(c.path).cast("string") if _field(schema, c.path) is not None else F.lit(None).cast("string")
        lines.append(F.concat(F.lit(f"{c.path} {c.op} {want} (found "), F.coalesce(found, F.lit("nothing")), F.lit(")")))
    return F.array(*lines)


def flags(records: DataFrame, rules: dict[str, str], keep: list[str]) -> DataFrame:
    """keep columns, rule, label, severity and reasons of every rule that fires on every record, in one pass.

    rules: name to text. A text that is no rule is an error before anything runs; see readable()."""
    schema = records.schema
    parsed = {n: parse(s) for n, s in rules.items()}
    if not parsed:
        return records.select(*keep, *[F.lit(None).cast("string").alias(c) for c in ("rule", "label", "severity")], F.lit(None).cast("array<string>").alias("reasons")).limit(0)
    fired = [F.when(fires(r, schema), F.struct(F.lit(n).alias("rule"), F.lit(r.flag).alias("label"), F.lit(r.severity).alias("severity"), _reasons(r, schema).alias("reasons"))) for n, r in parsed.items()]
    return records.select(*keep, F.explode(F.array_compact(F.array(*fired))).alias("_f")).select(*keep, "_f.rule", "_f.label", "_f.severity", "_f.reasons")


def readable(rules: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The rules that parse, and the errors of those that don't."""
    good, bad = {}, {}
    for name, source in rules.items():
        try:
            parse(source)
            good[name] = source
        except RuleError as e:
            bad[name] = str(e)
    return good, bad


def new_flags(fired: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Flags that were not raised before, to be reviewed: one per record and rule ever."""
    return fired.dropDuplicates(on).join(known, on, "left_anti").withColumn("review_status", F.lit("pending"))
