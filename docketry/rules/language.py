"""The rule language: text to syntax tree.

rule  := "when" cond ("and" cond)* "then" "flag" STRING ["severity" ("low" | "medium" | "high" | "critical")]
cond  := PATH ("==" | "!=" | "<" | "<=" | ">" | ">=") literal | PATH "contains" STRING | PATH "in" "(" literal ("," literal)* ")"
Literals are strings without escapes, numbers, true and false. Paths are identifiers with _ . and -; keywords are lower
case. A rule without a severity has medium.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SEVERITIES = ("low", "medium", "high", "critical")
OPERATORS = ("==", "!=", "<=", ">=", "<", ">")
_TOKEN = re.compile(r"""\s*(?:(?P<string>"[^"]*")|(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<word>[A-Za-z_][\w.\-]*)|(?P<op>==|!=|<=|>=|<|>)|(?P<mark>[(),]))""")


class RuleError(ValueError):
    """The text is no rule."""


@dataclass(frozen=True)
class Condition:
    path: str
    op: str
    values: tuple[str | float | bool, ...]


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    flag: str
    severity: str


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text) of every token; anything else than a token is an error."""
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise RuleError(f"unexpected text at {at}: {source[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, source: str):
        self.rest = tokens(source)

    def take(self, kind: str, *texts: str) -> str:
        if not self.rest or self.rest[0][0] != kind or texts and self.rest[0][1] not in texts:
            raise RuleError(f"expected {' or '.join(texts) or kind}, found {self.rest[0][1] if self.rest else 'the end'}")
        return self.rest.pop(0)[1]

    def has(self, kind: str, *texts: str) -> bool:
        return bool(self.rest) and self.rest[0][0] == kind and (not texts or self.rest[0][1] in texts)

    def literal(self) -> str | float | bool:
        if self.has("string"):
            return self.take("string")[1:-1]
        if self.has("number"):
            return float(self.take("number"))
        return self.take("word", "true", "false") == "true"

    def condition(self) -> Condition:
        path = self.take("word")
        if self.has("word", "contains"):
            self.take("word")
            return Condition(path, "contains", (self.take("string")[1:-1],))
        if self.has("word", "in"):
            self.take("word")
            self.take("mark", "(")
            values = [self.literal()]
            while self.has("mark", ","):
                self.take("mark")
                values.append(self.literal())
            self.take("mark", ")")
            return Condition(path, "in", tuple(values))
        return Condition(path, self.take("op"), (self.literal(),))


def parse(source: str) -> Rule:
    """The rule a text says, or RuleError."""
    r = _Reader(source)
    r.take("word", "when")
    conditions = [r.condition()]
    while r.has("word", "and"):
        r.take("word")
        conditions.append(r.condition())
    r.take("word", "then")
    r.take("word", "flag")
    flag, severity = r.take("string")[1:-1], "medium"
    if r.has("word", "severity"):
        r.take("word")
        severity = r.take("word", *SEVERITIES)
    if r.rest:
        raise RuleError(f"unexpected {r.rest[0][1]} after the rule")
    return Rule(tuple(conditions), flag, severity)


def holds(condition: Condition, context: dict) -> bool:
    """A condition on one nested record, in Python: the meaning that compiled rules are tested against."""
    value = context
    for part in condition.path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    if value is None:
        return False
    if condition.op == "contains":
        return condition.values[0] in value if isinstance(value, (str, list)) else False
    if condition.op == "in":
        return any(_same(value, v) for v in condition.values)
    want = condition.values[0]
    if _kind(value) != _kind(want):
        return False  # also for !=
    if condition.op in ("==", "!="):
        return (value == want) == (condition.op == "==")
    if _kind(value) != "number":
        return False
    return {"<": value < want, "<=": value <= want, ">": value > want, ">=": value >= want}[condition.op]


def _kind(value) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "other"


def _same(value, want) -> bool:
    return _kind(value) == _kind(want) and value == want
