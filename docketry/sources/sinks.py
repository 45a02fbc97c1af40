"""What leaves the engine: catalogs as JSON, reports as Markdown, and views that may be public."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Views that may be exported, and what is never.
PUBLIC_VIEWS: dict[str, Callable[..., DataFrame]] = {}
WITHHELD = frozenset({"unresolved_officials", "pending_findings", "publication_approvals", "pipeline_runs", "ingest_cursors"})


def public_view(name: str):
    """Registers a function as a view that may be exported."""
    if name in WITHHELD:
        raise ValueError(f"{name} is withheld")

    def add(f):
        PUBLIC_VIEWS[name] = f
        return f

    return add


def export(name: str, path: str, *args) -> None:
    """Writes a public view as JSON; any other name is refused."""
    if name not in PUBLIC_VIEWS:
        raise PermissionError(f"{name} is not a public view")
    PUBLIC_VIEWS[name](*args).write.mode("overwrite").json(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """A catalog as JSON lines, in order of its first column."""
    df.orderBy(df.columns[0]).write.mode("overwrite").json(path)


def escape_html(text: Column) -> Column:
    """The five characters that mean something in HTML, as references."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def report(title: Column, facts: dict[str, Column], items: Column | None = None, note: str = "Leads for review by a person; no finding of fact.") -> Column:
    """A Markdown report per row: a heading, one line per fact, a list of items, a note. Nulls are written as unknown.

    Reports are Columns, so that those of a million rows are rendered where the rows are."""
    lines = [F.concat(F.lit("# "), title), F.lit("")]
    lines += [F.concat(F.lit(f"- **{k}:** "), F.coalesce(v.cast("string"), F.lit("unknown"))) for k, v in facts.items()]
    body = F.array_join(F.array(*lines), "\n")
    if items is not None:
        body = F.concat(body, F.lit("\n\n"), F.array_join(F.transform(F.coalesce(items, F.array()), lambda x: F.concat(F.lit("* "), x.cast("string"))), "\n"))
    return F.concat(body, F.lit(f"\n\n> {note}\n"))
