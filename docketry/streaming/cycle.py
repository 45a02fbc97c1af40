"""One cycle of ingestion, and cycles again and again: poll every feed, place what came, run what waits."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Report:
    """What a cycle did: rows new and seen per feed that ran, errors per step or feed, courts placed and cases run."""

    declared: int = 0
    new: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    placed: int = 0
    cases: int = 0

    @property
    def totals(self) -> dict[str, int]:
        return {"feeds": len(self.new), "failed": len(self.errors), "new": sum(self.new.values()), "seen": sum(self.seen.values()), "cases": self.cases}


def run_cycle(feeds: dict[str, Callable[[], tuple[int, int]]], place: Callable[[], int], run: Callable[[int], int], limit: int = 200, declare: Callable[[], int] | None = None) -> Report:
    """Declares feeds if asked to, polls each (rows new, rows seen), places courts, and runs up to limit (1 to 2000) queued
    cases. An error of one step is reported and the later ones still run; feeds run in the order given."""
    out = Report()

    def attempt(name: str, step: Callable[[], None]) -> None:
        try:
            step()
        except Exception as e:
            out.errors[name] = str(e)[:300]

    if declare:
        attempt("declare", lambda: setattr(out, "declared", declare()))
    for name, poll in feeds.items():

        def step(name=name, poll=poll) -> None:
            out.new[name], out.seen[name] = poll()

        attempt(name, step)
    attempt("place", lambda: setattr(out, "placed", place()))
    attempt("run", lambda: setattr(out, "cases", run(max(1, min(2000, limit)))))
    return out


def loop(cycle: Callable[[], Report], interval: float | None, report: Callable[[Report | Exception], None], stop: Callable[[], bool] = lambda: False, wait: Callable[[float], None] = time.sleep) -> int:
    """Runs cycles until stop says so, waiting between them; once if there is no interval. A cycle that fails as a whole is
    reported and the loop goes on. Gives the number of cycles. On a stream the same is trigger(processingTime=...)."""
    n = 0
    while True:
        n += 1
        try:
            report(cycle())
        except Exception as e:
            report(e)
        if interval is None or stop():
            return n
        wait(interval)
        if stop():
            return n
