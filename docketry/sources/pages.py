"""A paged list as a Spark data source: batch, and a stream whose offset is the page to go on with.

Pages are recorded as page-00000.json, page-00001.json, ... in a folder, each {"results": [...]}. A crawl reads at most
`budget` pages per poll and goes on where it stopped; after the last page it is complete, and starts again once the list
is older than a day. A missing first page is an error, a later one is a pause."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

COMPLETE, REFRESH_HOURS, ATTEMPTS = "complete:", 24, 3


def resume(cursor: str | None, now: dt.datetime) -> tuple[str, int]:
    """("page", number) or ("complete", 0): where a crawl goes on. Markers that can't be read or are a day old start it anew."""
    cursor = (cursor or "").strip()
    if cursor.startswith(COMPLETE):
        try:
            at = dt.datetime.fromisoformat(cursor.removeprefix(COMPLETE).strip())
        except ValueError:
            return "page", 0
        return ("complete", 0) if now - at < dt.timedelta(hours=REFRESH_HOURS) else ("page", 0)
    return ("page", int(cursor.removeprefix("page:"))) if cursor.removeprefix("page:").isdigit() else ("page", 0)


def read_page(folder: str, number: int) -> list[dict] | None:
    """The records of a page, tried again when it can't be read; None if there is no such page."""
    path = os.path.join(folder, f"page-{number:05d}.json")
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)["results"]
        except FileNotFoundError:
            return None
        except (OSError, ValueError, KeyError):
            if attempt == ATTEMPTS:
                raise
            time.sleep(0.05 * attempt)
    return None


def poll(folder: str, cursor: str | None, budget: int, now: dt.datetime) -> tuple[list[dict], str]:
    """Records of up to `budget` pages from the cursor on, and the next cursor."""
    state, at = resume(cursor, now)
    if state == "complete":
        return [], cursor or ""
    records: list[dict] = []
    for number in range(at, at + budget):
        page = read_page(folder, number)
        if page is None:
            if number == 0:
                raise FileNotFoundError(f"{folder} has no first page")
            return records, f"{COMPLETE}{now.isoformat()}"
        records += page
    return records, f"page:{at + budget}"


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Batch(DataSourceReader):
    """One task per page."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        numbers = sorted(int(f[5:10]) for f in os.listdir(self.folder) if f.startswith("page-") and f.endswith(".json"))
        if numbers[:1] != [0]:
            raise FileNotFoundError(f"{self.folder} has no first page")
        return [_Page(n) for n in numbers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in read_page(self.folder, partition.number) or []:
            yield (partition.number, json.dumps(r, sort_keys=True))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.budget = options["path"], int(options.get("budget", 10))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start["page"]
        for number in range(at, at + self.budget):
            page = read_page(self.folder, number)
            if page is None:
                break
            rows += [(number, json.dumps(r, sort_keys=True)) for r in page]
            at = number + 1
        return iter(rows), {"page": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for number in range(start["page"], end["page"]):
            for r in read_page(self.folder, number) or []:
                yield (number, json.dumps(r, sort_keys=True))


class PagedList(DataSource):
    """spark.dataSource.register(PagedList); then spark.read or readStream .format("paged_list").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return "page int, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)
