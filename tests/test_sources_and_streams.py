import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import feeds, pages
from docketry.streaming import events, ingest

BASE = "https://records.example"


def test_search_hits(spark, tmp_path, as_rows):
    hits = [
        {"court_id": "cand", "docketNumber": " 1-1 ", "caseName": "A v. B", "judge": " ", "dateFiled": "2024-01-02T00:00", "absolute_url": "/o/1/", "opinions": [{"id": 7, "snippet": " text "}, {"id": 8, "snippet": ""}]},
        {"court_id": "", "docket_id": 5, "docketNumber": "", "opinions": [{"snippet": "x"}]},
        {"court_id": "x"},
        {"court_id": "x", "docketNumber": "2", "caseName": "Sealed v. C"},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"next": None, "results": hits}))
    c, o = feeds.search_hits(spark, str(tmp_path), BASE)
    assert as_rows(c.select("docket_number", "source_court_id", "judge", F.col("filed").cast("string"), "source_url")) == [("1-1", "cand", None, "2024-01-02", BASE + "/o/1/"), ("cl-docket:5", None, None, None, None)]
    assert as_rows(o.select("docket_number", "citation", "full_text", "source_ref")) == [("1-1", "A v. B", "text", "cl-opinion:7"), ("cl-docket:5", "cl-docket:5", "x", None)]


def test_atom(spark, tmp_path, as_rows):
    entry = lambda title, link, summary: f'<entry><title>{title}</title>{link}<published>2024-03-01T00:00:00</published><author><name>N</name></author><category term="T"/><summary type="html">{summary}</summary></entry>'
    good = '<link rel="alternate" href="https://x/opinion/42/a/"/><link rel="self" href="https://y"/>'
    xml = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>' + entry("A", good, "&lt;p&gt;Case No. 24-7676 held.&lt;/p&gt; Original document") + entry("B", '<link rel="self" href="z"/><link rel="x" href=""/>', "text") + entry("C", good, "&lt;b/&gt;") + entry("D", good, "plain") + "</feed>"
    (tmp_path / "a.xml").write_text(xml)
    e = feeds.atom_entries(spark, str(tmp_path / "a.xml"))
    assert as_rows(e.select("title", "author", "category")) == [("A", "N", "T"), ("C", "N", "T"), ("D", "N", "T")]
    c, o = feeds.court_feed(e, "cand")
    assert as_rows(c.select("docket_number")) == [("24-7676",), ("cl-opinion:42",)] and as_rows(o.select("full_text"))[0] == ("Case No. 24-7676 held.",)


def test_records(spark, as_rows):
    rows = lambda *r: spark.createDataFrame([(json.dumps(x) if not isinstance(x, str) else x,) for x in r], "value string")
    d = feeds.dockets(rows({"docket_number": "1", "court": "https://x/courts/nysd/"}, {"docket_number": " "}, {"docket_number": "2", "blocked": True}, "no json"), BASE)
    assert as_rows(d.select("docket_number", "jurisdiction")) == [("1", "nysd")]
    o = feeds.opinions(rows({"id": 1, "plain_text": " ", "html": "<p>h</p>", "cluster": {"docket_number": "9", "case_name": "N"}}, {"id": 2, "blocked": True, "plain_text": "x"}, {"id": 3}), BASE)
    assert as_rows(o.select("docket_number", "citation", "full_text", "text_completeness")) == [("9", "N", "<p>h</p>", "full")]
    c = feeds.courts(rows({"id": "ca9", "citation_string": "", "start_date": "1891-03-03"}, {"full_name": "none"}), BASE)
    assert as_rows(c.select("court_id", "full_name", "citation_string", F.col("start_date").cast("string"), "in_use")) == [("ca9", "ca9", None, "1891-03-03", False)]


def _pages(folder, *pages_):
    for i, p in enumerate(pages_):
        (folder / f"page-{i:05d}.json").write_text(json.dumps({"results": p}))


def test_paged_crawl(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    _pages(tmp_path, [{"id": "a"}], [{"id": "b"}, {"id": "c"}], [{"id": "d"}])
    got, cursor = pages.poll(str(tmp_path), None, 2, now)
    assert [r["id"] for r in got] == ["a", "b", "c"] and cursor == "page:2"
    got, cursor = pages.poll(str(tmp_path), cursor, 5, now)
    assert [r["id"] for r in got] == ["d"] and pages.resume(cursor, now) == ("complete", 0) and pages.poll(str(tmp_path), cursor, 5, now) == ([], cursor)
    assert pages.resume(cursor, now + dt.timedelta(hours=25)) == ("page", 0) and pages.resume("complete:never", now) == ("page", 0) and pages.resume("odd", now) == ("page", 0)
    with pytest.raises(FileNotFoundError):
        pages.poll(str(tmp_path / "none"), None, 1, now)
    spark.dataSource.register(pages.PagedList)
    assert spark.read.format("paged_list").load(str(tmp_path)).count() == 4


def test_stream_into_a_table_equals_the_batch(spark, tmp_path, as_rows):
    source = tmp_path / "in"
    source.mkdir()
    _pages(source, [{"id": "a", "v": "1"}], [{"id": "b", "v": "2"}, {"id": "a", "v": "3"}])
    spark.dataSource.register(pages.PagedList)
    tables = ingest.TableFolder(spark, str(tmp_path / "tables"))
    schema, rules = "id string, v string", {"v": "new"}
    parse = lambda df: df.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.v").alias("v"))

    def run(transform=parse):
        q = spark.readStream.format("paged_list").option("budget", 1).load(str(source)).writeStream.foreachBatch(ingest.merge_batch(tables, "courts", "courts", schema, ["id"], rules, transform)).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert as_rows(tables.read("courts", schema)) == [("a", "3"), ("b", "2")]
    _pages(source, [{"id": "a", "v": "1"}], [{"id": "b", "v": "2"}, {"id": "a", "v": "3"}], [{"id": "c", "v": None}])
    run()
    assert as_rows(tables.read("courts", schema)) == [("a", "3"), ("b", "2"), ("c", None)]
    state = tables.read("state", ingest.STATE).first()
    assert state["rows_new"] == 3 and state["failures"] == 0 and state["rows_seen"] >= 4
    assert tables.files.names(str(tmp_path / "tables" / tables._versions("courts")[max(tables._versions("courts"))]))
    again = ingest.merge_batch(tables, "courts", "courts", schema, ["id"], rules, lambda df: df)
    again(spark.createDataFrame([("c", None)], schema), 0)  # delivered again: merged, not counted
    assert tables.read("state", ingest.STATE).first() == state and tables.read("courts", schema).count() == 3
    assert as_rows(ingest.feed_totals(tables.read("state", ingest.STATE))) == [(1, 0, state["rows_seen"], 3)]
    assert as_rows(ingest.feed_states(tables.read("state", ingest.STATE), ["courts"], {"courts": "page:3"})) == [("courts", "mid-list")]
    assert as_rows(ingest.feed_states(tables.read("state", ingest.STATE), ["courts", "new"])) == [("courts", "healthy"), ("new", "waiting")]


def test_a_merge_rewrites_the_parts_it_touches(spark, tmp_path, as_rows):
    tables = ingest.TableFolder(spark, str(tmp_path / "t"))
    schema = "id string, v string, n int"
    merge = ingest.merge_batch(tables, "s", "rows", schema, ["id"], {"v": "new", "n": "replace"}, lambda df: df, order="n")
    merge(spark.createDataFrame([(f"k{i}", "a", 1) for i in range(200)], schema), 0)
    before = tables._versions("rows")
    merge(spark.createDataFrame([("k7", "early", 2), ("k7", "late", 3), ("new", "b", 1)], schema), 1)
    after = tables._versions("rows")
    assert 1 <= sum(before.get(k) != v for k, v in after.items()) <= 2 and len(before) > 30
    got = {r["id"]: r["v"] for r in tables.read("rows", schema).collect()}
    assert len(got) == 201 and got["k7"] == "late" and got["k8"] == "a"
    with pytest.raises(Exception):  # noqa: B017
        ingest.merge_batch(tables, "s", "rows", schema, ["id"], {"v": "new"}, lambda df: df.select("missing"))(spark.createDataFrame([("z", "z", 1)], schema), 2)
    state = tables.read("state", ingest.STATE).first()
    assert (state["batches"], state["rows_seen"], state["rows_new"], state["failures"], state["last_batch"]) == (2, 203, 201, 1, 1) and state["last_error"]
    assert ingest.feed_list("CA9, nysd ca9  nysd,scotus") == ["ca9", "nysd", "scotus"]


def test_a_failing_feed_does_not_stop_others():
    ran = []

    def bad():
        raise OSError("down")

    assert ingest.run_feeds({"a": bad, "b": lambda: ran.append(1)}) == {"a": "down"} and ran == [1]
    with pytest.raises(RuntimeError):
        ingest.run_feeds({"a": bad})


def test_event_streams(spark, tmp_path, as_rows):
    t = dt.datetime(2024, 1, 1)
    data = [(1, t, 1, "view", 1.0, None), (2, t + dt.timedelta(minutes=5), 1, "view", 2.0, None), (2, t + dt.timedelta(minutes=5), 1, "view", 2.0, None), (3, t + dt.timedelta(hours=9), 2, "view", 4.0, None), (4, t + dt.timedelta(hours=30), 2, "x", 8.0, None)]
    path = str(tmp_path / "e")
    spark.createDataFrame(data, events.SCHEMA).coalesce(1).write.parquet(path)

    def drain(make, mode, name):
        q = make(spark.readStream.schema(events.SCHEMA).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    assert as_rows(drain(events.hourly, "append", "hourly").select("event_type", "n", "total")) == [("view", 1, 4.0), ("view", 3, 5.0)]
    assert as_rows(drain(events.sessions, "append", "sess").select("user_id", "n")) == [(1, 3), (2, 1)]
    assert drain(events.without_duplicates, "append", "dedup").count() == 4
