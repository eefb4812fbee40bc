"""Report files, hashes of files in blocks, events in a layout for pages."""

import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlore.operators import contracts, views
from runlore.plans.driver_views import trace_events
from runlore.sources import clustered_events, report_files, stores

SF = "/root/testdata/sf0.001"


def reports(spark, ids):
    return spark.createDataFrame([(i, '{"a":"<%d>"}' % n) for n, i in enumerate(ids)], "run_id string, report string")


def listed(path):
    return {p.name: p.read_text() for p in path.iterdir()}


def test_a_file_for_each_report(spark, tmp_path):
    out = tmp_path / "out"
    assert report_files.write_report_files(reports(spark, ["a", "b/../c", "é"]), str(out)) == 3
    first = {"a.json": '{"a":"<0>"}\n', "b%2F..%2Fc.json": '{"a":"<1>"}\n', "%C3%A9.json": '{"a":"<2>"}\n'}
    assert listed(out) == first
    assert report_files.write_report_files(reports(spark, ["a"]), str(out), "html") == 1
    assert "&lt;0&gt;" in (out / "a.html").read_text()
    assert report_files.write_report_files(reports(spark, []), str(out)) == 0


def test_existing_and_repeated_reports_change_nothing(spark, tmp_path):
    out = tmp_path / "out"
    report_files.write_report_files(reports(spark, ["7"]), str(out))
    before = listed(out)
    with pytest.raises(FileExistsError, match="7.json"):
        report_files.write_report_files(reports(spark, [str(n) for n in range(20)]).repartition(4), str(out))
    assert listed(out) == before
    with pytest.raises(FileExistsError, match="x.json"):
        report_files.write_report_files(reports(spark, ["x", "y", "x"]), str(out))
    assert listed(out) == before
    for bad in ([(None, "{}")], [("z", None)]):
        with pytest.raises(Exception, match="needs a run"):
            report_files.write_report_files(spark.createDataFrame(bad, "run_id string, report string"), str(out))
    with pytest.raises(ValueError):
        report_files.write_report_files(reports(spark, ["z"]), str(out), "pdf")
    assert listed(out) == before


def test_putting_again_is_no_conflict(tmp_path):
    store, folder = stores.located(f"file:{tmp_path}")
    (tmp_path / "s").write_text("1")
    for _ in range(2):
        assert report_files._put(store, f"{folder}/s", f"{folder}/t")
    (tmp_path / "other").write_text("1")
    assert not report_files._put(store, f"{folder}/other", f"{folder}/t")
    report_files._take_away(store, f"{folder}/other", f"{folder}/t")
    assert (tmp_path / "t").exists()
    report_files._take_away(store, f"{folder}/s", f"{folder}/t")
    assert not (tmp_path / "t").exists()


def test_files_of_stores_that_move(tmp_path):
    from pyarrow import fs

    store, folder = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), ""
    (tmp_path / "s").write_text("1")
    (tmp_path / "u").write_text("2")
    for _ in range(2):
        assert report_files._put(store, f"{folder}s", f"{folder}t")
    assert not report_files._put(store, "u", "t")
    report_files._take_away(store, "u", "t")
    assert (tmp_path / "t").read_text() == "1"
    report_files._take_away(store, "s", "t")
    assert not (tmp_path / "t").exists() and (tmp_path / "s").exists()


def test_a_file_above_two_gigabytes_is_hashed_in_blocks(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "large", "wb") as file:
        file.truncate(size)
    (tmp_path / "a b").write_bytes(b"x")
    (tmp_path / "none").write_bytes(b"")
    want, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(block)
    want.update(bytes(size & (1 << 20) - 1))
    rows = {r.path: (r.sha256, r.byte_size) for r in contracts.manifest_files(spark, str(tmp_path)).collect()}
    of = lambda b: hashlib.sha256(b).hexdigest()
    assert rows == {"large": (want.hexdigest(), size), "a b": (of(b"x"), 1), "none": (of(b""), 0)}
    before = pa.default_memory_pool().max_memory()
    with open(tmp_path / "part", "wb") as file:
        file.truncate(200 << 20)
    stores.sha256_of(str(tmp_path / "part"))
    assert pa.default_memory_pool().max_memory() <= max(before, 32 << 20)


def test_paths_of_stores(tmp_path):
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert stores.located(path)[1] == str(tmp_path)
    assert stores.located(os.path.relpath(tmp_path))[1] == str(tmp_path)


def scanned(df):
    """Rows that the plan's scans gave, after the plan has run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_page_of_one_run_reads_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered_events, "ROW_GROUP_BYTES", 1 << 14)
    rows = spark.range(60_000).select(
        F.format_string("run-%03d", (F.col("id") % 30).cast("int")).alias("run_id"), F.floor(F.col("id") / 30).alias("sequence"), F.sha2(F.col("id").cast("string"), 256).alias("payload")
    )
    path = str(tmp_path / "layout")
    clustered_events.write_clustered(rows.repartition(5), path, file_rows=10_000)
    ranges = spark.read.parquet(f"{path}/ranges").collect()
    assert len(ranges) > 3 and sum(r.events for r in ranges) == 60_000
    found = clustered_events.read_clustered(spark, path, "run-017").filter("sequence > 1500 and sequence <= 1551")
    assert found.count() == 51 and len(found.inputFiles()) < len(ranges)
    assert scanned(found) < 12_000  # of 60,000
    page = clustered_events.run_page(spark, path, "run-017", 1500, 50)
    assert {(r.sequence, r.next_cursor) for r in page.collect()} == {(s, 1550) for s in range(1501, 1551)}
    assert clustered_events.run_page(spark, path, "none").count() == 0 == clustered_events.run_page(spark, path, "run-0175").count()
    assert clustered_events.read_clustered(spark, path).exceptAll(rows).count() == 0
    with pytest.raises(FileNotFoundError):
        clustered_events.read_clustered(spark, str(tmp_path / "no"))


def test_pages_are_those_that_cursors_come_upon(spark, tmp_path):
    events = trace_events(spark, SF).filter("sequence % 3 <> 1").cache()  # with gaps
    pages = clustered_events.all_pages(events, 7)
    for run in [r.run_id for r in events.select("run_id").distinct().orderBy("run_id").limit(2).collect()]:
        cursor, page, seen = None, 0, 0
        mine = pages.filter(F.col("run_id") == run).cache()
        while True:
            want = {(r.sequence, r.next_cursor) for r in views.event_page(events.filter(F.col("run_id") == run), cursor, 7).collect()}
            got = mine.filter(f"page = {page}")
            assert {(r.sequence, r.next_cursor) for r in got.collect()} == want and {r.cursor for r in got.collect()} == {cursor}
            seen, page, cursor = seen + len(want), page + 1, next(iter(want))[1]
            if cursor is None:
                break
        assert seen == mine.count()
    empty = events.filter("false")
    assert clustered_events.all_pages(empty).count() == 0
    clustered_events.write_clustered(empty, str(tmp_path / "e"))
    assert clustered_events.read_clustered(spark, str(tmp_path / "e")).count() == 0


def test_options_of_rows_are_checked_as_one_export_is(spark):
    from runlore.operators import candidates

    rows = [
        (c, t, m, b, a)
        for c in ("live", "x", "") for t in ("CC0", "", " \t ") for m in ("online", "offline-analysis", "x") for b in (0, 64, 65, -1) for a in (0, 1, 64, 65)
    ]
    said = spark.createDataFrame(rows, "source_category string, license_or_consent string, mode string, before int, after int").select("*", candidates.option_violations().alias("v"))
    for r in said.collect():
        try:
            candidates.ExportOptions(r.source_category, r.license_or_consent, r.before, r.after, r["mode"]).validate()
            assert r.v == [], r
        except ValueError:
            assert r.v, r
    none = spark.createDataFrame([(None, None, None, None, None)], said.drop("v").schema).select(F.size(candidates.option_violations()).alias("n")).first().n
    assert none == 6
