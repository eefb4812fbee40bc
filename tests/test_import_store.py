"""The store's commit log, files cut by ranges, the stream of names."""

import gzip
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from runlore.sources import commit_log, schemas, traces
from runlore.streaming import file_names
from runlore.streaming.traces import import_traces_stream

from .test_import import put


def rows(df, *columns):
    return sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())


EVENT = ("event_id", "run_id", "sequence", "ts_text", "kind", "actor", "summary", "payload", "source", "content_sha256")


@pytest.fixture
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def awkward_files(folder):
    """Line ends of both kinds, blank lines, bytes that are no UTF-8, lines over several ranges, marks, no last line feed."""
    rng = random.Random(7)
    kinds = [b'{"kind":"Message","actor":"a%d"}', b"", b"  \t", b"not json %d", b'{"kind":"ToolCall","payload":{"tool":"t","x":"%d"}}', b'{"actor":5}', b"\xff\xfe", b"\x85"]
    for i in range(6):
        lines = [x % n if b"%d" in x else x for n in range(150) for x in [rng.choice(kinds)]]
        lines[40] = b'{"payload":"' + b"y" * (3000 if i % 2 else 10) + b'"}'
        data = b"".join(x + rng.choice([b"\n", b"\r\n"]) for x in lines)
        put(folder, **{f"f{i}": data if i % 3 else data[:-1]})
    mark = b"\xef\xbb\xbf"
    put(folder, mark=mark + b'{"actor":"x"}\n{"actor":"y"}\n' * 90, mark_blank=mark + b"\n{}\n", mark_bad=mark + b"x\n{}", mark_alone=mark, empty=b"", feeds=b"\n" * 2000 + b"{}")
    (folder / "packed.jsonl.gz").write_bytes(gzip.compress(b"{}\n{}\n"))
    return str(folder)


@pytest.mark.parametrize("limits", [traces.ImportLimits(), traces.ImportLimits(10_000, 1000, 60, 40)])
def test_ranges_give_what_whole_files_give(spark, tmp_path, small_ranges, limits):
    path, none = awkward_files(tmp_path / "in"), spark.createDataFrame([], schemas.RUNS)
    at = F.lit("2026-01-01").cast("timestamp")
    made = traces.import_paths(spark, path, none, str(tmp_path / "keep"), limits, at)
    whole = traces.import_files(traces.read_trace_files(spark, path, limits), none, limits, at)
    assert rows(made.events, *EVENT) == rows(whole.events, *EVENT)
    assert rows(made.diagnostics, *whole.diagnostics.columns) == rows(whole.diagnostics, *whole.diagnostics.columns)
    assert rows(made.runs, *whole.runs.columns) == rows(whole.runs, *whole.runs.columns)
    key = lambda df: rows(df.withColumn("path", F.substring_index("path", "/", -1)), "path", "run_id", "outcome", "code")
    assert key(made.outcomes) == key(whole.outcomes)
    cut = spark.read.parquet(str(tmp_path / "keep" / "cut"))
    assert cut.filter("is_range").groupBy("file").count().filter("count > 3").count() >= 6


def test_a_large_file_is_cut_by_several_tasks(spark, tmp_path):
    line = json.dumps({"kind": "Message", "payload": {"text": "z" * 200}}).encode() + b"\n"
    path, name = put(tmp_path / "in", a=line * 60_000), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2 << 20))
    try:
        made = traces.import_paths(spark, path, spark.createDataFrame([], schemas.RUNS), str(tmp_path / "keep"))
        assert len(list((tmp_path / "keep" / "cut").glob("part-*.parquet"))) >= 6
    finally:
        spark.conf.set(name, before)
    told = made.events.agg(F.count(F.lit(1)), F.max("sequence"), F.max("source.byte_offset"), F.countDistinct("sequence"), F.sum(F.col("source.byte_offset") - F.col("sequence") * len(line))).first()
    assert tuple(told) == (60_000, 59_999, 59_999 * len(line), 60_000, 0)


def test_outcomes_of_all_imports_stay(spark, tmp_path):
    path, store = put(tmp_path / "in", a=b"{}", b=b"{}\nx", c=b""), str(tmp_path / "store")
    for expected in (["Imported", "Imported", "Partial"], ["Duplicate"] * 3):
        assert sorted(r.outcome for r in traces.import_traces(spark, path, store).collect()) == expected
    put(tmp_path / "in", d=b"{}\n")
    import_traces_stream(spark, path, store).awaitTermination()
    assert len(traces.import_traces(spark, path, store).collect()) == 4
    done = commit_log.commits(spark, store)
    assert [(c.number, c.batch) for c in done] == [(0, None), (1, None), (2, 0), (3, None)]
    by = {}
    for r in commit_log.read(spark, store, "outcomes", schemas.OUTCOMES, done).collect():
        by.setdefault(next(c.number for c in done if c.id == r.import_id), []).append((r.outcome, r.batch))
    assert {n: sorted(x, key=str) for n, x in by.items()} == {
        0: [("Imported", None)] * 2 + [("Partial", None)], 1: [("Duplicate", None)] * 3, 2: [("Duplicate", 0)] * 3 + [("Imported", 0)], 3: [("Duplicate", None)] * 4,
    }
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 3


def test_reads_take_folders_of_commits_alone(spark, tmp_path):
    path, store = put(tmp_path / "in", a=b"{}", b=b"{}\n"), str(tmp_path / "store")
    traces.import_traces(spark, path, store)
    (done,) = commit_log.commits(spark, store)
    left = traces.import_files(traces.read_trace_files(spark, path), spark.createDataFrame([], schemas.RUNS))
    left.events.write.parquet(commit_log.folder(store, "events", "left"))  # of a writer that failed
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 2
    events = commit_log.read(spark, store, "events", schemas.EVENTS, [done])
    assert all(f"import_id={done.id}" in f for f in events.inputFiles())
    plan = events.filter(F.col("import_id") == done.id)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(import_id" in plan and "PushedFilters: []" in plan
    assert commit_log.remove_leftovers(spark, store, traces.TABLES) == []
    time.sleep(1.1)
    assert commit_log.remove_leftovers(spark, store, traces.TABLES, 1) == ["events/import_id=left"]
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 2


def test_one_of_two_writers_gets_a_number(spark, tmp_path):
    path, won = f"{tmp_path}/log/1.json", []
    writers = [threading.Thread(target=lambda i=i: won.append((commit_log.put_new(spark, path, b"%d" % i), i))) for i in range(8)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    (winner,) = [i for ok, i in won if ok]
    assert (tmp_path / "log" / "1.json").read_bytes() == b"%d" % winner


def test_imports_at_the_same_time_count_each_run_once(spark, tmp_path):
    path, store, told = put(tmp_path / "in", **{f"f{i}": b'{"actor":"%d"}\nx' % i for i in range(5)}), str(tmp_path / "store"), []
    writers = [threading.Thread(target=lambda: told.append(traces.import_traces(spark, path, store).collect())) for _ in range(2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert sorted(r.outcome for x in told for r in x) == ["Duplicate"] * 5 + ["Partial"] * 5
    for name, schema in (("runs", schemas.RUNS), ("events", schemas.EVENTS), ("diagnostics", schemas.DIAGNOSTICS), ("event_index", schemas.EVENT_INDEX)):
        assert traces.stored(spark, store, name, schema).count() == 5, name
    assert traces.stored(spark, store, "outcomes", schemas.OUTCOMES).count() == 10


def test_a_stream_takes_bounded_batches(spark, tmp_path):
    """Empty files and those that are too large take part, over several batches; names with signs of patterns are names."""
    line, store = b'{"actor":"abcdefghij"}\n', str(tmp_path / "store")
    path = put(tmp_path / "in", **{"a": line, "b": line * 2, "c": b"", "d": line * 50, "e": line * 3, "f[1]*": line * 4, "_no": line * 5})
    (tmp_path / "in" / "more").mkdir()
    put(tmp_path / "in" / "more", g=line * 6)
    limits = traces.ImportLimits(total_bytes=500)
    import_traces_stream(spark, path, store, limits, batch_bytes=100).awaitTermination()
    got = traces.stored(spark, store, "outcomes", schemas.OUTCOMES).collect()
    assert {r.path.rpartition("/")[2]: (r.outcome, r.code) for r in got} == {
        "a.jsonl": ("Imported", None), "b.jsonl": ("Imported", None), "c.jsonl": ("Imported", None), "d.jsonl": ("Rejected", "TOTAL_BYTES_LIMIT"),
        "e.jsonl": ("Imported", None), "f[1]*.jsonl": ("Imported", None), "g.jsonl": ("Imported", None),
    }
    assert len({r.batch for r in got}) >= 4 and len(got) == 7
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 1 + 2 + 3 + 4 + 6


def test_names_are_admitted_once(tmp_path):
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "max_bytes": "10", "file_bytes": "100"}
    put(tmp_path / "in", a=b"12345678", b=b"1234", c=b"x" * 200)
    reader = file_names.FileNamesReader(options)
    assert reader.initialOffset() == {"admitted": 0}
    ends = [reader.latestOffset()["admitted"] for _ in range(4)]
    assert ends[0] == 1 and ends[-1] == ends[-2]  # no more when all is admitted
    again = file_names.FileNamesReader(options)  # after a failure
    assert again.latestOffset() == {"admitted": ends[-1]}
    names = lambda r: [p.rpartition("/")[2] for part in r.partitions({"admitted": 0}, {"admitted": ends[-1]}) for p, _ in r.read(part)]
    assert sorted(names(again)) == ["a.jsonl", "b.jsonl", "c.jsonl"] and names(again) == names(reader)
