"""Trace import: provenance, limits, diagnostics, dedupe, streaming."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from runlore.sources import schemas, traces
from runlore.streaming.traces import import_traces_stream


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / f"{name}.jsonl").write_bytes(data)
    return str(folder)


def imported(spark, path, limits=traces.ImportLimits()):
    none = spark.createDataFrame([], schemas.RUNS)
    return traces.import_files(traces.read_trace_files(spark, path, limits), none, limits, F.lit("2026-01-01").cast("timestamp"))


def test_provenance(spark, tmp_path):
    data = b'{"actor":"a","payload":{"x": 1.50}}\r\n   \r\nnot-json\n{"kind":42,"actor":false}\n{"kind":"toolcall","timestamp":"2026-07-16T19:00:00.1234567+02:00"}'
    made = imported(spark, put(tmp_path / "in", a=data))
    events = made.events.orderBy("sequence").collect()
    assert [(e.sequence, e.source.line, e.source.byte_offset, e.kind, e.actor) for e in events] == [(0, 1, 0, "Unknown", "a"), (1, 5, data.index(b'{"kind":"toolcall"'), "ToolCall", "unknown")]
    assert events[0].payload == '{"x": 1.50}' and events[0].ts_text == traces.EPOCH and events[1].payload.startswith('{"kind"')
    assert events[0].source.input_sha256 == hashlib.sha256(data).hexdigest()
    assert events[0].content_sha256 == hashlib.sha256(data.split(b"\r\n")[0]).hexdigest()
    said = made.diagnostics.orderBy("line").collect()
    assert [(d.line, d.code) for d in said] == [(3, "INVALID_JSON"), (4, "INVALID_RECORD")]
    assert [o.outcome for o in made.outcomes.collect()] == ["Partial"]
    digest = hashlib.sha256(f"{events[0].run_id.replace('-', '')}:0:{events[0].content_sha256}".encode()).digest()
    import uuid

    assert events[0].event_id == str(uuid.UUID(bytes_le=digest[:16]))


@pytest.mark.parametrize(
    ("data", "limits", "code"),
    [
        (b'{"actor":"agent"}', (10, 100, 100, 100), "TOTAL_BYTES_LIMIT"), (b'{"actor":"agent"}', (100, 3, 100, 100), "RECORD_BYTES_LIMIT"),
        (b'{"actor":"agent"}', (100, 100, 100, 0), "EVENT_COUNT_LIMIT"), (b"x\ny\nz\n", (100, 100, 2, 100), "RECORD_COUNT_LIMIT"),
        (b"x\ny\n\n", (100, 100, 2, 100), None), (b'{"actor":"agent"}', (17, 17, 1, 1), None),
    ],
)
def test_limits(spark, tmp_path, data, limits, code):
    limits = traces.ImportLimits(*limits)
    path, store = put(tmp_path / "in", a=data), str(tmp_path / "store")
    outcome = traces.import_traces(spark, path, store, limits).collect()
    assert [o.code for o in outcome] == [code]
    assert traces.stored(spark, store, "runs", schemas.RUNS).count() == (code is None)


@pytest.mark.parametrize("bad", [b'{"a":1} x', b'{"a":NaN}', b"[1]", b'{"a":1,}', b"{", b"\xff", b'{"a":' + b"[" * 70 + b"]" * 70 + b"}"])
def test_strict_json(spark, tmp_path, bad):
    assert [d.code for d in imported(spark, put(tmp_path / "in", a=bad)).diagnostics.collect()] == ["INVALID_JSON"]


def test_last_of_repeated_keys_counts(spark, tmp_path):
    assert imported(spark, put(tmp_path / "in", a=b'{"actor":"x","actor":"y"}')).events.first().actor == "y"


def test_twice_is_duplicate_and_a_stream_adds_the_rest(spark, tmp_path):
    line = json.dumps({"kind": "Message"}).encode()
    path, store = put(tmp_path / "in", a=line, b=line, c=line + b"\n"), str(tmp_path / "store")
    outcomes = traces.import_traces(spark, path, store).collect()
    assert sorted(o.outcome for o in outcomes) == ["Duplicate", "Imported", "Imported"]
    assert {o.outcome for o in traces.import_traces(spark, path, store).collect()} == {"Duplicate"}
    put(tmp_path / "in", d=line + b"\n\n")
    import_traces_stream(spark, path, store).awaitTermination()
    import_traces_stream(spark, path, store).awaitTermination()
    assert traces.stored(spark, store, "runs", schemas.RUNS).count() == 3
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 3


def test_a_stream_stores_each_outcome_once(spark, tmp_path):
    line, store = b'{"kind":"Message"}', str(tmp_path / "store")
    path = put(tmp_path / "in", a=line, b=line, c=line + b"\nx", d=b'{"actor":"a long record of the agent"}', e=line * 9)
    limits = traces.ImportLimits(100, 30, 100, 100)
    import_traces_stream(spark, path, store, limits).awaitTermination()
    rows = lambda: sorted((r.path[-7:-6], r.outcome, r.code or "", r.batch) for r in traces.stored(spark, store, "outcomes", schemas.OUTCOMES).collect())
    expected = [
        ("a", "Imported", "", 0), ("b", "Duplicate", "", 0), ("c", "Partial", "", 0), ("d", "Rejected", "RECORD_BYTES_LIMIT", 0),
        ("e", "Rejected", "TOTAL_BYTES_LIMIT", 0),
    ]
    assert rows() == expected
    (tmp_path / "store" / "_stream" / "commits" / "0").unlink()  # as if the batch had failed at its end
    (tmp_path / "store" / "_stream" / "commits" / ".0.crc").unlink(missing_ok=True)
    import_traces_stream(spark, path, store, limits).awaitTermination()
    assert rows() == expected
    put(tmp_path / "in", f=line)
    import_traces_stream(spark, path, store, limits).awaitTermination()
    assert rows() == [*expected, ("f", "Duplicate", "", 1)]


def test_empty_files_are_runs(spark, tmp_path):
    made = imported(spark, put(tmp_path / "in", a=b"", b=b"\n"))
    assert made.events.count() == 0 and sorted(r.name for r in made.runs.collect()) == ["a.jsonl", "b.jsonl"]
    assert {o.outcome for o in made.outcomes.collect()} == {"Imported"}


def test_line_feeds_alone_take_no_room(spark, tmp_path):
    data = b"\n" * (32 << 20) + b'{"actor":"a"}\n' + b"\r\n" * 1000 + b'{"actor":"b"}'
    events = imported(spark, put(tmp_path / "in", a=data)).events.orderBy("sequence").collect()
    assert [(e.actor, e.source.line, e.source.byte_offset) for e in events] == [
        ("a", (32 << 20) + 1, 32 << 20), ("b", (32 << 20) + 1002, (32 << 20) + 14 + 2000),
    ]


def test_many_bad_records_are_rejected(spark, tmp_path):
    path = put(tmp_path / "in", a=b"x\n" * 100_001 + b"y" * 5_000_000)
    outcome = traces.import_traces(spark, path, str(tmp_path / "store")).collect()
    assert [(o.outcome, o.code) for o in outcome] == [("Rejected", "RECORD_COUNT_LIMIT")]


@pytest.mark.parametrize("fails_at", ["events", "diagnostics", "runs"])
def test_a_failed_import_can_be_repeated(spark, tmp_path, fails_at, monkeypatch):
    path, store = put(tmp_path / "in", a=b'{"actor":"a"}\n{"actor":"b"}\nx'), str(tmp_path / "store")
    made = traces.import_files(traces.read_trace_files(spark, path), traces.stored(spark, store, "runs", schemas.RUNS))
    for name, rows in (("events", made.events), ("diagnostics", made.diagnostics), ("event_index", made.event_index), ("runs", made.runs)):
        if name == fails_at:
            break
        rows.withColumn("import_id", F.lit("0")).write.mode("append").parquet(f"{store}/{name}")
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 0
    for outcome in ("Partial", "Duplicate"):
        assert [o.outcome for o in traces.import_traces(spark, path, store).collect()] == [outcome]
        count = lambda name, schema: traces.stored(spark, store, name, schema).count()
        assert (count("events", schemas.EVENTS), count("diagnostics", schemas.DIAGNOSTICS), count("event_index", schemas.EVENT_INDEX)) == (2, 1, 2)


def test_imports_beside_each_other_count_once(spark, tmp_path):
    path, store = put(tmp_path / "in", a=b'{"actor":"a"}', b=b'{"actor":"b"}'), str(tmp_path / "store")
    for number in ("2", "1", "3"):  # each before the others have stored a run
        made = traces.import_files(traces.read_trace_files(spark, path), spark.createDataFrame([], schemas.RUNS))
        traces.store_import(made, store, number)
    assert traces.stored(spark, store, "runs", schemas.RUNS).count() == 2
    assert traces.stored(spark, store, "events", schemas.EVENTS).count() == 2


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "store" / "runs").mkdir(parents=True)
    (tmp_path / "store" / "runs" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        traces.stored(spark, str(tmp_path / "store"), "runs", schemas.RUNS).collect()
