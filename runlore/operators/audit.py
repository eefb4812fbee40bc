"""Checks of stored tables against each other and of their fields."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import strict_json
from ..functions.json_reader import Reader
from ..sources.schemas import EVENT_KINDS

GUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NIL_GUID = "00000000-0000-0000-0000-000000000000"
SHA256 = "^[0-9a-f]{64}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,7})?(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)$"


def audit_store(runs: DataFrame, events: DataFrame, event_index: DataFrame) -> DataFrame:
    """One row per violation: run_id, sequence (null for a whole run), code.

    ORPHAN_INDEX: an index row without a run; COUNT_MISMATCH: a run's events and index rows differ in number;
    DUPLICATE_EVENT_ID and SEQUENCE_GAP within a run's index; PARITY: at a place of a run, events and index rows differ or
    one side is missing (once for each place, repeats count); SOURCE_MISMATCH: an event's source hash or adapter is not
    its run's. Runs are unique by run_id.

    The three sides are one narrow table that is dealt out by run_id once; all checks are windows within a run (of at most
    100,000 events by the import limits), on two local orders."""
    compared = ("event_id", "kind", "content_sha256")
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = runs.select("run_id", F.lit(None).cast("bigint").alias("sequence"), F.lit("run").alias("side"), *map(none, compared), "input_sha256", "adapter")
    rows = rows.unionByName(events.select(
        "run_id", "sequence", F.lit("event").alias("side"), *compared, F.col("source.input_sha256").alias("input_sha256"), F.col("source.adapter").alias("adapter")
    ))
    rows = rows.unionByName(event_index.select("run_id", "sequence", F.lit("index").alias("side"), *compared, none("input_sha256"), none("adapter")))
    run, event, index = (F.col("side") == x for x in ("run", "event", "index"))
    whole, order = Window.partitionBy("run_id"), ("sequence", *compared)
    so_far = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_place = Window.partitionBy("run_id", "sequence").orderBy(*compared).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("run_id", *order)
    count = lambda what, w: F.count_if(what).over(w)
    rows = rows.repartition("run_id").withColumns({
        "own": F.max(F.when(run, F.struct("input_sha256", "adapter"))).over(whole), "events": count(event, whole), "indexed": count(index, whole),
        "misplaced": index & (count(index, so_far) - 1 != F.col("sequence")), "uneven": (~run) & (count(event, same) != count(index, same)),
    }).withColumns({"gaps": count(F.col("misplaced"), so_far), "unlike": count(F.col("uneven"), at_place)})
    ids = Window.partitionBy("run_id", "event_id", "side").orderBy("sequence")
    rows = rows.withColumn("twice", index & (F.row_number().over(ids) == 1) & F.lead("side").over(ids).isNotNull())
    known, source = F.col("own").isNotNull(), F.struct("input_sha256", "adapter")
    wrong = {
        "ORPHAN_INDEX": index & ~known, "COUNT_MISMATCH": run & (F.col("events") != F.col("indexed")),
        "DUPLICATE_EVENT_ID": F.col("twice"), "SEQUENCE_GAP": F.col("misplaced") & (F.col("gaps") == 1),
        "PARITY": known & F.col("uneven") & (F.col("unlike") == 1), "SOURCE_MISMATCH": event & known & ~F.col("own").eqNullSafe(source),
    }
    codes = F.filter(F.array(*[F.when(what, F.lit(name)) for name, what in wrong.items()]), lambda x: x.isNotNull())
    return rows.select("run_id", "sequence", F.explode(codes).alias("code"))


def _codes(checks: dict[str, Column]) -> Column:
    """The names of the checks that don't hold; a null verdict doesn't hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def validate_events(events: DataFrame) -> DataFrame:
    """event_id, run_id and violations (array of codes, empty if sound) of each event."""
    text = lambda c: F.length(F.trim(c)) > 0
    s = F.col("source")
    tool = F.get_json_object("payload", "$.tool")
    artifact = F.forall("artifacts", lambda a: a["name"].isNotNull() & (a["sha256"].isNull() | a["sha256"].rlike(SHA256)))
    checks = {
        "EVENT_ID": F.col("event_id").rlike(GUID) & (F.col("event_id") != NIL_GUID), "RUN_ID": F.col("run_id").rlike(GUID) & (F.col("run_id") != NIL_GUID),
        "SEQUENCE": F.col("sequence") >= 0, "KIND": F.col("kind").isin(*EVENT_KINDS),
        "TIMESTAMP": F.col("ts_text").rlike(TIMESTAMP) & F.col("ts_text").try_cast("timestamp").isNotNull(), "ACTOR": text("actor"),
        "CONTENT_HASH": F.col("content_sha256").rlike(SHA256), "SOURCE_HASH": s["input_sha256"].rlike(SHA256),
        "SOURCE": text(s["adapter"]) & text(s["relative_path"]) & (s["byte_offset"].isNull() | (s["byte_offset"] >= 0)) & (s["line"].isNull() | (s["line"] >= 1)),
        "ARTIFACTS": artifact, "TOOL": tool.isNull() | (F.col("tool") == tool),
    }
    return events.select("event_id", "run_id", _codes(checks).alias("violations"))


def validate_diagnostics(diagnostics: DataFrame) -> DataFrame:
    checks = {
        "LINE": F.col("line").isNull() | (F.col("line") >= 1), "BYTE_OFFSET": F.col("byte_offset").isNull() | (F.col("byte_offset") >= 0),
        "CODE": F.length(F.trim("code")) > 0, "MESSAGE": F.length(F.trim("message")) > 0,
    }
    return diagnostics.select("run_id", _codes(checks).alias("violations"))


@dataclass(frozen=True)
class PreflightLimits:
    runs: int = 100_000
    total_bytes: int = 512 << 20
    run_bytes: int = 64 << 20
    events: int = 100_000


def preflight(runs_json: DataFrame, event_count: int | None = None, limits: PreflightLimits = PreflightLimits()) -> DataFrame:
    """One row: runs, total_bytes, largest_bytes and code, which is null where stored runs (column data_json) are within
    limits. One aggregate, before any heavy work."""
    size = F.octet_length("data_json").cast("bigint")
    found = runs_json.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.max(size), F.lit(0)).alias("largest_bytes"))
    code = F.when(F.col("runs") > limits.runs, "RUN_COUNT_LIMIT").when(F.col("largest_bytes") > limits.run_bytes, "RUN_BYTES_LIMIT")
    code = code.when(F.col("total_bytes") > limits.total_bytes, "TOTAL_BYTES_LIMIT").when(F.lit(event_count or 0) > limits.events, "EVENT_COUNT_LIMIT")
    return found.withColumn("code", code)


RUN_KEYS = {"id", "name", "inputSha256", "adapter", "adapterVersion", "importedAt", "events", "diagnostics"}
EVENT_KEYS = {"id", "runId", "sequence", "timestamp", "kind", "actor", "summary", "payload", "source", "artifacts", "contentSha256"}
SOURCE_KEYS = {"adapter", "inputSha256", "relativePath", "byteOffset", "line", "jsonPointer"}
DIAGNOSTIC_KEYS = {"line", "byteOffset", "code", "message"}
ARTIFACT_KEYS = {"name", "path", "sha256"}
_SURROGATE = re.compile("[\ud800-\udfff]")


_DIAGNOSTIC = "line int, byte_offset bigint, code string, message string"
_ROWS, _BYTES = 2_000, 4 << 20


def load_run_json(runs_json: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, diagnostics and violations (run_id, code) of stored runs (run_id, input_sha256, adapter, adapter_version,
    data_json; imported_at is compared too where it is a text). A run with a violation yields nothing else: INVALID_JSON
    (not strict, a key repeats, a number is not finite), UNKNOWN_KEYS (missing or additional ones), FIELDS (a value of
    another type than its column's), METADATA (JSON and columns differ); the first of these that holds. A null document is
    not JSON.

    Events are pulled out of a document's bytes one by one, once to check the whole of it and once more to return them, so a
    worker holds a document's bytes, one event as objects and a batch of rows. Each of the three frames reads what it needs."""
    from ..sources.schemas import EVENTS
    from ..sources.traces import bounded_batches

    bounded_batches(runs_json.sparkSession)
    columns = ["run_id", "input_sha256", "adapter", "adapter_version"]
    if dict(runs_json.dtypes).get("imported_at") == "string":
        columns.append("imported_at")
    documents = runs_json.select(*columns, F.col("data_json").cast("binary").alias("data_json"))
    event = T.StructType([f for f in T.StructType.fromDDL(EVENTS) if f.name != "timestamp"])
    read = lambda what, schema: documents.mapInArrow(_reader(what, to_arrow_schema(schema)), schema)
    events = read("events", event).withColumn("timestamp", F.col("ts_text").try_cast("timestamp")).select(*T.StructType.fromDDL(EVENTS).names)
    said = read("diagnostics", T.StructType.fromDDL(f"run_id string, {_DIAGNOSTIC}"))
    return events, said, read("violations", T.StructType.fromDDL("run_id string, code string"))


def _reader(what: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of documents that returns rows of one kind."""

    def batched(rows: Iterator[tuple[dict, int]]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for row, length in rows:
            part.append(row)
            size += length
            if len(part) == _ROWS or size >= _BYTES:
                yield pa.RecordBatch.from_pylist(part, schema=schema)
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for b in batches:
            fields = [b.column(c).to_pylist() for c in b.schema.names[:-1]]
            for known, document in zip(zip(*fields, strict=True), b.column("data_json"), strict=True):
                data = memoryview(document.as_buffer()) if document.is_valid else b""
                code = run_violation(data, known)
                if what == "violations":
                    if code:
                        yield {"run_id": known[0], "code": code}, 0
                elif not code:
                    yield from _event_rows(data) if what == "events" else _diagnostic_rows(data, known[0])

    return lambda batches: batched(rows(batches))


_KNOWN_AS = ("id", "inputSha256", "adapter", "adapterVersion", "importedAt")


def run_violation(data, known: tuple) -> str | None:
    """The code of what is wrong with a stored run's document (bytes or a buffer), or none. known: its run_id, input_sha256,
    adapter, adapter_version and, if it is to be compared, imported_at."""
    said, keys, sound, typed = {}, set(), True, True
    run = Reader(data)
    try:
        if not run.opens(b"{"):
            run.value()
            run.end()
            return "UNKNOWN_KEYS"
        for key in run.members():
            keys.add(key)
            if key in ("events", "diagnostics"):
                if not run.opens(b"["):
                    run.value()
                    sound = False
                    continue
                shape, fields = (_event_shape, _event_typed) if key == "events" else (_diagnostic_shape, _diagnostic_typed)
                for _ in run.elements():
                    x = run.value()
                    sound = sound and shape(x)
                    typed = typed and sound and fields(x)
            elif key in _KNOWN_AS:
                said[key] = run.value()
            else:
                name = run.value()
                typed = typed and (key != "name" or isinstance(name, str))
        run.end()
    except (ValueError, RecursionError):  # the canonical spelling finds numbers that JSON can spell and no float holds
        return "INVALID_JSON"
    if not sound or keys != RUN_KEYS:
        return "UNKNOWN_KEYS"
    if not typed:
        return "FIELDS"
    return None if [said[k] for k, _ in zip(_KNOWN_AS, known)] == list(known) else "METADATA"


def _event_shape(e: object) -> bool:
    return isinstance(e, dict) and set(e) == EVENT_KEYS and isinstance(e["source"], dict) and set(e["source"]) == SOURCE_KEYS


def _diagnostic_shape(d: object) -> bool:
    return isinstance(d, dict) and set(d) == DIAGNOSTIC_KEYS


def _texts(*values: object) -> bool:
    """Whether all are texts that UTF-8 can spell; lone surrogates can't be stored."""
    return all(isinstance(v, str) and (v.isascii() or not _SURROGATE.search(v)) for v in values)


def _whole(value: object, bits: int, null: bool = True) -> bool:
    return value is None and null or type(value) is int and -(1 << bits - 1) <= value < 1 << bits - 1


def _event_typed(e: dict) -> bool:
    s, artifacts = e["source"], e["artifacts"]
    if not (_texts(e["id"], e["runId"], e["timestamp"], e["kind"], e["actor"], e["contentSha256"], s["adapter"], s["inputSha256"], s["relativePath"])):
        return False
    if not (isinstance(artifacts, list) and all(isinstance(a, dict) and set(a) <= ARTIFACT_KEYS and _texts(*(v for v in a.values() if v is not None)) for a in artifacts)):
        return False
    optional = (x for x in (e["summary"], s["jsonPointer"]) if x is not None)
    return _texts(*optional, strict_json.canonical(e["payload"])) and _whole(e["sequence"], 64, False) and _whole(s["byteOffset"], 64) and _whole(s["line"], 32)


def _diagnostic_typed(d: dict) -> bool:
    return _texts(d["code"], d["message"]) and _whole(d["line"], 32) and _whole(d["byteOffset"], 64)


def _parts(data, wanted: str) -> Iterator[tuple[dict, int]]:
    """The elements of one of a sound run document's arrays, with their lengths in bytes."""
    run = Reader(data)
    for key in run.members():
        if key not in ("events", "diagnostics"):
            run.value()
            continue
        for _ in run.elements():
            start, x = run.at, run.value()
            if key == wanted:
                yield x, run.at - start


def _event_rows(data) -> Iterator[tuple[dict, int]]:
    for e, length in _parts(data, "events"):
        s, payload = e["source"], e["payload"]
        tool = payload.get("tool") if isinstance(payload, dict) and isinstance(payload.get("tool"), str) else None
        yield {
            "event_id": e["id"], "run_id": e["runId"], "sequence": e["sequence"], "ts_text": e["timestamp"], "kind": e["kind"], "actor": e["actor"],
            "summary": e["summary"], "payload": strict_json.canonical(payload), "tool": tool,
            "source": {"adapter": s["adapter"], "input_sha256": s["inputSha256"], "relative_path": s["relativePath"], "byte_offset": s["byteOffset"], "line": s["line"], "json_pointer": s["jsonPointer"]},
            "artifacts": e["artifacts"], "content_sha256": e["contentSha256"],
        }, length


def _diagnostic_rows(data, run_id: str) -> Iterator[tuple[dict, int]]:
    for d, length in _parts(data, "diagnostics"):
        yield {"run_id": run_id, "line": d["line"], "byte_offset": d["byteOffset"], "code": d["code"], "message": d["message"]}, length
