"""Documents pulled apart from their bytes, loaded runs, and the audit of a store in one pass."""

import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from runlore.functions import strict_json
from runlore.functions.json_reader import Reader
from runlore.operators import audit
from tests.test_store import RUN, events, guid, runs

KNOWN = (RUN, "0" * 64, "generic-jsonl", "1.0.0")


def event(**changes):
    source = {"adapter": "generic-jsonl", "inputSha256": "0" * 64, "relativePath": "a", "byteOffset": 0, "line": 1, "jsonPointer": "/"}
    return {
        "id": guid(1), "runId": RUN, "sequence": 0, "timestamp": "2026-01-01T00:00:00Z", "kind": "Message", "actor": "a", "summary": None,
        "payload": {"tool": "read"}, "source": source, "artifacts": [], "contentSha256": "1" * 64,
    } | changes


def run(**changes):
    return {
        "id": RUN, "name": "a", "inputSha256": "0" * 64, "adapter": "generic-jsonl", "adapterVersion": "1.0.0", "importedAt": "x", "events": [event()],
        "diagnostics": [{"line": 1, "byteOffset": 0, "code": "INVALID_JSON", "message": "m"}],
    } | changes


def pulled(data):
    """The value of a document by the reader, each part pulled by itself."""

    def part(at):
        if at.opens(b"{"):
            return {k: part(at) for k in at.members()}
        return [part(at) for _ in at.elements()] if at.opens(b"[") else at.value()

    reader = Reader(data)
    value = part(reader)
    reader.end()
    return value


def outcome(read, data):
    try:
        return read(data)
    except (strict_json.BadJson, UnicodeDecodeError):
        return "bad"


def test_the_reader_takes_what_strict_json_takes():
    draw = random.Random(5)
    texts = ['{"a":[1,2.5,{"b":"x\\"}]"}],"c":{},"d":[],"e":null}', ' [ true , "\\\\" , [ [ ] ] ] ', '"é\\u00e9{"', "12", '{"a":1,"a":2}', '[{"x":{"y":1,"y":2}}]', "[NaN]", "", "[1,]", "{,}", '{"a" 1}', "[1 2]", "[}", '{"a":1}}', '{1:2}']
    for text in list(texts[:6]):
        for _ in range(400):
            at, new = draw.randrange(len(text) + 1), draw.choice(['"', "{", "}", "[", "]", ",", ":", "\\", " ", "1", "é", ""])
            texts.append(text[:at] + new + text[at + draw.randrange(2) :])
    for text in texts:
        data = text.encode()
        assert outcome(pulled, data) == outcome(pulled, memoryview(data)) == outcome(strict_json.loads, text), text
        assert outcome(lambda d: [(r := Reader(d)).value(), r.end()][0], data) == outcome(strict_json.loads, text), text


@pytest.mark.parametrize(("document", "code"), [
    (run(), None), (run(events=[]), None), (run(extra=1), "UNKNOWN_KEYS"), (run(events=[event(), event(more=1)]), "UNKNOWN_KEYS"), (run(events={}), "UNKNOWN_KEYS"), ([], "UNKNOWN_KEYS"),
    (run(diagnostics=[{}]), "UNKNOWN_KEYS"), (run(adapterVersion="2"), "METADATA"), (run(id=1), "METADATA"), (run(name=None), "FIELDS"), (run(events=[event(sequence="0")]), "FIELDS"),
    (run(events=[event(sequence=True)]), "FIELDS"), (run(events=[event(sequence=1 << 63)]), "FIELDS"), (run(events=[event(summary="\ud800")]), "FIELDS"), (run(events=[event(artifacts=None)]), "FIELDS"),
])
def test_codes_of_documents(document, code):
    assert audit.run_violation(json.dumps(document).encode(), KNOWN) == code


def test_codes_of_texts_and_import_times():
    whole = json.dumps(run())
    for bad in (whole[:-1], whole + "x", whole.replace('"read"', "1e999"), whole.replace('"line": 1,', '"line": 1, "line": 1,'), "", "\xff"):
        assert audit.run_violation(bad.encode("latin-1"), KNOWN) == "INVALID_JSON"
    assert audit.run_violation(whole.encode(), (*KNOWN, "x")) is None
    assert audit.run_violation(whole.encode(), (*KNOWN, "y")) == "METADATA"


def test_runs_are_loaded_in_batches(spark):
    many = [event(sequence=i, summary="é" * 50) for i in range(4_500)]
    rows = spark.createDataFrame([(*KNOWN, json.dumps(run(events=many))), (*KNOWN[:3], "2", json.dumps(run())), (*KNOWN, None)], "run_id string, input_sha256 string, adapter string, adapter_version string, data_json string")
    found, said, bad = audit.load_run_json(rows)
    assert found.agg(F.count("*"), F.count_distinct("sequence"), F.max("sequence"), F.count("timestamp"), F.max("tool")).first() == (4_500, 4_500, 4_499, 4_500, "read")
    assert [tuple(r) for r in said.collect()] == [(RUN, 1, 0, "INVALID_JSON", "m")]
    assert sorted(r.code for r in bad.collect()) == ["INVALID_JSON", "METADATA"]


def test_a_large_document_takes_little_memory():
    """Its bytes, and one part of it at a time: a process with nothing else stays under 200 MB."""
    code = """
import resource
from runlore.functions.json_reader import Reader
one = b'{"id":"x","payload":{"k":[1,2,{"t":"%s"}]},"source":{"line":1}}' % (b"y" * 900)
data = b'{"events":[' + b",".join([one] * ((64 << 20) // len(one))) + b'],"id":1}'
run, n = Reader(data), 0
for key in run.members():
    if key == "events":
        for _ in run.elements():
            n += run.value()["source"]["line"]
    else:
        run.value()
run.end()
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    n, kilobytes = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split())
    assert n > 60_000 and kilobytes < 200 << 10


def test_the_audit_deals_rows_out_once(spark):
    e = events(spark, [(0, "{}", "a"), (1, "{}", "b"), (2, "{}", "c")])
    found = audit.audit_store(runs(spark), e, e.select("run_id", "sequence", "event_id", "kind", "content_sha256"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") <= 3
    assert found.count() == 0


def test_the_audit_finds_each_defect_once(spark):
    e = events(spark, [(i, "{}", "a") for i in range(6)])
    index = e.select("run_id", "sequence", "event_id", "kind", "content_sha256")
    codes = lambda *sides: sorted((r.sequence, r.code) for r in audit.audit_store(runs(spark), *sides).filter("sequence is not null").collect())
    assert codes(e, index.filter("sequence <> 2")) == [(2, "PARITY"), (3, "SEQUENCE_GAP")]
    assert codes(e, index.unionByName(index.filter("sequence = 1"))) == [(1, "DUPLICATE_EVENT_ID"), (1, "PARITY"), (1, "SEQUENCE_GAP")]
    same_id = index.withColumn("event_id", F.when(F.col("sequence") < 3, F.lit(guid(1))).otherwise(F.col("event_id")))
    assert codes(e, same_id) == [(0, "DUPLICATE_EVENT_ID"), (1, "PARITY"), (2, "PARITY")]
    foreign = e.withColumn("source", F.when(F.col("sequence") == 4, F.col("source").withField("adapter", F.lit(None).cast("string"))).otherwise(F.col("source")))
    assert codes(foreign, index) == [(4, "SOURCE_MISMATCH")]
    other = index.unionByName(index.filter("sequence = 0").withColumn("run_id", F.lit(guid(77))))
    assert codes(e, other) == [(0, "ORPHAN_INDEX")]
