"""Store audit, field checks, candidates, contracts on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runlore.functions import strict_json
from runlore.operators import audit, candidates, contracts
from runlore.operators.analysis import latest_analysis
from runlore.sources import schemas

RUN = "00000000-0000-0000-0000-00000000000a"


def guid(i):
    return f"00000000-0000-0000-0000-{i:012d}"


def events(spark, rows):
    """rows: (sequence, payload, summary)."""
    data = []
    for i, payload, summary in rows:
        source = ("generic-jsonl", "0" * 64, "a.jsonl", 0, 1, "/")
        tool = json.loads(payload).get("tool") if payload.startswith("{") else None
        data.append((guid(i + 1), RUN, i, "2026-01-01T00:00:00Z", None, "ToolCall", "agent", summary, payload, tool, source, [], "1" * 64))
    return spark.createDataFrame(data, schemas.EVENTS)


def runs(spark):
    return spark.createDataFrame([(RUN, "a", "0" * 64, "generic-jsonl", "1.0.0", None)], schemas.RUNS)


def test_sound_store_has_no_violations(spark):
    e = events(spark, [(0, "{}", "a"), (1, "[1]", None)])
    index = e.select("run_id", "sequence", "event_id", "kind", "content_sha256")
    assert audit.audit_store(runs(spark), e, index).count() == 0
    assert all(r.violations == [] for r in audit.validate_events(e).collect())
    assert audit.audit_store(runs(spark).filter("false"), e, index).select("code").distinct().collect()[0].code == "ORPHAN_INDEX"


def test_defects(spark):
    e = events(spark, [(0, "{}", "a"), (1, "{}", "b")])
    index = e.select("run_id", "sequence", "event_id", "kind", "content_sha256")
    twice = index.unionByName(index.filter("sequence = 0").withColumn("sequence", F.lit(5).cast("bigint")))
    codes = {r.code for r in audit.audit_store(runs(spark), e, twice).collect()}
    assert codes == {"COUNT_MISMATCH", "DUPLICATE_EVENT_ID", "SEQUENCE_GAP", "PARITY"}


@pytest.mark.parametrize(
    ("text", "sound"),
    [("2026-01-01T00:00:00+14:00", True), ("2026-01-01T00:00:00+14:01", False), ("2026-01-01T00:00:00+23:00", False), ("2026-01-01", False), ("2026-01-01T00:00:00.1234567Z", True)],
)
def test_timestamps(spark, text, sound):
    e = events(spark, [(0, "{}", "a")]).withColumn("ts_text", F.lit(text))
    assert ("TIMESTAMP" in audit.validate_events(e).first().violations) != sound


def test_preflight(spark):
    rows = spark.createDataFrame([("x" * 10,), ("y" * 5,)], "data_json string")
    assert audit.preflight(rows).first().code is None
    assert audit.preflight(rows, limits=audit.PreflightLimits(runs=1)).first().code == "RUN_COUNT_LIMIT"
    assert audit.preflight(rows, limits=audit.PreflightLimits(run_bytes=9)).first().code == "RUN_BYTES_LIMIT"
    assert audit.preflight(rows.filter("false")).first().runs == 0


@pytest.mark.parametrize(("text", "code"), [('{"id":1,"id":2}', "INVALID_JSON"), ('{"x":NaN}', "INVALID_JSON"), ('{"x":1}', "UNKNOWN_KEYS"), (None, "INVALID_JSON")])
def test_stored_json(spark, text, code):
    rows = runs(spark).withColumn("data_json", F.lit(text).cast("string"))
    assert [r.code for r in audit.load_run_json(rows)[2].collect()] == [code]


def test_stored_json_loads(spark):
    e = {
        "id": guid(1), "runId": RUN, "sequence": 0, "timestamp": "2026-01-01T00:00:00Z", "kind": "Message", "actor": "a", "summary": None, "payload": {"tool": "read", "n": 1.50},
        "source": {"adapter": "generic-jsonl", "inputSha256": "0" * 64, "relativePath": "a", "byteOffset": 0, "line": 1, "jsonPointer": "/"}, "artifacts": [], "contentSha256": "1" * 64,
    }
    run = {"id": RUN, "name": "a", "inputSha256": "0" * 64, "adapter": "generic-jsonl", "adapterVersion": "1.0.0", "importedAt": "x", "events": [e], "diagnostics": []}
    loaded, said, bad = audit.load_run_json(runs(spark).withColumn("data_json", F.lit(json.dumps(run))))
    assert bad.count() == 0 and said.count() == 0 and loaded.first().tool == "read" and loaded.first().source.line == 1


OPTIONS = candidates.ExportOptions("live", "CC0", before=1, after=1)


def test_candidates_are_redacted_and_have_context(spark, tmp_path):
    e = events(spark, [(0, '{"tool":"read","n":1.50}', "mail a@b.co"), (1, '["x"]', None), (2, "3", "Bearer abcdefgh123")])
    gated = candidates.candidate_gate(candidates.build_candidates(runs(spark), e, OPTIONS)).cache()
    rows = gated.orderBy("sequence").collect()
    assert [len(r.context_before) for r in rows] == [0, 1, 1] and [len(r.context_after) for r in rows] == [1, 1, 0]
    assert all(r.error_code is None for r in rows) and '"n":1.5' in rows[0].event_text and rows[0].tool_name == "read"
    written = candidates.write_candidates(gated, str(tmp_path / "out"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert written == 3 and "a@b.co" not in text and "abcdefgh123" not in text and "<REDACTED:EMAIL:1>" in text
    assert all(r.violations == [] for r in contracts.validate_candidates(gated).collect())
    changed = contracts.validate_candidates(gated.withColumn("event_text", F.lit("other")))
    assert all(r.violations == ["EXAMPLE_ID"] for r in changed.collect())
    again = candidates.candidate_gate(candidates.build_candidates(runs(spark), e.repartition(3), OPTIONS))
    assert {r.example_id for r in again.collect()} == {r.example_id for r in rows}


def test_expressions_gate_as_the_engine_does(spark):
    """Candidates of texts joined at random: those that Spark gates alone and the others have what the engine makes of them."""
    from runlore.functions.redaction import Redactor

    rng = random.Random(5)
    bits = ["plain", "é\u2028", "\U0001f600", '"', "\\", "\n\t\r\b\f", "\x7f", "/", " ", "\x1b", "a@b.co", "x=1", "GH", "+1 (212) 555-0100", "password = secret word", "C:\\Users\\ann"]
    text = lambda: "".join(rng.choice(bits[: rng.choice([8, 9, 10, len(bits)])]) for _ in range(rng.randrange(4)))
    rows = []
    for i in range(300):
        context = lambda k: [{"event_id": f"{k}{n}" if rng.random() < 0.95 else "e", "event_text": text(), "event_kind": "Message", "tool_name": rng.choice([None, text()])} for n in range(rng.randrange(3))]
        row = dict.fromkeys(candidates.FIELDS, "x") | {
            "event_id": "e", "context_before": context("b"), "context_after": context("a"), "event_text": rng.choice([None, text(), text()]), "tool_name": rng.choice([None, "t"]),
            "source_category": rng.choice(["live"] * 9 + ["other", None]), "redaction_version": rng.choice(["redaction-v1"] * 9 + ["redaction-v2", None]), "license_or_consent": rng.choice(["CC0"] * 9 + ["", None]),
        }
        rows.append(row | {"source_hash": str(i)})
    df = spark.createDataFrame(rows, candidates.CANDIDATE)
    got = {r.n: r for r in candidates.candidate_gate(df.withColumn("sequence", F.col("source_hash").cast("bigint"))).withColumnRenamed("sequence", "n").collect()}
    codes, redactor = set(), Redactor()
    for i, row in enumerate(rows):
        want, code = candidates.gate(row, redactor)
        made = got[i].asDict(recursive=True)
        assert made.pop("n") == i and made.pop("error_code") == code
        assert made == (want or dict.fromkeys(made)), row
        codes.add(code)
    assert codes >= {None, "GATE_FAILED", "INVALID_CANDIDATE"}
    assert 60 < df.filter(candidates._plain_candidate(candidates.canonical_by_spark())).count() < 300
    sound = candidates.candidate_gate(df.withColumn("imported_at", F.lit(0)).withColumn("sequence", F.lit(0))).filter("error_code is null")
    assert all("EXAMPLE_ID" not in r.violations for r in contracts.validate_candidates(sound).collect())
    lines = sorted(r.value for r in candidates.candidate_json(sound).collect())
    assert lines == sorted(strict_json.canonical(candidates._plain(r.asDict(recursive=True))) for r in sound.select("example_id", *candidates.FIELDS).collect())


def test_export_fails_closed(spark, tmp_path):
    e = events(spark, [(0, "{}", "APP_PASSWORD=" + "x" * 5000), (1, "{}", "fine")])
    e = e.withColumn("summary", F.concat(F.lit("\n"), "summary"))
    raw = candidates.build_candidates(runs(spark), e, OPTIONS).withColumn("event_text", F.when(F.col("sequence") == 0, "A_TOKEN=" + "y" * 5000).otherwise(F.col("event_text")))
    gated = candidates.candidate_gate(raw)
    assert {r.error_code for r in gated.collect()} == {"SCAN_FAILED", None}
    with pytest.raises(ValueError):
        candidates.write_candidates(gated, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    for bad in ({"mode": "online"}, {"before": 65}, {"source_category": "other"}, {"license_or_consent": " "}):
        with pytest.raises(ValueError):
            candidates.ExportOptions(**({"source_category": "live", "license_or_consent": "CC0", "after": 1} | bad)).validate()


def example(spark, **changes):
    base = {
        "example_id": "0" * 64, "event_id": "e1", "context_before": [], "context_after": [], "label": "Plan", "label_status": "teacher_single", "confidence": 0.5,
        "evidence_event_ids": ["e1"], "observable_reason": "r", "split": "train", "quarantine_reason": None, "source_category": "live",
    } | dict.fromkeys(contracts.TEACHER_FIELDS, "t")
    types = {"context_before": f"array<{schemas.CONTEXT}>", "context_after": f"array<{schemas.CONTEXT}>", "confidence": "double", "evidence_event_ids": "array<string>"}
    row = base | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in row))


QUARANTINED = {"label": None, "label_status": "quarantined", "confidence": None, "evidence_event_ids": [], "observable_reason": None, "split": None, "quarantine_reason": "q"}


@pytest.mark.parametrize(
    ("changes", "violations"),
    [
        ({}, []), (QUARANTINED, []), ({"label": None}, ["STATE"]), (QUARANTINED | {"label": "Plan"}, ["STATE"]), ({"evidence_event_ids": ["e1", "e1"]}, ["EVIDENCE"]),
        ({"evidence_event_ids": ["other"]}, ["EVIDENCE"]), ({"label_status": "rule_derived"}, ["PROVENANCE"]), ({"confidence": 1.5}, ["CONFIDENCE"]), ({"split": "dev"}, ["SPLIT"]),
    ],
)
def test_examples(spark, changes, violations):
    assert contracts.validate_examples(example(spark, **changes)).first().violations == violations


def test_partial_provenance(spark):
    """All 62 masks of provenance that are neither complete nor absent."""
    rows = None
    for mask in range(1, 63):
        given = {f: "t" if mask >> i & 1 else None for i, f in enumerate(contracts.TEACHER_FIELDS)}
        one = example(spark, **given)
        rows = one if rows is None else rows.union(one)
    assert all("PROVENANCE" in r.violations for r in contracts.validate_examples(rows).collect())


def test_manifest(spark):
    rows = example(spark).union(example(spark, split="test", source_category="fake")).union(example(spark, **QUARANTINED))
    manifest = contracts.build_manifest(rows, 5)
    m = manifest.first()
    assert (m.completed_count, m.accepted_count, m.quarantined_count) == (3, 2, 1) and m.split_counts == {"train": 1, "validation": 0, "test": 1}
    assert m.split_source_counts["test"] == {"fake": 1, "fixture": 0, "live": 0} and m.status_counts["quarantined"] == 1 and len(m.class_counts) == 6
    files = spark.createDataFrame([("a/b.jsonl", "0" * 64, 1)], "path string, sha256 string, byte_size bigint")
    given = {v: "1" for v in contracts.VERSIONS}
    whole = contracts.complete_manifest(manifest, files, given, F.lit("2026-01-01").cast("timestamp"))
    assert sorted(whole.columns) == sorted(contracts.MANIFEST)
    assert whole.first().created_at == "2026-01-01T00:00:00Z"
    assert contracts.validate_manifest(whole).first().violations == []
    defects = {
        "LIFECYCLE": {"requested_count": F.lit(1).cast("bigint")}, "FILES": {"files": F.transform("files", lambda f: f.withField("path", F.lit("con.txt")))},
        "PATHS": {"files": F.concat("files", F.transform("files", lambda f: f.withField("path", F.lit("A/b.jsonl"))))}, "TOTALS": {"accepted_count": F.lit(1).cast("bigint")},
    }
    for column in ("files", "manifest_id", "created_at", "prompt_version"):
        assert "FIELDS" in contracts.validate_manifest(whole.drop(column)).first().violations
    assert {"FIELDS", "FILES", "PATHS", "MANIFEST_ID"} <= set(contracts.validate_manifest(manifest).first().violations)
    for code, change in defects.items():
        assert code in contracts.validate_manifest(whole.withColumns(change)).first().violations
    assert contracts.build_manifest(rows.filter("false"), 0).first().completed_count == 0


def test_latest_of_equal_times(spark):
    rows = spark.createDataFrame([("r", 1, 0, "a"), ("r", 1, 1, "b"), ("r", 0, 9, "c")], "run_id string, created_at int, ingest_ordinal int, analysis_id string")
    assert latest_analysis(rows).first().analysis_id == "b"


def test_tool_names(spark):
    rows = spark.createDataFrame([('{"tool":"a"}',), ('{"tool":1}',), ("[]",), ("3",), ("null",), ('{"x":1}',), (None,)], "payload string")
    assert [r.t for r in rows.select(candidates.tool_name().alias("t")).collect()] == ["a"] + [None] * 6


def test_canonical_json():
    assert strict_json.canonical({"b": 1.0, "a": "é"}) == '{"a":"é","b":1.0}'
    assert list(strict_json.members(' {"a" : 1.50 , "b":{"c": [1, 2]}} '))[0][2] == "1.50"
    for bad in ("", "[]", "{", '{"a"}', '{"a":1 "b":2}', '{,}', '{"a":1}}'):
        with pytest.raises(strict_json.BadJson):
            list(strict_json.members(bad))


def test_manifest_files_have_relative_paths(spark, tmp_path):
    for name in ("a/x.jsonl", "b/x.jsonl", "x.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = lambda *x: sorted(r.path for r in contracts.manifest_files(spark, *x).collect())
    assert listed(str(tmp_path)) == ["a/x.jsonl", "b/x.jsonl", "x.jsonl"] == listed(f"{tmp_path}/", str(tmp_path))
    assert listed(f"{tmp_path}/*/*.jsonl") == ["a/x.jsonl", "b/x.jsonl"] and listed(f"{tmp_path}/a", str(tmp_path)) == ["a/x.jsonl"]
