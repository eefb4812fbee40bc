"""Labels and alerts of small hand-made runs."""

import pytest
from pyspark.sql import functions as F

from runlore.operators import analysis, classify, detect, views

SCHEMA = "run_id string, sequence bigint, event_id string, kind string, summary string, payload string, content_sha256 string"


def run_of(spark, rows, run_id="r"):
    data = [(run_id, i, f"e{i}", kind, summary, "{}", content or f"h{i}") for i, (kind, summary, content) in enumerate(rows)]
    return classify.label_steps(spark.createDataFrame(data, SCHEMA))


GOLDEN = (
    [("ToolCall", "search repository", "same")] * 3 + [("Reasoning", "plan checklist", None)] * 3 + [("FileChange", "apply patch", None)]
    + [("Status", "success complete", None)] + [("Error", "retry after failure", None)] * 3 + [("Status", "success complete", None)]
)


@pytest.mark.parametrize(
    ("kind", "summary", "label"),
    [
        ("ToolCall", "search repository", "Explore"), ("Reasoning", "plan checklist", "Plan"), ("FileChange", "apply patch", "Execute"),
        ("ToolResult", "tests passed", "Verify"), ("ToolCall", "dotnet build verification", "Verify"), ("Error", "retry after failure", "Recover"),
        ("Message", "hello", "Unknown"), ("ToolCall", "read and edit", "Unknown"), (None, None, "Unknown"),
    ],
)
def test_labels(spark, kind, summary, label):
    assert [r.label for r in run_of(spark, [(kind, summary, None)]).collect()] == [label]


def test_confidences(spark):
    rows = run_of(spark, [("ToolCall", "search", None), ("Message", "hello", None), ("ToolCall", "read and edit", None)])
    assert [r.confidence for r in rows.orderBy("sequence").collect()] == [0.85, 0.25, 0.35]


def test_golden_run(spark):
    alerts = detect.detect_all(run_of(spark, GOLDEN)).orderBy("ordinal").collect()
    assert [(a.code[:6], a.severity, a.start_sequence, a.end_sequence, a.evidence_event_ids) for a in alerts] == [
        ("THX001", "Warning", 0, 2, ["e0", "e1", "e2"]), ("THX002", "Warning", 3, 5, ["e3", "e4", "e5"]), ("THX003", "Warning", 6, 11, ["e6", "e11"]),
        ("THX004", "Warning", 7, 8, ["e7", "e8"]), ("THX005", "Warning", 6, 10, ["e8", "e9", "e10"]), ("THX006", "Critical", 8, 10, ["e8", "e9", "e10"]),
    ]
    assert [a.ordinal for a in alerts] == list(range(6))


def test_below_thresholds_and_empty(spark):
    few = [("Reasoning", "plan", None)] * 2 + [("Error", "retry", None)] * 2
    assert detect.detect_all(run_of(spark, few)).count() == 0
    assert detect.detect_all(run_of(spark, few).filter("false")).count() == 0


def test_last_change_as_final_event_is_twice_in_the_evidence(spark):
    alert = detect.detect_verification_gap(run_of(spark, [("FileChange", "patch complete", None)])).first()
    assert alert.evidence_event_ids == ["e0", "e0"]


def test_one_shuffle(spark):
    plan = detect.detect_all(run_of(spark, GOLDEN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_equal_analyses_hash_equally(spark):
    steps = run_of(spark, GOLDEN)
    runs = spark.createDataFrame([("r", "n", "0" * 64, "a", "1")], "run_id string, name string, input_sha256 string, adapter string, adapter_version string")
    runs = runs.withColumn("imported_at", F.lit("2026-01-01").cast("timestamp"))
    events = steps.drop("label", "confidence")
    one = analysis.analyze_runs(runs, events, F.lit("2026-01-01").cast("timestamp")).analyses.first()
    two = analysis.analyze_runs(runs, events.repartition(3), F.lit("2026-02-01").cast("timestamp")).analyses.first()
    assert one.content_sha256 == two.content_sha256 and one.analysis_id != two.analysis_id


def test_pages_give_every_event_once(spark):
    events, seen, cursor = run_of(spark, GOLDEN), [], None
    while True:
        page = views.event_page(events, cursor, 5).orderBy("sequence").collect()
        seen += [r.sequence for r in page]
        cursor = page[0].next_cursor
        if cursor is None:
            break
    assert seen == list(range(12))
    with pytest.raises(ValueError):
        views.event_page(events, None, 201)


def test_reports_are_not_written_over(spark, tmp_path):
    reports = spark.createDataFrame([("<b>'&\"",)], "report string")
    views.write_reports(reports, str(tmp_path / "r"), "html")
    assert "&lt;b&gt;&#39;&amp;&quot;" in "".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    with pytest.raises(Exception):  # noqa: B017
        views.write_reports(reports, str(tmp_path / "r"), "html")
