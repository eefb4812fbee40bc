"""Read models over stored runs, events and analyses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analysis import latest_analysis
from .classify import label_count_maps, label_counts

# Fixed values.
DEFAULT_PAGE, MAX_PAGE = 50, 200
COMPARISON_NOTE = "Independent metrics; no semantic alignment is asserted."
DISCLAIMER = "Observed patterns are not causal proof."


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))


def run_counts(runs: DataFrame, events: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """runs with event_count and diagnostic_count, 0 where there are none."""
    joined = runs.join(_counts(events, "event_count"), "run_id", "left").join(_counts(diagnostics, "diagnostic_count"), "run_id", "left")
    return joined.fillna(0, ["event_count", "diagnostic_count"])


def list_runs(runs: DataFrame, events: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """All runs with counts, by import time, then id."""
    return run_counts(runs, events, diagnostics).orderBy("imported_at", "run_id")


def run_detail(
    run_ids: DataFrame, runs: DataFrame, events: DataFrame, diagnostics: DataFrame, analyses: DataFrame,
    classifications: DataFrame, alerts: DataFrame,
) -> DataFrame:
    """The wanted runs with counts, diagnostics, and id and counts of the latest analysis (null if there is none)."""
    only = lambda df: df.join(run_ids.select("run_id"), "run_id", "left_semi")
    latest = latest_analysis(only(analyses))
    steps = latest_rows(classifications, latest).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("classification_count"))
    found = latest_rows(alerts, latest).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("alert_count"))
    summary = latest.select("run_id", "analysis_id").join(steps, "analysis_id", "left").join(found, "analysis_id", "left")
    said = only(diagnostics).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("line", "byte_offset", "code", "message"))).alias("diagnostics"))
    return (
        run_counts(only(runs), only(events), only(diagnostics)).join(said, "run_id", "left")
        .join(summary.fillna(0, ["classification_count", "alert_count"]), "run_id", "left")
    )


def latest_rows(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """The rows (classifications or alerts) of the latest revisions."""
    return rows.join(latest.select("analysis_id"), "analysis_id", "left_semi")


def event_page(events: DataFrame, cursor: int | None = None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page of each run: events after the cursor in sequence, with next_cursor, which is null when none follow.
    Filter events to one run first and the filter reaches the scan."""
    if not 1 <= limit <= MAX_PAGE or cursor is not None and cursor < 0:
        raise ValueError("bad cursor or limit")
    w = Window.partitionBy("run_id").orderBy("sequence")
    ahead = events.filter(F.col("sequence") > (-1 if cursor is None else cursor)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit + 1)
    more = F.max("place").over(Window.partitionBy("run_id")) > limit
    last = F.max(F.when(F.col("place") <= limit, F.col("sequence"))).over(Window.partitionBy("run_id"))
    return ahead.withColumn("next_cursor", F.when(more, last)).filter(F.col("place") <= limit).drop("place")


def label_share(classifications: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, label, n, share: a label's count by the run's number of events."""
    return label_counts(classifications).join(_counts(events, "events"), "run_id").select(
        "run_id", "label", "n", (F.col("n") / F.col("events")).alias("share")
    )


def run_metrics(runs: DataFrame, events: DataFrame, classifications: DataFrame, alerts: DataFrame) -> DataFrame:
    """run_id, event_count, label_counts, alert_count; an empty map and 0 where a run has no analysis. The last two
    frames hold rows of latest revisions."""
    empty = F.create_map().cast("map<string,bigint>")
    return (
        runs.select("run_id").join(_counts(events, "event_count"), "run_id", "left").join(label_count_maps(classifications), "run_id", "left")
        .join(_counts(alerts, "alert_count"), "run_id", "left").fillna(0, ["event_count", "alert_count"])
        .withColumn("label_counts", F.coalesce("label_counts", empty))
    )


def compare_runs(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """For pairs(left_run_id, right_run_id): event counts, label maps and alert counts of both. A pair with a missing
    run is left out; a run may be compared with itself."""
    side = lambda s: metrics.select(*[F.col(c).alias(f"{s}_{c}") for c in ("run_id", "event_count", "label_counts", "alert_count")])
    return pairs.join(side("left"), "left_run_id").join(side("right"), "right_run_id").withColumn("note", F.lit(COMPARISON_NOTE))


def export_report(run_ids: DataFrame, runs: DataFrame, analyses: DataFrame, classifications: DataFrame, alerts: DataFrame) -> DataFrame:
    """Report envelopes of the wanted runs that have an analysis: run_id, content_identity_sha256, report (JSON)."""
    latest = latest_analysis(analyses).join(run_ids.select("run_id"), "run_id", "left_semi")
    steps = latest_rows(classifications, latest).groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "event_id", "label", "confidence"))).alias("classifications")
    )
    found = latest_rows(alerts, latest).groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "code", "severity", "start_sequence", "end_sequence", "evidence_event_ids", "explanation"))).alias("alerts")
    )
    identity = F.sha2(F.to_json(F.struct(F.col("input_sha256").alias("InputSha256"), F.col("content_sha256").alias("ContentSha256"))), 256)
    whole = runs.join(latest, "run_id").join(steps, "analysis_id", "left").join(found, "analysis_id", "left")
    run = F.struct("run_id", "name", "input_sha256", "adapter", "adapter_version", "imported_at")
    analysis = F.struct("analysis_id", "status", "created_at", "classifier_id", "classifier_version", "content_sha256", "classifications", "alerts")
    return whole.withColumn("content_identity_sha256", identity).select(
        "run_id", "content_identity_sha256",
        F.to_json(F.struct(
            F.lit("1.0").alias("schemaVersion"), run.alias("run"), analysis.alias("analysis"),
            F.lit(DISCLAIMER).alias("disclaimer"), F.col("content_identity_sha256").alias("contentIdentitySha256"),
        )).alias("report"),
    )


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rendered(kind: str) -> Column:
    """The column report as a line of JSON or an escaped HTML page."""
    if not re.fullmatch("json|html", kind):
        raise ValueError("reports are json or html")
    if kind == "json":
        return F.col("report")
    return F.concat(F.lit("<!doctype html><meta charset=\"utf-8\"><title>Trace report</title><pre>"), escape_html(F.col("report")), F.lit("</pre>"))


def write_reports(reports: DataFrame, path: str, kind: str = "json") -> None:
    """One line or page per report, as JSON or escaped HTML; an existing path is never written over. A file for each
    report: sources.report_files."""
    reports.select(rendered(kind).alias("value")).write.mode("errorifexists").text(path)
