"""Analysis revisions of runs: labels, alerts and a content hash; appended, never changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import CLASSIFIER_ID, CLASSIFIER_VERSION, label_steps
from .detect import detect_all


@dataclass
class Analysis:
    """outcomes: a row per requested run; the others: rows of this revision."""

    outcomes: DataFrame
    analyses: DataFrame
    classifications: DataFrame
    alerts: DataFrame


def guid_from_hash(digest: Column) -> Column:
    """The first 16 bytes of a hex digest as a GUID that is built from bytes, the first three fields little-endian."""
    order = (7, 5, 3, 1, 11, 9, 15, 13)
    pairs = [F.substring(digest, i, 2) for i in order]
    return F.concat(
        *pairs[:4], F.lit("-"), *pairs[4:6], F.lit("-"), *pairs[6:], F.lit("-"), F.substring(digest, 17, 4), F.lit("-"), F.substring(digest, 21, 12)
    )


def analysis_content_hash(classifications: DataFrame, alerts: DataFrame) -> DataFrame:
    """run_id and content_sha256 over a run's classifications by sequence and alerts by ordinal; revision ids and times
    are no part of it, so equal analyses have equal hashes. A run is bounded by the import limits."""
    steps = classifications.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "event_id", "label", "confidence"))).alias("steps")
    )
    found = alerts.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "code", "severity", "start_sequence", "end_sequence", "evidence_event_ids"))).alias("alerts")
    )
    whole = F.to_json(F.struct("run_id", "steps", "alerts"))
    return steps.join(found, "run_id", "left").select("run_id", F.sha2(whole, 256).alias("content_sha256"))


def analyze_runs(runs: DataFrame, events: DataFrame, created_at: Column, requested: DataFrame | None = None) -> Analysis:
    """Labels and alerts of the requested runs (all of them without). The outcome of a run is Completed, NotFound (no
    such run) or NoEvents (no revision is made)."""
    wanted = (requested if requested is not None else runs).select("run_id").distinct()
    labelled = label_steps(events.join(wanted, "run_id", "left_semi"))
    classifications = labelled.select(
        "run_id", "event_id", "sequence", "label", "confidence", F.array("event_id").alias("evidence_event_ids"),
    )
    alerts = detect_all(labelled)
    counts = labelled.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))
    known = runs.select("run_id", F.lit(True).alias("known"))
    outcomes = wanted.join(known, "run_id", "left").join(counts, "run_id", "left").select(
        "run_id", F.when(F.col("known").isNull(), "NotFound").when(F.col("events").isNull(), "NoEvents").otherwise("Completed").alias("outcome"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("event_count"),
    )
    hashes = analysis_content_hash(classifications, alerts)
    made = runs.withColumn("created_at", created_at).select("run_id", "created_at").join(hashes, "run_id")
    analyses = made.select(
        guid_from_hash(F.sha2(F.concat_ws(":", "run_id", "content_sha256", F.col("created_at").cast("string")), 256)).alias("analysis_id"),
        "run_id", F.lit("Completed").alias("status"), "created_at", F.lit(CLASSIFIER_ID).alias("classifier_id"),
        F.lit(CLASSIFIER_VERSION).alias("classifier_version"), "content_sha256", F.lit(None).cast("string").alias("failure"),
    )
    ids = analyses.select("run_id", "analysis_id")
    return Analysis(outcomes, analyses, classifications.join(ids, "run_id"), alerts.join(ids, "run_id"))


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """The newest revision of each run: the latest created_at, then the greatest ingest_ordinal. An aggregate, so that
    a long history is combined before the shuffle."""
    rest = [c for c in analyses.columns if c not in ("run_id", "created_at", "ingest_ordinal")]
    newest = F.max_by(F.struct("created_at", "ingest_ordinal", *rest), F.struct("created_at", "ingest_ordinal")).alias("x")
    return analyses.groupBy("run_id").agg(newest).select("run_id", "x.*").select(*analyses.columns)


def alert_index(alerts: DataFrame) -> DataFrame:
    """One narrow row per alert."""
    return alerts.select("analysis_id", "ordinal", "run_id", "code", "start_sequence", "end_sequence")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """code, alerts, runs: over all runs."""
    return alerts.groupBy("code").agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("run_id").alias("runs"))


def alerts_by_run(alerts: DataFrame) -> DataFrame:
    """run_id, code, alerts: what alert_summary tells, run by run."""
    return alerts.groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("alerts"))
