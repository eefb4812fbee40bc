"""Patterns in the steps of a run: at most one alert, the first match, of each of six detectors.

All detectors share one window pass over (run, sequence) and one aggregation by run, which need the same distribution,
so a plan has one shuffle however many detectors run. Frames look at most four rows ahead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETECTOR_VERSION = "1.0.0"


def success_predicate(summary: Column | str = "summary") -> Column:
    """Whether a summary (null: empty) declares success."""
    text = F.lower(F.coalesce(F.col(summary) if isinstance(summary, str) else summary, F.lit("")))
    return text.contains("success") | text.contains("complete")


@dataclass(frozen=True)
class Detector:
    """found: an aggregate over a run's prepared rows, a struct of start, end and evidence, or null."""

    code: str
    severity: str
    parameters: dict[str, str]
    explanation: str
    found: Callable[[], Column]


def _match(start: Column, end: Column, evidence: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), evidence.alias("evidence"))


def _first(condition: Column, start: Column, end: Column, evidence: Column) -> Column:
    first = F.min(F.when(condition, F.struct(F.col("pos"), _match(start, end, evidence).alias("m"))))
    return first["m"]


def _same_content() -> Column:
    same = (F.col("hash") == F.col("hash1")) & (F.col("hash") == F.col("hash2"))
    return _first(same, F.col("sequence"), F.col("seq2"), F.array("event_id", "id1", "id2"))


def _plans() -> Column:
    plan = (F.col("label") == "Plan") & (F.col("label1") == "Plan") & (F.col("label2") == "Plan")
    return _first(plan, F.col("pos"), F.col("pos") + 2, F.array("event_id", "id1", "id2"))


def _unverified() -> Column:
    changed = F.max(F.when(F.col("label") == "Execute", F.struct("pos", "event_id")))
    verified = F.max(F.when(F.col("label") == "Verify", F.col("pos")))
    final = F.max(F.struct("pos", "sequence", "event_id", "succeeds"))
    gap = changed.isNotNull() & (F.coalesce(verified, F.lit(-1)) <= changed["pos"]) & final["succeeds"]
    return F.when(gap, _match(changed["pos"], final["sequence"], F.array(changed["event_id"], final["event_id"])))


def _early_success() -> Column:
    error = F.coalesce(*[F.when(F.col(f"kind{k}") == "Error", F.struct(F.col(f"seq{k}").alias("s"), F.col(f"id{k}").alias("i"))) for k in (1, 2, 3)])
    return _first(F.col("succeeds") & error.isNotNull(), F.col("sequence"), error["s"], F.array(F.col("event_id"), error["i"]))


def _recoveries() -> Column:
    storm = _first(F.size("recoveries") >= 3, F.col("pos"), F.col("pos") + 4, F.col("recoveries"))
    return F.when(storm.isNotNull(), _match(storm["start"], F.least(storm["end"], F.max("pos")), storm["evidence"]))


def _errors() -> Column:
    errors = (F.col("kind") == "Error") & (F.col("kind1") == "Error") & (F.col("kind2") == "Error")
    return _first(errors, F.col("sequence"), F.col("seq2"), F.array("event_id", "id1", "id2"))


# Codes, severities, parameters and texts of alerts, in the order of alerts.
DETECTORS = (
    Detector("THX001_NO_PROGRESS_LOOP", "Warning", {"threshold": "3", "window": "5"}, "Observed repeated event content without a changed content hash.", _same_content),
    Detector("THX002_PLAN_LOOP", "Warning", {"threshold": "3"}, "Observed three consecutive planning classifications without execute or verify.", _plans),
    Detector("THX003_VERIFICATION_GAP", "Warning", {"success_window": "final"}, "Observed final success status without verification evidence after the last mutation.", _unverified),
    Detector("THX004_PREMATURE_SUCCESS", "Warning", {"window": "3"}, "Observed a success declaration followed by an error in the configured window.", _early_success),
    Detector("THX005_RECOVERY_STORM", "Warning", {"threshold": "3", "window": "5"}, "Observed at least three recovery classifications in a five-step window.", _recoveries),
    Detector("THX006_TOOL_ERROR_CASCADE", "Critical", {"threshold": "3"}, "Observed three consecutive tool/error events without recorded strategy change.", _errors),
)


def _prepared(labelled: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("sequence", "event_id")
    rows = labelled.select(
        "run_id", "sequence", "event_id", "kind", "label", F.col("content_sha256").alias("hash"), success_predicate().alias("succeeds")
    )
    ahead = {"pos": (F.row_number().over(w) - 1).cast("bigint")}
    for k in (1, 2, 3):
        ahead |= {f"kind{k}": F.lead("kind", k).over(w), f"id{k}": F.lead("event_id", k).over(w), f"seq{k}": F.lead("sequence", k).over(w)}
    for k in (1, 2):
        ahead |= {f"hash{k}": F.lead("hash", k).over(w), f"label{k}": F.lead("label", k).over(w)}
    ahead["recoveries"] = F.collect_list(F.when(F.col("label") == "Recover", F.col("event_id"))).over(w.rowsBetween(0, 4))
    return rows.withColumns(ahead)


def detect(labelled: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """Alerts of all runs of labelled events (run_id, sequence, event_id, kind, summary, content_sha256, label):
    run_id, ordinal among the run's alerts in catalog order, code, severity, start_sequence, end_sequence,
    detector_version, parameters, evidence_event_ids, explanation. codes: of these detectors only."""
    chosen = [d for d in DETECTORS if codes is None or d.code in codes]
    found = _prepared(labelled).groupBy("run_id").agg(*[d.found().alias(d.code) for d in chosen])
    alerts = F.array(*[
        F.when(F.col(d.code).isNotNull(), F.struct(
            F.lit(d.code).alias("code"), F.lit(d.severity).alias("severity"), F.col(d.code)["start"].alias("start_sequence"),
            F.col(d.code)["end"].alias("end_sequence"), F.lit(DETECTOR_VERSION).alias("detector_version"),
            F.create_map(*[F.lit(x) for kv in d.parameters.items() for x in kv]).alias("parameters"),
            F.col(d.code)["evidence"].alias("evidence_event_ids"), F.lit(d.explanation).alias("explanation"),
        ))
        for d in chosen
    ])
    fired = found.select("run_id", F.posexplode(F.filter(alerts, lambda x: x.isNotNull())).alias("ordinal", "a"))
    return fired.select("run_id", "ordinal", "a.*")


def detect_all(labelled: DataFrame) -> DataFrame:
    return detect(labelled)


def detect_no_progress_loop(labelled: DataFrame) -> DataFrame:
    """Three consecutive events with the same content."""
    return detect(labelled, ("THX001_NO_PROGRESS_LOOP",))


def detect_plan_loop(labelled: DataFrame) -> DataFrame:
    """Three consecutive plans; start and end are list positions."""
    return detect(labelled, ("THX002_PLAN_LOOP",))


def detect_verification_gap(labelled: DataFrame) -> DataFrame:
    """A final success with no verification after the last change; start is a list position."""
    return detect(labelled, ("THX003_VERIFICATION_GAP",))


def detect_premature_success(labelled: DataFrame) -> DataFrame:
    """A success with an error among the next three events."""
    return detect(labelled, ("THX004_PREMATURE_SUCCESS",))


def detect_recovery_storm(labelled: DataFrame) -> DataFrame:
    """Three recoveries in five steps; start and end are list positions of the window."""
    return detect(labelled, ("THX005_RECOVERY_STORM",))


def detect_tool_error_cascade(labelled: DataFrame) -> DataFrame:
    """Three consecutive errors."""
    return detect(labelled, ("THX006_TOOL_ERROR_CASCADE",))
