"""Step labels from deterministic rules over an event's kind, summary and payload text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSIFIER_ID, CLASSIFIER_VERSION = "rules", "1.0.0"

# The rules' terms and confidences.
EXPLORE_TERMS = ("read", "search", "grep", "find", "list")
PLAN_TERMS = ("plan", "checklist", "steps", "todo")
EXECUTE_TERMS = ("write", "patch", "edit", "delete", "create", "mkdir", " rm ", " mv ", " cp ", "touch", "chmod")
VERIFY_TERMS = ("test", "passed", "build", "hash", "verify", "health", "check")
RECOVER_TERMS = ("retry", "rollback", "recover", "fix after", "failure")
ONE_FLAG, NO_FLAG, SEVERAL_FLAGS = 0.85, 0.25, 0.35

LABELS = ("Explore", "Plan", "Execute", "Verify", "Recover", "Unknown")


def _has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def rule_text(summary: Column | str = "summary", payload: Column | str = "payload") -> Column:
    """The text that rules look at: summary and raw payload, in lower case. Only terms that hold blanks could tell a
    re-indented payload from the raw one."""
    summary = F.col(summary) if isinstance(summary, str) else summary
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.lower(F.concat(F.coalesce(summary, F.lit("")), F.lit(" "), F.coalesce(payload, F.lit(""))))


def rule_flags(events: DataFrame) -> DataFrame:
    """events with five boolean columns is_explore ... is_recover; terms are plain substrings. A null kind meets no
    rule that asks for a kind."""
    kind, text = F.coalesce(F.col("kind"), F.lit("")), F.col("rule_text")
    rules = {
        "is_explore": (kind == "ToolCall") & _has_any(text, EXPLORE_TERMS),
        "is_plan": kind.isin("Reasoning", "Message") & _has_any(text, PLAN_TERMS),
        "is_execute": (kind == "FileChange") | (kind == "ToolCall") & _has_any(text, EXECUTE_TERMS),
        "is_verify": kind.isin("ToolCall", "ToolResult") & _has_any(text, VERIFY_TERMS),
        "is_recover": (kind == "Error") | _has_any(text, RECOVER_TERMS),
    }
    return events.withColumn("rule_text", rule_text()).withColumns(rules).drop("rule_text")


def label_steps(events: DataFrame) -> DataFrame:
    """events with label and confidence: the one flag's label, or Unknown if none or several are set. Narrow: no
    shuffle, and the payload can be dropped right after it."""
    flagged = rule_flags(events)
    flags = ["is_explore", "is_plan", "is_execute", "is_verify", "is_recover"]
    n = reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags])
    one = F.coalesce(*[F.when(F.col(f), F.lit(name)) for f, name in zip(flags, LABELS, strict=False)])
    return (
        flagged.withColumn("flags", n)
        .withColumn("label", F.when(F.col("flags") == 1, one).otherwise(F.lit("Unknown")))
        .withColumn("confidence", F.when(F.col("flags") == 1, F.lit(ONE_FLAG)).when(F.col("flags") == 0, F.lit(NO_FLAG)).otherwise(F.lit(SEVERAL_FLAGS)))
        .drop("flags", *flags)
    )


def classify_steps(events: DataFrame) -> DataFrame:
    """One classification per event: run_id, event_id, sequence, label, confidence, classifier, evidence and scores."""
    return label_steps(events).select(
        "run_id", "event_id", "sequence", "label", "confidence", F.lit(CLASSIFIER_ID).alias("classifier_id"),
        F.lit(CLASSIFIER_VERSION).alias("classifier_version"), F.array("event_id").alias("evidence_event_ids"),
        F.create_map("label", "confidence").alias("scores"),
    )


def label_counts(classifications: DataFrame) -> DataFrame:
    """run_id, label, n of the labels that a run has."""
    return classifications.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))


def label_count_maps(classifications: DataFrame) -> DataFrame:
    """run_id and a map from label to count; at most six entries a run."""
    entries = F.array_sort(F.collect_list(F.struct("label", "n")))
    return label_counts(classifications).groupBy("run_id").agg(F.map_from_entries(entries).alias("label_counts"))
