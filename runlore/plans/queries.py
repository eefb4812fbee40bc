"""The trace operators applied to the given tables: queries, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, classify, detect, views
from .driver_views import TRACE_SQL, conversation_events, guid_sql, trace_events, trace_runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, traces: bool = True):
    """Registers a query; sql follows TRACE_SQL if the query is about traces."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (TRACE_SQL if traces else "") + sql
        return f

    return register


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.label_steps(trace_events(spark, sf_dir))


def _shown(alerts: DataFrame) -> DataFrame:
    return alerts.select("run_id", "code", "severity", "start_sequence", "end_sequence", F.concat_ws(",", "evidence_event_ids").alias("evidence"))


@query("SELECT run_id, event_id, f1 AS is_explore, f2 AS is_plan, f3 AS is_execute, f4 AS is_verify, f5 AS is_recover FROM counted")
def rule_flags(spark, sf_dir):
    flags = classify.rule_flags(trace_events(spark, sf_dir))
    return flags.select("run_id", "event_id", "is_explore", "is_plan", "is_execute", "is_verify", "is_recover")


@query("SELECT event_id, t AS rule_text FROM texts")
def rule_text(spark, sf_dir):
    return trace_events(spark, sf_dir).select("event_id", classify.rule_text().alias("rule_text"))


@query("SELECT run_id, event_id, sequence, label, confidence, 'rules' AS classifier_id, '1.0.0' AS classifier_version, event_id AS evidence FROM labelled")
def classify_steps(spark, sf_dir):
    steps = classify.classify_steps(trace_events(spark, sf_dir))
    return steps.select(
        "run_id", "event_id", "sequence", "label", "confidence", "classifier_id", "classifier_version", F.concat_ws(",", "evidence_event_ids").alias("evidence")
    )


@query("SELECT run_id, label, count(*) AS n FROM labelled GROUP BY ALL")
def label_counts(spark, sf_dir):
    return classify.label_counts(_labelled(spark, sf_dir))


@query("SELECT event_id, regexp_matches(lower(coalesce(summary, '')), 'success|complete') AS succeeds FROM te")
def success_predicate(spark, sf_dir):
    return trace_events(spark, sf_dir).select("event_id", detect.success_predicate().alias("succeeds"))


def _detector(name: str, relation: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(getattr(detect, name)(_labelled(spark, sf_dir)))

    run.__name__ = name
    query(f"SELECT run_id, code, severity, s AS start_sequence, e AS end_sequence, ev AS evidence FROM {relation}")(run)


for _name, _relation in (
    ("detect_no_progress_loop", "a1"), ("detect_plan_loop", "a2"), ("detect_verification_gap", "a3"), ("detect_premature_success", "a4"),
    ("detect_recovery_storm", "a5"), ("detect_tool_error_cascade", "a6"), ("detect_all", "alerts"),
):
    _detector(_name, _relation)


@query("SELECT run_id, code, CAST(row_number() OVER (PARTITION BY run_id ORDER BY code) - 1 AS INTEGER) AS ordinal, s AS start_sequence, e AS end_sequence FROM alerts")
def alert_index(spark, sf_dir):
    found = detect.detect_all(_labelled(spark, sf_dir)).withColumn("analysis_id", F.col("run_id"))
    return analysis.alert_index(found).drop("analysis_id")


@query("SELECT code, count(*) AS alerts, count(DISTINCT run_id) AS runs FROM alerts GROUP BY code")
def alert_summary(spark, sf_dir):
    return analysis.alert_summary(detect.detect_all(_labelled(spark, sf_dir)))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, analysis.Analysis]:
    events = trace_events(spark, sf_dir)
    runs = trace_runs(events)
    return runs, events, analysis.analyze_runs(runs, events, F.col("imported_at"))


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, an unknown twin of each, and (without events) a run of each user's twin that is stored."""
    ids = trace_events(spark, sf_dir).select("run_id").distinct()
    twins = ids.select(F.explode(F.array("run_id", F.concat("run_id", F.lit("-unknown")), F.concat("run_id", F.lit("-empty")))).alias("run_id"))
    return twins


@query("""SELECT run_id, 'Completed' AS outcome, events AS event_count FROM runs
UNION ALL SELECT run_id || '-unknown', 'NotFound', 0 FROM runs UNION ALL SELECT run_id || '-empty', 'NoEvents', 0 FROM runs""")
def analyze_runs(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    runs = trace_runs(events)
    empty = runs.withColumn("run_id", F.concat("run_id", F.lit("-empty")))
    return analysis.analyze_runs(runs.unionByName(empty), events, F.lit("2026-01-01").cast("timestamp"), _requested(spark, sf_dir)).outcomes


_HASHES_SQL = """, steps AS (SELECT run_id, string_agg('{"sequence":' || sequence || ',"event_id":"' || event_id || '","label":"' || label || '","confidence":' || confidence || '}', ','
ORDER BY sequence) AS s FROM labelled GROUP BY run_id),
numbered AS (SELECT *, '{"ordinal":' || row_number() OVER (PARTITION BY run_id ORDER BY code) - 1 || ',"code":"' || code || '","severity":"' || severity || '","start_sequence":' || s
|| ',"end_sequence":' || e || ',"evidence_event_ids":["' || replace(ev, ',', '","') || '"]' AS j FROM alerts),
found AS (SELECT run_id, string_agg(j || '}', ',' ORDER BY code) AS a FROM numbered GROUP BY run_id),
hashes AS (SELECT run_id, s, sha256('{"run_id":"' || run_id || '","steps":[' || s || ']' || coalesce(',"alerts":[' || a || ']', '') || '}') AS content_sha256
FROM steps LEFT JOIN found USING (run_id)) """


@query(_HASHES_SQL + "SELECT run_id, content_sha256 FROM hashes")
def analysis_content_hash(spark, sf_dir):
    return _stored(spark, sf_dir)[2].analyses.select("run_id", "content_sha256")


def _history(events: DataFrame) -> DataFrame:
    """A revision for each event, two of them at the same time."""
    rows = events.select("run_id", F.col("timestamp").alias("created_at"), "sequence")
    twice = rows.withColumn("ingest_ordinal", F.explode(F.array(F.col("sequence"), F.col("sequence") + 1)))
    return twice.withColumn("analysis_id", F.concat_ws("/", "run_id", F.col("ingest_ordinal").cast("string"))).drop("sequence")


@query("""SELECT run_id, arg_max(created_at, (created_at, o)) AS created_at, arg_max(o, (created_at, o)) AS ingest_ordinal,
arg_max(run_id || '/' || o, (created_at, o)) AS analysis_id
FROM (SELECT run_id, timestamp AS created_at, unnest([sequence, sequence + 1]) AS o FROM te) GROUP BY run_id""")
def latest_analysis(spark, sf_dir):
    return analysis.latest_analysis(_history(trace_events(spark, sf_dir)))


def _diagnostics(events: DataFrame) -> DataFrame:
    """Diagnostics in place of the errors of traces."""
    return events.filter("kind = 'Error'").select(
        "run_id", F.col("sequence").cast("int").alias("line"), F.col("sequence").alias("byte_offset"), F.lit("INVALID_JSON").alias("code"), F.lit("Record is not a JSON object.").alias("message")
    )


@query("""SELECT r.run_id, r.imported_at, r.events AS event_count, count(t.run_id) AS diagnostic_count FROM runs r
LEFT JOIN te t ON t.run_id = r.run_id AND t.kind = 'Error' GROUP BY ALL""")
def list_runs(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    return views.list_runs(trace_runs(events), events, _diagnostics(events)).select("run_id", "imported_at", "event_count", "diagnostic_count")


@query("""SELECT r.run_id, r.events AS event_count, (SELECT count(*) FROM te t WHERE t.run_id = r.run_id AND t.kind = 'Error') AS diagnostic_count,
r.events AS classification_count, (SELECT count(*) FROM alerts a WHERE a.run_id = r.run_id) AS alert_count FROM runs r""")
def run_detail(spark, sf_dir):
    runs, events, made = _stored(spark, sf_dir)
    revisions = made.analyses.withColumn("ingest_ordinal", F.lit(0))
    found = views.run_detail(runs, runs, events, _diagnostics(events), revisions, made.classifications, made.alerts)
    return found.select("run_id", "event_count", "diagnostic_count", "classification_count", "alert_count")


@query("""SELECT run_id, sequence, event_id, CASE WHEN top > 24 THEN 24 END AS next_cursor
FROM (SELECT *, max(sequence) OVER (PARTITION BY run_id) AS top FROM te) WHERE sequence BETWEEN 5 AND 24""")
def event_page(spark, sf_dir):
    return views.event_page(trace_events(spark, sf_dir), cursor=4, limit=20).select("run_id", "sequence", "event_id", "next_cursor")


@query("""SELECT 'conv-' || conv_id AS run_id, turn AS sequence, CASE WHEN max(turn) OVER (PARTITION BY conv_id) > 2 THEN 2 END AS next_cursor
FROM conversations QUALIFY turn <= 2""", traces=False)
def conversation_page(spark, sf_dir):
    return views.event_page(conversation_events(spark, sf_dir), limit=3).select("run_id", "sequence", F.col("next_cursor").cast("bigint").alias("next_cursor"))


@query("SELECT run_id, label, count(*) AS n FROM labelled GROUP BY ALL")
def latest_classifications(spark, sf_dir):
    """Of two revisions of each run only the later one's steps count."""
    _, _, made = _stored(spark, sf_dir)
    older = made.analyses.select("run_id", F.concat("analysis_id", F.lit("-old")).alias("analysis_id"), "created_at", F.lit(0).alias("ingest_ordinal"))
    newer = made.analyses.select("run_id", "analysis_id", "created_at", F.lit(1).alias("ingest_ordinal"))
    steps = made.classifications.unionByName(made.classifications.withColumn("analysis_id", F.concat("analysis_id", F.lit("-old"))))
    return classify.label_counts(views.latest_rows(steps, analysis.latest_analysis(older.unionByName(newer))))


@query("SELECT run_id, code, s AS start_sequence FROM alerts")
def latest_alerts(spark, sf_dir):
    _, _, made = _stored(spark, sf_dir)
    latest = analysis.latest_analysis(made.analyses.withColumn("ingest_ordinal", F.lit(0)))
    return views.latest_rows(made.alerts, latest).select("run_id", "code", "start_sequence")


@query("SELECT l.run_id, label, count(*) AS n, count(*) / max(r.events) AS share FROM labelled l JOIN runs r ON r.run_id = l.run_id GROUP BY l.run_id, label")
def label_share(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    return views.label_share(classify.label_steps(events), events)


@query("""SELECT x.run_id AS left_run_id, y.run_id AS right_run_id, x.events AS left_event_count, y.events AS right_event_count,
(SELECT count(*) FROM labelled l WHERE l.run_id = x.run_id AND label = 'Plan') AS left_plans,
(SELECT count(*) FROM labelled l WHERE l.run_id = y.run_id AND label = 'Plan') AS right_plans,
(SELECT count(*) FROM alerts a WHERE a.run_id = x.run_id) AS left_alert_count, (SELECT count(*) FROM alerts a WHERE a.run_id = y.run_id) AS right_alert_count
FROM runs x JOIN runs y ON CAST(substr(y.run_id, 5) AS BIGINT) = CAST(substr(x.run_id, 5) AS BIGINT) + 1""")
def compare_runs(spark, sf_dir):
    """Each run beside that of the next user, where there is one."""
    events = trace_events(spark, sf_dir)
    runs, labelled = trace_runs(events), classify.label_steps(events)
    metrics = views.run_metrics(runs, events, labelled, detect.detect_all(labelled))  # one revision each, so ids tell nothing
    following = F.concat(F.lit("run-"), (F.substring("run_id", 5, 20).cast("bigint") + 1).cast("string"))
    pairs = runs.select(F.col("run_id").alias("left_run_id"), following.alias("right_run_id"))
    plans = lambda s: F.coalesce(F.col(f"{s}_label_counts")["Plan"], F.lit(0)).cast("bigint").alias(f"{s}_plans")
    return views.compare_runs(pairs, metrics).select(
        "left_run_id", "right_run_id", "left_event_count", "right_event_count", plans("left"), plans("right"), "left_alert_count", "right_alert_count"
    )


_EXPLAINED = " ".join(f"WHEN '{d.code}' THEN '{d.explanation}'" for d in detect.DETECTORS)
_TIME = "strftime(imported_at, '%Y-%m-%dT%H:%M:%S.%g')"
_REPORT_SQL = _HASHES_SQL.rstrip() + f""", told AS (SELECT run_id, string_agg(j || ',"explanation":"' || CASE code {_EXPLAINED} END || '"}}', ',' ORDER BY code) AS t FROM numbered GROUP BY run_id),
ids AS (SELECT *, sha256(run_id || ':' || content_sha256 || ':' || regexp_replace(strftime(imported_at, '%Y-%m-%d %H:%M:%S.%f'), '[.]?0+$', '')) AS h,
sha256('{{"InputSha256":"' || sha256(run_id) || '","ContentSha256":"' || content_sha256 || '"}}') AS identity FROM hashes JOIN runs USING (run_id) LEFT JOIN told USING (run_id))
SELECT run_id, identity AS content_identity_sha256, '{{"schemaVersion":"1.0","run":{{"run_id":"' || run_id || '","name":"' || run_id || '","input_sha256":"' || sha256(run_id)
|| '","adapter":"generic-jsonl","adapter_version":"1.0.0","imported_at":"' || {_TIME} || '"}},"analysis":{{"analysis_id":"' || {guid_sql('h')} || '","status":"Completed","created_at":"' || {_TIME}
|| '","classifier_id":"{analysis.CLASSIFIER_ID}","classifier_version":"{analysis.CLASSIFIER_VERSION}","content_sha256":"' || content_sha256 || '","classifications":[' || s || ']'
|| coalesce(',"alerts":[' || t || ']', '') || '}},"disclaimer":"{views.DISCLAIMER}","contentIdentitySha256":"' || identity || '"}}' AS report FROM ids"""


@query(_REPORT_SQL)
def export_report(spark, sf_dir):
    runs, _, made = _stored(spark, sf_dir)
    revisions = made.analyses.withColumn("ingest_ordinal", F.lit(0))
    return views.export_report(runs, runs, revisions, made.classifications, made.alerts)


@query("SELECT run_id, code, count(*) AS alerts FROM alerts GROUP BY ALL")
def alerts_by_run(spark, sf_dir):
    return analysis.alerts_by_run(detect.detect_all(_labelled(spark, sf_dir)))
