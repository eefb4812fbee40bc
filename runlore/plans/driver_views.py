"""Agent traces derived from the given tables, by whole numbers alone, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADAPTER, ADAPTER_VERSION = "generic-jsonl", "1.0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user of the events table, its events in order of time: view becomes a tool call, click reasoning,
    purchase a file change or tool result, signup a status, error an error."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    views = F.element_at(F.array(*map(F.lit, ("read file", "search repository", "write patch", "run test", "read and edit file"))), (F.col("k") % 5 + 1).cast("int"))
    kind = (
        F.when(F.col("event_type") == "view", "ToolCall").when(F.col("event_type") == "click", "Reasoning")
        .when((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0), "FileChange").when(F.col("event_type") == "purchase", "ToolResult")
        .when(F.col("event_type") == "signup", "Status").when(F.col("event_type") == "error", "Error").otherwise("Unknown")
    )
    summary = (
        F.when(F.col("event_type") == "view", views).when((F.col("event_type") == "click") & (F.col("k") % 4 < 3), "plan checklist")
        .when(F.col("event_type") == "click", "thinking").when(F.col("kind") == "FileChange", "apply patch").when(F.col("kind") == "ToolResult", "tests passed")
        .when((F.col("kind") == "Status") & (F.col("k") % 2 == 0), "success complete").when(F.col("kind") == "Status", "in progress")
        .when(F.col("kind") == "Error", "retry after failure")
    )
    rows = raw.withColumn("k", k).withColumn("kind", kind).withColumn("summary", summary)
    return rows.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), (F.row_number().over(w) - 1).cast("bigint").alias("sequence"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_id"), F.col("ts").alias("timestamp"), "kind",
        F.when(F.col("kind").isin("Error", "ToolResult"), "tool").otherwise("agent").alias("actor"), "summary", F.col("props").alias("payload"),
        F.sha2(F.concat("kind", F.lit("|"), F.coalesce("summary", F.lit(""))), 256).alias("content_sha256"),
    )


def trace_runs(events: DataFrame) -> DataFrame:
    """A run row for each run of events."""
    return events.groupBy("run_id").agg(F.min("timestamp").alias("imported_at")).select(
        "run_id", F.col("run_id").alias("name"), F.sha2("run_id", 256).alias("input_sha256"), F.lit(ADAPTER).alias("adapter"),
        F.lit(ADAPTER_VERSION).alias("adapter_version"), "imported_at",
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per conversation, an event per turn."""
    raw = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Message").when(F.col("role") == "assistant", "Reasoning").when(F.col("role") == "system", "Status").otherwise("Unknown")
    return raw.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"), F.col("turn").alias("sequence"),
        F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        kind.alias("kind"), F.col("role").alias("actor"), F.col("text").alias("summary"), F.lit("{}").alias("payload"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"),
    )


#: trace_events (te) with labels, and the prepared rows of detectors (d), in SQL.
TRACE_SQL = """
WITH raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
kinds AS (SELECT *, CASE event_type WHEN 'view' THEN 'ToolCall' WHEN 'click' THEN 'Reasoning'
            WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'FileChange' ELSE 'ToolResult' END
            WHEN 'signup' THEN 'Status' WHEN 'error' THEN 'Error' ELSE 'Unknown' END AS kind FROM raw),
te AS (SELECT 'run-' || user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence,
         'ev-' || event_id AS event_id, ts AS timestamp, kind,
         CASE WHEN event_type = 'view' THEN ['read file', 'search repository', 'write patch', 'run test', 'read and edit file'][k % 5 + 1]
              WHEN event_type = 'click' AND k % 4 < 3 THEN 'plan checklist' WHEN event_type = 'click' THEN 'thinking'
              WHEN kind = 'FileChange' THEN 'apply patch' WHEN kind = 'ToolResult' THEN 'tests passed'
              WHEN kind = 'Status' AND k % 2 = 0 THEN 'success complete' WHEN kind = 'Status' THEN 'in progress'
              WHEN kind = 'Error' THEN 'retry after failure' END AS summary, props AS payload FROM kinds),
texts AS (SELECT *, lower(coalesce(summary, '') || ' ' || coalesce(payload, '')) AS t, sha256(kind || '|' || coalesce(summary, '')) AS hash FROM te),
flags AS (SELECT *, kind = 'ToolCall' AND regexp_matches(t, 'read|search|grep|find|list') AS f1,
            kind IN ('Reasoning', 'Message') AND regexp_matches(t, 'plan|checklist|steps|todo') AS f2,
            kind = 'FileChange' OR kind = 'ToolCall' AND regexp_matches(t, 'write|patch|edit|delete|create|mkdir| rm | mv | cp |touch|chmod') AS f3,
            kind IN ('ToolCall', 'ToolResult') AND regexp_matches(t, 'test|passed|build|hash|verify|health|check') AS f4,
            kind = 'Error' OR regexp_matches(t, 'retry|rollback|recover|fix after|failure') AS f5 FROM texts),
counted AS (SELECT *, f1::INT + f2::INT + f3::INT + f4::INT + f5::INT AS n FROM flags),
labelled AS (SELECT *, CASE WHEN n <> 1 THEN 'Unknown' WHEN f1 THEN 'Explore' WHEN f2 THEN 'Plan' WHEN f3 THEN 'Execute'
               WHEN f4 THEN 'Verify' ELSE 'Recover' END AS label,
               CASE WHEN n = 1 THEN 0.85::DOUBLE WHEN n = 0 THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM counted),
d AS (SELECT *, sequence AS pos, regexp_matches(lower(coalesce(summary, '')), 'success|complete') AS ok,
        lead(hash, 1) OVER w AS h1, lead(hash, 2) OVER w AS h2, lead(label, 1) OVER w AS l1, lead(label, 2) OVER w AS l2,
        lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(kind, 3) OVER w AS k3,
        lead(event_id, 1) OVER w AS i1, lead(event_id, 2) OVER w AS i2, lead(event_id, 3) OVER w AS i3,
        sum((label = 'Recover')::INT) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS recovers,
        list(CASE WHEN label = 'Recover' THEN event_id END) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ids,
        max(sequence) OVER (PARTITION BY run_id) AS top
      FROM labelled WINDOW w AS (PARTITION BY run_id ORDER BY sequence)),
a1 AS (SELECT run_id, 'THX001_NO_PROGRESS_LOOP' AS code, 'Warning' AS severity, min(pos) AS s, min(pos) + 2 AS e, arg_min(event_id || ',' || i1 || ',' || i2, pos) AS ev FROM d WHERE hash = h1 AND hash = h2 GROUP BY run_id),
a2 AS (SELECT run_id, 'THX002_PLAN_LOOP' AS code, 'Warning' AS severity, min(pos) AS s, min(pos) + 2 AS e, arg_min(event_id || ',' || i1 || ',' || i2, pos) AS ev FROM d WHERE label = 'Plan' AND l1 = 'Plan' AND l2 = 'Plan' GROUP BY run_id),
g AS (SELECT run_id, max(pos) FILTER (label = 'Execute') AS m, arg_max(event_id, pos) FILTER (label = 'Execute') AS mid,
        max(pos) FILTER (label = 'Verify') AS v, max(pos) AS f, arg_max(event_id, pos) AS fid, arg_max(ok, pos) AS fok FROM d GROUP BY run_id),
a3 AS (SELECT run_id, 'THX003_VERIFICATION_GAP' AS code, 'Warning' AS severity, m AS s, f AS e, mid || ',' || fid AS ev FROM g WHERE m IS NOT NULL AND coalesce(v, -1) <= m AND fok),
p AS (SELECT *, CASE WHEN k1 = 'Error' THEN 1 WHEN k2 = 'Error' THEN 2 ELSE 3 END AS j FROM d WHERE ok AND 'Error' IN (k1, k2, k3)),
a4 AS (SELECT run_id, 'THX004_PREMATURE_SUCCESS' AS code, 'Warning' AS severity, min(pos) AS s, arg_min(pos + j, pos) AS e, arg_min(event_id || ',' || [i1, i2, i3][j], pos) AS ev FROM p GROUP BY run_id),
a5 AS (SELECT run_id, 'THX005_RECOVERY_STORM' AS code, 'Warning' AS severity, min(pos) AS s, least(min(pos) + 4, max(top)) AS e, arg_min(list_aggregate(list_filter(ids, lambda x: x IS NOT NULL), 'string_agg', ','), pos) AS ev FROM d WHERE recovers >= 3 GROUP BY run_id),
a6 AS (SELECT run_id, 'THX006_TOOL_ERROR_CASCADE' AS code, 'Critical' AS severity, min(pos) AS s, min(pos) + 2 AS e, arg_min(event_id || ',' || i1 || ',' || i2, pos) AS ev FROM d WHERE kind = 'Error' AND k1 = 'Error' AND k2 = 'Error' GROUP BY run_id),
alerts AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5 UNION ALL SELECT * FROM a6),
runs AS (SELECT run_id, min(timestamp) AS imported_at, count(*) AS events FROM te GROUP BY run_id)
"""


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_events as they stand in a store: with GUIDs, time as text, source and artifacts."""
    from ..operators.analysis import guid_from_hash

    guid = lambda c: guid_from_hash(F.sha2(c, 256))
    events = trace_events(spark, sf_dir).withColumn("input_sha256", F.sha2("run_id", 256))
    source = F.struct(
        F.lit(ADAPTER).alias("adapter"), "input_sha256", F.concat("run_id", F.lit(".jsonl")).alias("relative_path"), (F.col("sequence") * 100).alias("byte_offset"),
        (F.col("sequence") + 1).cast("int").alias("line"), F.lit("/").alias("json_pointer"),
    )
    return events.select(
        guid("event_id").alias("event_id"), guid("run_id").alias("run_id"), "sequence", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_text"),
        "timestamp", "kind", "actor", "summary", "payload", F.lit(None).cast("string").alias("tool"), source.alias("source"),
        F.array().cast("array<struct<name:string,path:string,sha256:string>>").alias("artifacts"), "content_sha256", F.col("run_id").alias("name"),
        F.col("event_id").alias("short_id"),
    )


def stored_runs(events: DataFrame) -> DataFrame:
    """A run row for each run of stored events."""
    return events.groupBy("run_id").agg(F.min("name").alias("name"), F.min("timestamp").alias("imported_at")).select(
        "run_id", "name", F.sha2("name", 256).alias("input_sha256"), F.lit(ADAPTER).alias("adapter"), F.lit(ADAPTER_VERSION).alias("adapter_version"), "imported_at"
    )


def guid_sql(h: str) -> str:
    """SQL for the GUID of a hex digest, as guid_from_hash makes it."""
    part = lambda a, n: f"substr({h}, {a}, {n})"
    first = " || ".join(part(a, 2) for a in (7, 5, 3, 1))
    return f"{first} || '-' || {part(11, 2)} || {part(9, 2)} || '-' || {part(15, 2)} || {part(13, 2)} || '-' || {part(17, 4)} || '-' || {part(21, 12)}"
