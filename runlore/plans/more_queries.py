"""Import, audit, redaction, candidate and contract operators applied to the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.redaction import VERSION
from ..operators import audit, candidates, contracts, detect, redaction
from ..sources import clustered_events, commit_log, report_files, revisions, schemas, stores, traces
from ..streaming.traces import import_traces_stream
from .driver_views import guid_sql, stored_events, stored_runs, table, trace_events, trace_runs
from .queries import _HASHES_SQL, _REPORT_SQL, query


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share; under the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _written_traces(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one JSON line file per run of trace_events, whose last line is cut short in every third run."""
    events = trace_events(spark, sf_dir)
    line = F.concat(
        F.lit('{"timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","kind":"'), "kind", F.lit('","actor":"'), "actor",
        F.lit('","summary":"'), "summary", F.lit('","payload":'), "payload", F.lit("}"),
    )
    number = F.substring("run_id", 5, 20).cast("bigint")
    own, cut = F.struct("sequence", line.alias("value")), F.struct(F.lit(1 << 40).alias("sequence"), F.lit('{"cut').alias("value"))
    bad = (F.col("sequence") == 0) & (number % 3 == 0)
    rows = events.select("run_id", F.explode(F.when(bad, F.array(own, cut)).otherwise(F.array(own))).alias("x")).select("run_id", "x.*")
    folder = _folder(spark, "traces")
    files = rows.repartition("run_id").sortWithinPartitions("run_id", "sequence")
    stores.write_lines(files.select(F.concat(F.lit("run="), "run_id", F.lit("/part-0.txt")).alias("name"), "value"), folder)
    return f"{folder}/*/*.txt"


@query("""SELECT CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 'Partial' ELSE 'Imported' END AS outcome, count(*) AS runs, sum(events) AS events,
count(*) FILTER (CAST(substr(run_id, 5) AS BIGINT) % 3 = 0) AS diagnostics FROM runs GROUP BY ALL""")
def import_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON line files of all runs through the whole import: runs, events and diagnostics by outcome."""
    path, store = _written_traces(spark, sf_dir), _folder(spark, "store")
    outcomes = traces.import_traces(spark, path, store)
    count = lambda name, schema: traces.stored(spark, store, name, schema).groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    joined = outcomes.join(count("events", schemas.EVENTS), "run_id", "left").join(count("diagnostics", schemas.DIAGNOSTICS), "run_id", "left")
    return joined.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("events").cast("bigint").alias("events"), F.coalesce(F.sum("diagnostics"), F.lit(0)).cast("bigint").alias("diagnostics")
    )


@query("SELECT kind, sequence, count(*) AS n FROM te GROUP BY ALL")
def import_traces_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through the streaming import: events by kind and place."""
    path, store = _written_traces(spark, sf_dir), _folder(spark, "store")
    import_traces_stream(spark, path, store).awaitTermination()
    return traces.stored(spark, store, "events", schemas.EVENTS).groupBy("kind", "sequence").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s AS sequence, k AS kind, count(*) AS n, sum(byte_offset) AS offsets FROM (
SELECT sequence AS s, kind AS k, sum(strlen(line) + 1) OVER (PARTITION BY run_id ORDER BY sequence) - strlen(line) - 1 AS byte_offset FROM (
SELECT *, '{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || '","kind":"' || kind || '","actor":"' || CASE WHEN kind IN ('Error', 'ToolResult') THEN 'tool' ELSE 'agent' END
|| '","summary":"' || summary || '","payload":' || payload || '}' AS line FROM te)) GROUP BY ALL""")
def split_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of records, by place and kind."""
    none = spark.createDataFrame([], schemas.RUNS)
    made = traces.import_files(traces.read_trace_files(spark, _written_traces(spark, sf_dir)), none, keep=_folder(spark, "kept"))
    return made.events.groupBy("sequence", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("source.byte_offset").cast("bigint").alias("offsets"))


@query("""SELECT 'run-' || user_id AS run_id, CASE WHEN count(*) > 70 THEN 'RECORD_COUNT_LIMIT' END AS code FROM events
WHERE user_id % 3 <> 0 GROUP BY user_id HAVING count(*) > 70 UNION ALL
SELECT 'run-' || user_id, 'RECORD_COUNT_LIMIT' FROM events WHERE user_id % 3 = 0 GROUP BY user_id HAVING count(*) + 1 > 70""", traces=False)
def enforce_import_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than 70 records are rejected as a whole."""
    limits = traces.ImportLimits(records=70)
    lines, parsed = traces.kept_lines(traces.read_trace_files(spark, _written_traces(spark, sf_dir)), _folder(spark, "kept"), limits)
    found = traces.enforce_import_limits(lines, parsed, limits)
    return found.select(F.regexp_extract("path", "run=(run-[0-9]+)", 1).alias("run_id"), "code")


_IMPORTS_SQL = """SELECT run_id, n, CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 AS bad FROM (SELECT run_id, events + CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS n FROM runs)"""


@query(f""", files AS ({_IMPORTS_SQL})
SELECT 0 AS import, run_id, CASE WHEN n > 70 THEN 'Rejected' WHEN bad THEN 'Partial' ELSE 'Imported' END AS outcome, CASE WHEN n > 70 THEN 'RECORD_COUNT_LIMIT' END AS code FROM files
UNION ALL SELECT 1, run_id, CASE WHEN n <= 70 THEN 'Duplicate' WHEN bad THEN 'Partial' ELSE 'Imported' END, NULL FROM files
UNION ALL SELECT 2, run_id, 'Duplicate', NULL FROM files
UNION ALL SELECT 3, run_id, CASE WHEN n > 60 THEN 'Rejected' ELSE 'Duplicate' END, CASE WHEN n > 60 THEN 'RECORD_COUNT_LIMIT' END FROM files""")
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three imports of all files and a stream over them have told, as one store keeps it: the first rejects files of more
    than 70 records, the second and third take all, the stream rejects those of more than 60."""
    path, store = _written_traces(spark, sf_dir), _folder(spark, "store")
    for limits in (traces.ImportLimits(records=70), traces.ImportLimits(), traces.ImportLimits()):
        traces.import_traces(spark, path, store, limits)
    import_traces_stream(spark, path, store, traces.ImportLimits(records=60)).awaitTermination()
    done = commit_log.commits(spark, store)
    number = F.create_map(*[x for c in done for x in (F.lit(c.id), F.lit(c.number))])[F.col("import_id")]
    rows = commit_log.read(spark, store, "outcomes", schemas.OUTCOMES, done)
    return rows.select(number.alias("import"), F.regexp_extract("path", "run=(run-[0-9]+)", 1).alias("run_id"), "outcome", "code")


@query("""SELECT run_id, CAST(s + 1 AS INTEGER) AS line, s AS sequence, byte_offset FROM (
SELECT run_id, sequence AS s, CAST(sum(strlen(line) + 1) OVER (PARTITION BY run_id ORDER BY sequence) - strlen(line) - 1 AS BIGINT) AS byte_offset FROM (
SELECT *, '{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || '","kind":"' || kind || '","actor":"' || CASE WHEN kind IN ('Error', 'ToolResult') THEN 'tool' ELSE 'agent' END
|| '","summary":"' || summary || '","payload":' || payload || '}' AS line FROM te))""")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and byte offsets of all records, of files that are cut in ranges of 2,000 bytes."""
    none, path = spark.createDataFrame([], schemas.RUNS), _written_traces(spark, sf_dir)
    made = traces.import_paths(spark, path, none, _folder(spark, "ranges"), range_bytes=2_000)
    paths = made.outcomes.select("run_id", F.regexp_extract("path", "run=(run-[0-9]+)", 1).alias("name"))
    return made.events.join(paths, "run_id").select(F.col("name").alias("run_id"), "source.line", "sequence", "source.byte_offset")


def _revised(spark: SparkSession, sf_dir: str) -> str:
    """A store with the revisions of all runs, analysed by their first 20 events, again by these, and by all events."""
    events, store, at = trace_events(spark, sf_dir), _folder(spark, "store"), F.lit("2026-01-01").cast("timestamp")
    runs = trace_runs(events)
    for part in (events.filter("sequence < 20"), events.filter("sequence < 20"), events):
        revisions.analyze_into(spark, store, runs, part, at)
    return store


@query(_HASHES_SQL + "SELECT run_id, CASE WHEN events > 20 THEN 2 ELSE 1 END AS revisions, CASE WHEN events > 20 THEN 1 ELSE 0 END AS ingest_ordinal, content_sha256 FROM hashes JOIN runs USING (run_id)")
def stored_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many revisions of each run are stored, and which is the newest: an analysis that finds what the one before has found
    makes none."""
    store = _revised(spark, sf_dir)
    history = revisions.revisions(spark, store).groupBy("run_id").agg(F.count(F.lit(1)).alias("revisions"))
    return revisions.newest_revisions(spark, store).join(history, "run_id").select("run_id", "revisions", "ingest_ordinal", "content_sha256")


@query(f"SELECT a.run_id, s AS start_sequence, e AS end_sequence FROM alerts a JOIN runs r ON r.run_id = a.run_id WHERE code = '{detect.DETECTORS[0].code}'")
def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revisions' alerts of one code, from the stored index, which has a folder for each code."""
    store = _revised(spark, sf_dir)
    found = revisions.stored_alerts(spark, store, detect.DETECTORS[0].code)
    newest = revisions.newest_revisions(spark, store).select("analysis_id")
    return found.join(newest, "analysis_id", "left_semi").select("run_id", "start_sequence", "end_sequence")


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A store with defects by rule: index rows of run numbers 7, 17, ... have another kind at sequence 1 and lack
    sequence 2, of 9, 19, ... the first event's id at sequence 1 again; runs 5, 15, ... are missing; sources of runs 3, 13,
    ... are foreign."""
    events = stored_events(spark, sf_dir).withColumn("number", F.substring("name", 5, 20).cast("bigint") % 10)
    runs = stored_runs(events).filter(~F.col("name").endswith("5"))
    index = events.filter(~((F.col("number") == 7) & (F.col("sequence") == 2)))
    index = index.withColumn("kind", F.when((F.col("number") == 7) & (F.col("sequence") == 1), "Artifact").otherwise(F.col("kind")))
    first = F.first("event_id").over(Window.partitionBy("run_id").orderBy("sequence"))
    index = index.withColumn("event_id", F.when((F.col("number") == 9) & (F.col("sequence") == 1), first).otherwise(F.col("event_id")))
    foreign = F.when(F.col("number") == 3, F.lit("other")).otherwise(F.col("source.adapter"))
    return runs, events.withColumn("source", F.col("source").withField("adapter", foreign)), index


@query("""SELECT code, count(*) AS violations FROM (
SELECT 'ORPHAN_INDEX' AS code FROM te WHERE run_id LIKE '%5' UNION ALL SELECT 'COUNT_MISMATCH' FROM runs WHERE run_id LIKE '%7' AND events > 2
UNION ALL SELECT 'SEQUENCE_GAP' FROM runs WHERE run_id LIKE '%7' AND events > 3 UNION ALL SELECT 'PARITY' FROM te WHERE run_id LIKE '%7' AND sequence IN (1, 2) OR run_id LIKE '%9' AND sequence = 1
UNION ALL SELECT 'DUPLICATE_EVENT_ID' FROM runs WHERE run_id LIKE '%9' AND events > 1 UNION ALL SELECT 'SOURCE_MISMATCH' FROM te WHERE run_id LIKE '%3') GROUP BY code""")
def audit_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_store(*_damaged(spark, sf_dir)).groupBy("code").agg(F.count(F.lit(1)).alias("violations"))


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN sequence % 5 = 0 THEN 'ACTOR' END, CASE WHEN sequence % 7 = 0 THEN 'TIMESTAMP' END,
CASE WHEN sequence % 11 = 0 THEN 'KIND' END, CASE WHEN sequence % 13 = 0 THEN 'CONTENT_HASH' END], lambda x: x IS NOT NULL)) AS code FROM te) GROUP BY code""")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of events with defects at every fifth, seventh, ... place."""
    events = stored_events(spark, sf_dir)
    every = lambda n, bad, c: F.when(F.col("sequence") % n == 0, F.lit(bad)).otherwise(F.col(c))
    bad = events.withColumns({
        "actor": every(5, " ", "actor"), "ts_text": every(7, "2026-07-16T19:00:00+14:01", "ts_text"), "kind": every(11, "Other", "kind"),
        "content_sha256": every(13, "00", "content_sha256"),
    })
    return audit.validate_events(bad).select(F.explode("violations").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _runs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored run documents made of stored events; by a run's last digit, 0 repeats a key, 1 has a key too many, 2 has another
    adapter than its row, 3 has a sequence that is a text."""
    events = stored_events(spark, sf_dir)
    event = F.struct(
        F.col("event_id").alias("id"), F.col("run_id").alias("runId"), "sequence", F.col("ts_text").alias("timestamp"), "kind", "actor", "summary",
        F.from_json("payload", "k bigint").alias("payload"),
        F.struct(
            F.col("source.adapter").alias("adapter"), F.col("source.input_sha256").alias("inputSha256"), F.col("source.relative_path").alias("relativePath"),
            F.col("source.byte_offset").alias("byteOffset"), F.col("source.line").alias("line"), F.col("source.json_pointer").alias("jsonPointer"),
        ).alias("source"), "artifacts", F.col("content_sha256").alias("contentSha256"),
    )
    whole = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("sequence", event.alias("e")))).alias("events"))
    rows = stored_runs(events).join(whole, "run_id")
    run = F.struct(
        F.col("run_id").alias("id"), "name", F.col("input_sha256").alias("inputSha256"), "adapter", F.col("adapter_version").alias("adapterVersion"),
        F.col("imported_at").cast("string").alias("importedAt"), F.transform("events", lambda x: x["e"]).alias("events"), F.array().cast("array<int>").alias("diagnostics"),
    )
    rows, last = rows.withColumn("data_json", F.to_json(run, {"ignoreNullFields": "false"})), F.substring("name", -1, 1)
    more = lambda member: F.concat(F.lit("{" + member + ","), F.expr("substring(data_json, 2)"))
    text = F.when(last == "0", more('"id":1')).when(last == "1", more('"extra":1')).when(last == "3", F.replace("data_json", F.lit('"sequence":0,'), F.lit('"sequence":"0",')))
    version = F.when(last == "2", "2.0.0").otherwise(F.col("adapter_version"))
    return rows.withColumns({"data_json": text.otherwise(F.col("data_json")), "adapter_version": version}).drop("events")


@query(f"""SELECT {guid_sql('r')} AS run_id, sequence, {guid_sql('e')} AS event_id, summary, '{{"k":' || k || '}}' AS payload, CAST(sequence + 1 AS INTEGER) AS line, 100 * sequence AS byte_offset,
CAST(NULL AS VARCHAR) AS code FROM (SELECT *, sha256(event_id) AS e, sha256(run_id) AS r, json_extract_string(payload, '$.k') AS k FROM texts) WHERE right(run_id, 1) NOT IN ('0', '1', '2', '3')
UNION ALL SELECT {guid_sql('r')}, NULL, NULL, NULL, NULL, NULL, NULL, ['INVALID_JSON', 'UNKNOWN_KEYS', 'METADATA', 'FIELDS'][CAST(right(run_id, 1) AS INTEGER) + 1]
FROM (SELECT run_id, sha256(run_id) AS r FROM runs) WHERE right(run_id, 1) IN ('0', '1', '2', '3')""")
def load_run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of sound run documents, and violations of the others."""
    events, _, bad = audit.load_run_json(_runs_json(spark, sf_dir))
    rows = events.select("run_id", "sequence", "event_id", "summary", "payload", "source.line", "source.byte_offset")
    return rows.unionByName(bad, allowMissingColumns=True)


@query("SELECT count(DISTINCT user_id) AS runs, CAST(NULL AS VARCHAR) AS code FROM events", traces=False)
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.preflight(_runs_json(spark, sf_dir)).select("runs", "code")


@query("""SELECT d.doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 4 = 2 THEN NULL ELSE NULL END AS tool FROM documents d""", traces=False)
def tool_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload.tool of payloads made of documents: none, a text, a number, no object."""
    place = F.pmod("doc_id", F.lit(4))
    payload = F.when(place == 0, '{"other":1}').when(place == 1, F.to_json(F.struct(F.col("source").alias("tool")))).when(place == 2, '{"tool":5}').otherwise('["tool"]')
    return table(spark, sf_dir, "documents").withColumn("payload", payload).select("doc_id", candidates.tool_name("payload").alias("tool"))


@query("""SELECT event_id, coalesce(string_agg(event_id, ',') OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS before,
coalesce(string_agg(event_id, ',') OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM te""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = trace_events(spark, sf_dir).withColumn("event_text", F.col("summary")).withColumn("tool", F.lit(None).cast("string"))
    ids = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["event_id"]))
    return candidates.context_windows(events, 4, 2).select("event_id", ids("context_before").alias("before"), ids("context_after").alias("after"))


@query("""SELECT event_id AS short_id, sha256('{"adapter":"generic-jsonl","adapter_version":"1.0.0","event_content_sha256":"' || hash || '","run_input_sha256":"' || sha256(run_id) || '"}') AS source_hash FROM texts""")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stored_events(spark, sf_dir)
    rows = events.select("run_id", "short_id", "content_sha256").join(stored_runs(events), "run_id")
    return rows.select("short_id", candidates.source_hash().alias("source_hash"))


_OPTIONS = candidates.ExportOptions("fixture", "CC0-1.0", before=2)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stored_events(spark, sf_dir)
    category = F.element_at(F.array(*map(F.lit, candidates.CATEGORIES)), (F.conv(F.substring("run_id", -1, 1), 16, 10).cast("int") % 3) + 1)
    return candidates.build_candidates(stored_runs(events), events, _OPTIONS).withColumn("source_category", category)


_EVENT_TEXT_SQL = f"""SELECT {guid_sql('e')} AS event_id, '{{"actor":"' || CASE WHEN kind IN ('Error', 'ToolResult') THEN 'tool' ELSE 'agent' END || '","artifacts":[],"contentSha256":"' || hash
|| '","id":"' || {guid_sql('e')} || '","kind":"' || kind || '","payload":{{"k":' || k || '}},"runId":"' || {guid_sql('r')} || '","sequence":' || sequence
|| ',"source":{{"adapter":"generic-jsonl","byteOffset":' || 100 * sequence || ',"inputSha256":"' || r || '","jsonPointer":"/","line":' || sequence + 1 || ',"relativePath":"' || run_id
|| '.jsonl"}},"summary":"' || summary || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}}' AS event_text,
run_id, sequence, kind, hash, r FROM (SELECT *, sha256(event_id) AS e, sha256(run_id) AS r, json_extract_string(payload, '$.k') AS k FROM texts)"""


@query(f"SELECT event_id, event_text FROM ({_EVENT_TEXT_SQL})")
def canonical_event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.canonical_event_text(stored_events(spark, sf_dir)).select("event_id", "event_text")


_QUOTED_SQL = "replace(replace(event_text, '\\', '\\\\'), '\"', '\\\"')"
#: Candidates of all events: their ids, contexts and whole canonical JSON (without and with example_id).
_CANDIDATES_SQL = f""", events_of AS ({_EVENT_TEXT_SQL}), told AS (SELECT *, {guid_sql('r')} AS guid, {_QUOTED_SQL} AS quoted FROM events_of),
contexts AS (SELECT *, coalesce(string_agg('{{"event_id":"' || event_id || '","event_kind":"' || kind || '","event_text":"' || quoted || '","tool_name":null}}', ',') OVER w, '') AS context,
coalesce(string_agg(event_id, ',') OVER w, '') AS before, ['fake', 'fixture', 'live'][(strpos('0123456789abcdef', right(guid, 1)) - 1) % 3 + 1] AS category,
sha256('{{"adapter":"generic-jsonl","adapter_version":"1.0.0","event_content_sha256":"' || hash || '","run_input_sha256":"' || r || '"}}') AS source_hash
FROM told WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
parts AS (SELECT *, '{{"adapter":"generic-jsonl","adapter_version":"1.0.0","context_after":[],"context_before":[' || context || '],"event_id":"' || event_id || '","event_kind":"' || kind
|| '","event_text":"' || quoted || '",' AS head, '"license_or_consent":"CC0-1.0","lineage_id":"' || guid || '","redaction_version":"{VERSION}","run_id":"' || guid
|| '","schema_version":"1.0.0","source_category":"' || category || '","source_hash":"' || source_hash || '","task_group_id":"' || guid || '","tool_name":null}}' AS rest FROM contexts),
candidates AS (SELECT *, sha256(head || rest) AS example_id FROM parts) """


@query(_CANDIDATES_SQL + "SELECT event_id, guid AS run_id, kind AS event_kind, event_text, before, category AS source_category, source_hash FROM candidates")
def build_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw candidates of all events, with the ids of their contexts."""
    before = F.array_join("context_before.event_id", ",").alias("before")
    return _candidates(spark, sf_dir).select("event_id", "run_id", "event_kind", "event_text", before, "source_category", "source_hash")


@query(_CANDIDATES_SQL + "SELECT event_id, example_id, event_text, CAST(NULL AS VARCHAR) AS error_code FROM candidates")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all events through redaction and validation, with the hash of the whole of each as its id."""
    return candidates.candidate_gate(_candidates(spark, sf_dir)).select("event_id", "example_id", "event_text", "error_code")


@query(_CANDIDATES_SQL + """SELECT head || '"example_id":"' || example_id || '",' || rest AS line, (SELECT CAST(count(*) AS BIGINT) FROM te) AS written FROM candidates""")
def write_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written as JSON lines, read again, and the number that the writer tells."""
    folder = _folder(spark, "candidates")
    candidates.candidate_gate(_candidates(spark, sf_dir)).write.parquet(f"{folder}/gated")
    n = candidates.write_candidates(spark.read.parquet(f"{folder}/gated"), f"{folder}/jsonl")
    return spark.read.text(f"{folder}/jsonl").select(F.col("value").alias("line"), F.lit(n).cast("bigint").alias("written"))


@query(_CANDIDATES_SQL + "SELECT example_id, '' AS violations FROM candidates")
def validate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.validate_candidates(candidates.candidate_gate(_candidates(spark, sf_dir)))
    return found.select("example_id", F.concat_ws(",", "violations").alias("violations"))


def _teacher_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher labels of labelled documents: good ones accepted, others abstained; toxic ones lack what they need."""
    yes, ids = F.col("quality") == 1, F.array(F.concat(F.lit("e"), F.col("doc_id").cast("string")))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "labels").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("example_id"), ids.alias("available_event_ids"), (~yes).alias("abstained"), yes.alias("accepted"),
        F.when(yes, "Plan").alias("label"), F.when(yes, 0.75).alias("confidence"), F.when(yes, ids).otherwise(none).alias("evidence_event_ids"),
        F.when(yes & (F.col("toxic") == 0), "seen").alias("observable_reason"), F.when(~yes & (F.col("toxic") == 0), "unsure").alias("quarantine_reason"),
        "quality", "toxic", "doc_id",
    )


@query("SELECT sha256(CAST(doc_id AS VARCHAR)) AS example_id, CASE WHEN toxic = 1 THEN 'COMPLETE' ELSE '' END AS violations FROM labels", traces=False)
def validate_teacher_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.validate_teacher_labels(_teacher_labels(spark, sf_dir))
    return found.select("example_id", F.concat_ws(",", "violations").alias("violations"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of documents with the teacher labels of labelled ones that are not toxic."""
    docs, none = table(spark, sf_dir, "documents"), F.array().cast(f"array<{schemas.CONTEXT}>")
    number = F.substring("source", 4, 9).cast("int") % 3
    made = docs.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("example_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("event_id"), none.alias("context_before"),
        none.alias("context_after"), F.element_at(F.array(*map(F.lit, candidates.CATEGORIES)), number + 1).alias("source_category"), "doc_id",
    )
    labels = _teacher_labels(spark, sf_dir).filter("toxic = 0").dropDuplicates(["example_id"])
    given = {f: "t" if not f.endswith("hash") else "0" * 64 for f in contracts.TEACHER_FIELDS}
    split = F.element_at(F.array(*map(F.lit, contracts.SPLITS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return contracts.assemble_examples(made, labels, given, F.lit("2026-01-01").cast("timestamp"), split)


_EXAMPLES_SQL = """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE toxic = 0 GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(l.quality = 1, false) AS yes, l.doc_id IS NOT NULL AS labelled,
['fake', 'fixture', 'live'][CAST(substr(source, 4) AS INT) % 3 + 1] AS source, ['train', 'validation', 'test'][d.doc_id % 3 + 1] AS split
FROM documents d LEFT JOIN l USING (doc_id)) """


@query(_EXAMPLES_SQL + """SELECT doc_id, CASE WHEN yes THEN 'teacher_single' ELSE 'quarantined' END AS label_status, CASE WHEN yes THEN split END AS split,
CASE WHEN NOT yes THEN CASE WHEN labelled THEN 'unsure' ELSE 'no teacher label' END END AS quarantine_reason FROM x""", traces=False)
def assemble_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("doc_id", "label_status", "split", "quarantine_reason")


@query(_EXAMPLES_SQL + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS bad FROM x", traces=False)
def validate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.validate_examples(_examples(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("violations") > 0).alias("bad"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contracts.build_manifest(_examples(spark, sf_dir), docs.count())


def _whole_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents' examples, with the written trace files as its files."""
    files = contracts.manifest_files(spark, _written_traces(spark, sf_dir))
    given = {v: "1" for v in contracts.VERSIONS}
    return contracts.complete_manifest(_manifest(spark, sf_dir), files, given, F.lit("2026-01-01").cast("timestamp"))


@query(_EXAMPLES_SQL + """SELECT count(*) AS completed_count, count(*) FILTER (yes) AS accepted_count, count(*) FILTER (NOT yes) AS quarantined_count,
count(*) FILTER (yes AND split = 'train') AS train, count(*) FILTER (source = 'live') AS live, count(*) FILTER (yes AND split = 'test' AND source = 'fake') AS test_fake,
count(*) FILTER (NOT yes AND source = 'fixture') AS quarantined_fixture, count(*) FILTER (yes) AS plans, CAST(0 AS BIGINT) AS verifies FROM x""", traces=False)
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    return m.select(
        "completed_count", "accepted_count", "quarantined_count", F.col("split_counts")["train"].alias("train"), F.col("source_counts")["live"].alias("live"),
        F.col("split_source_counts")["test"]["fake"].alias("test_fake"), F.col("quarantined_source_counts")["fixture"].alias("quarantined_fixture"),
        F.col("class_counts")["Plan"].alias("plans"), F.col("class_counts")["Verify"].alias("verifies"),
    )


@query("SELECT '' AS violations, count(*) AS requested_count FROM documents", traces=False)
def validate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.validate_manifest(_whole_manifest(spark, sf_dir)).select(F.concat_ws(",", "violations").alias("violations"), "requested_count")


@query()
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted texts of all documents with their totals."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    rows = redaction.redact_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "redaction.redacted", "redaction.total", "redaction.error_code")


@query("""WITH m AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\pL\\pN_.+-])[\\pL\\pN_.+-]+@[\\pL\\pN_-]+(?:\\.[\\pL\\pN_-]+)+')) AS n FROM documents)
SELECT 'EMAIL' AS kind, count(*) AS rows, sum(n) AS replacements FROM m WHERE n > 0
UNION ALL SELECT 'PHONE', count(*), sum(n) FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\pL\\pN_])\\+[1-9][0-9 ().-]{8,30}[0-9]')) AS n FROM documents) WHERE n > 0""", traces=False)
def redaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements of e-mail addresses and phone numbers over all documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    rows = redaction.redact_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return redaction.redaction_totals(rows).filter(F.col("kind").isin("EMAIL", "PHONE"))


@query()
def redaction_totals_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements of every kind over all documents, those included that SQL can't say."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    rows = redaction.redact_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return redaction.redaction_totals(rows)


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\pL\\pN_.+-])[\\pL\\pN_.+-]+@[\\pL\\pN_-]+(?:\\.[\\pL\\pN_-]+)+')) AS n_email,
len(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\pL\\pN_])\\+[1-9][0-9 ().-]{8,30}[0-9]')) AS n_phone FROM documents""", traces=False)
def builtin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two built-in patterns in each document, counted in the JVM."""
    found = redaction.builtin_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.col("n_email").cast("bigint").alias("n_email"), F.col("n_phone").cast("bigint").alias("n_phone"))


@query()
def redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as JSON objects, with the text also under a secret key."""
    rows = table(spark, sf_dir, "conversations")
    whole = F.to_json(F.struct("role", "text", F.struct(F.col("text").alias("api_key")).alias("nested")))
    redacted = redaction.redact_json(rows.withColumn("json", whole), "json")
    return redacted.select("conv_id", "turn", "redaction.redacted", "redaction.counts", "redaction.error_code")


@query("SELECT conv_id, turn, 1 AS keyed, CAST(NULL AS VARCHAR) AS error_code FROM conversations", traces=False)
def redact_secret_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_json(spark, sf_dir).select("conv_id", "turn", F.col("counts")["KEYED"].alias("keyed"), "error_code")


@query()
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds in each document as it stands."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return redaction.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "found")


@query("SELECT 'Duplicate' AS outcome, count(DISTINCT user_id) AS files FROM events", traces=False)
def dedupe_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of importing all files a second time."""
    path, store = _written_traces(spark, sf_dir), _folder(spark, "store")
    traces.import_traces(spark, path, store)
    return traces.import_traces(spark, path, store).groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))


@query(f""", lines AS (SELECT run_id, sequence, '{{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || '","kind":"' || kind || '","actor":"'
|| CASE WHEN kind IN ('Error', 'ToolResult') THEN 'tool' ELSE 'agent' END || '","summary":"' || summary || '","payload":' || payload || '}}' AS line FROM te),
files AS (SELECT run_id, sha256(string_agg(line || chr(10), '' ORDER BY sequence) || CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN '{{"cut' || chr(10) ELSE '' END) AS f FROM lines GROUP BY run_id),
ids AS (SELECT run_id, sha256(f || '|generic-jsonl|1.0.0') AS h FROM files), named AS (SELECT run_id, {guid_sql('h')} AS id FROM ids),
events_of AS (SELECT sequence, sha256(line) AS content_sha256, sha256(replace(id, '-', '') || ':' || sequence || ':' || sha256(line)) AS e FROM lines JOIN named USING (run_id))
SELECT sequence, content_sha256, {guid_sql('e')} AS event_id FROM events_of""")
def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes and ids of all imported events."""
    none = spark.createDataFrame([], schemas.RUNS)
    made = traces.import_files(traces.read_trace_files(spark, _written_traces(spark, sf_dir)), none, keep=_folder(spark, "kept"))
    return made.events.select("sequence", "content_sha256", "event_id")


_IDS_SQL, _OF_REPORTS_SQL = _REPORT_SQL.split("SELECT run_id, identity AS content_identity_sha256, ")


@query(_IDS_SQL + "SELECT " + _OF_REPORTS_SQL)
def write_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all runs, written and read again."""
    from ..operators import views
    from .queries import export_report

    folder = _folder(spark, "reports")
    views.write_reports(export_report(spark, sf_dir), folder)
    return spark.read.text(folder).withColumnRenamed("value", "report")


@query("""SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT run_id, sum(82 + strlen(kind) + strlen(summary) + strlen(payload)
+ CASE WHEN kind IN ('Error', 'ToolResult') THEN 4 ELSE 5 END) + CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 6 ELSE 0 END AS bytes FROM te GROUP BY run_id)""")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and size of the written trace files, as a manifest lists them."""
    found = contracts.manifest_files(spark, _written_traces(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("files"), F.sum("byte_size").cast("bigint").alias("bytes"))


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN sequence < 1 THEN 'LINE' END, CASE WHEN sequence % 5 = 0 THEN 'BYTE_OFFSET' END,
CASE WHEN sequence % 7 = 0 THEN 'CODE' END, CASE WHEN sequence % 3 = 0 THEN 'MESSAGE' END], lambda x: x IS NOT NULL)) AS code FROM te WHERE kind = 'Error') GROUP BY code""")
def validate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of diagnostics with defects at every third, fifth, ... place."""
    every = lambda n, bad, good: F.when(F.col("sequence") % n == 0, F.lit(bad)).otherwise(F.lit(good))
    said = trace_events(spark, sf_dir).filter("kind = 'Error'").select(
        "run_id", F.col("sequence").cast("int").alias("line"), every(5, -1, 7).cast("bigint").alias("byte_offset"), every(7, " ", "INVALID_JSON").alias("code"),
        every(3, "", "Record is not a JSON object.").alias("message"),
    )
    return audit.validate_diagnostics(said).select(F.explode("violations").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT user_id) AS runs, CASE WHEN count(DISTINCT user_id) > 10 THEN 'RUN_COUNT_LIMIT' END AS code FROM events", traces=False)
def preflight_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops an export of more than ten runs."""
    return audit.preflight(_runs_json(spark, sf_dir), limits=audit.PreflightLimits(runs=10)).select("runs", "code")


@query("""SELECT CASE kind WHEN 'Error' THEN 'SOURCE_CATEGORY,EXAMPLE_ID' WHEN 'FileChange' THEN 'EXAMPLE_ID' WHEN 'Status' THEN 'EMPTY_FIELD,EXAMPLE_ID' ELSE '' END AS violations,
count(*) AS n FROM te GROUP BY 1""")
def candidate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of gated candidates of which those of some kinds have been changed."""
    made = candidates.candidate_gate(_candidates(spark, sf_dir))
    where = lambda kind, bad, c: F.when(F.col("event_kind") == kind, F.lit(bad)).otherwise(F.col(c))
    bad = made.withColumns({
        "source_category": where("Error", "other", "source_category"), "example_id": where("FileChange", "0" * 64, "example_id"),
        "license_or_consent": where("Status", "", "license_or_consent"),
    })
    found = contracts.validate_candidates(bad).select(F.concat_ws(",", "violations").alias("violations"))
    return found.groupBy("violations").agg(F.count(F.lit(1)).alias("n"))


@query(_EXAMPLES_SQL + """SELECT sha256(CAST(doc_id AS VARCHAR)) AS example_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN yes THEN '' ELSE 'STATE,' END || 'CONFIDENCE'
WHEN 1 THEN CASE WHEN yes THEN '' ELSE 'STATE,' END || 'EVIDENCE' ELSE '' END AS violations FROM x""", traces=False)
def example_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of examples of which two in five have been changed."""
    place = F.pmod("doc_id", F.lit(5))
    bad = _examples(spark, sf_dir).withColumns({
        "confidence": F.when(place == 0, 1.5).otherwise(F.col("confidence")),
        "evidence_event_ids": F.when(place == 1, F.array(F.lit("foreign"))).otherwise(F.col("evidence_event_ids")),
    })
    return contracts.validate_examples(bad).select("example_id", F.concat_ws(",", "violations").alias("violations"))


@query("""SELECT * FROM (VALUES ('none', ''), ('requested', 'LIFECYCLE,MANIFEST_ID'), ('path', 'PATHS,MANIFEST_ID'), ('id', 'MANIFEST_ID'), ('version', 'FIELDS,MANIFEST_ID'))
t(changed, violations), (SELECT count(*) AS completed_count FROM documents), (SELECT count(DISTINCT user_id) AS files FROM events)""", traces=False)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole manifest over all documents and the written trace files, and four that have been changed."""
    whole = _whole_manifest(spark, sf_dir).withColumn("changed", F.explode(F.array(*map(F.lit, ("none", "requested", "path", "id", "version")))))
    where = lambda name, bad, c: F.when(F.col("changed") == name, bad).otherwise(F.col(c))
    upper = F.transform(F.slice("files", 1, 1), lambda f: f.withField("path", F.upper(f["path"])))
    bad = whole.withColumns({
        "requested_count": where("requested", F.lit(0).cast("bigint"), "requested_count"), "files": where("path", F.concat("files", upper), "files"),
        "manifest_id": where("id", F.lit("0" * 64), "manifest_id"), "prompt_version": where("version", F.lit(None).cast("string"), "prompt_version"),
    })
    return contracts.validate_manifest(bad).select(
        "changed", F.concat_ws(",", "violations").alias("violations"), "completed_count",
        (F.size("files") - (F.col("changed") == "path").cast("int")).cast("bigint").alias("files"),
    )


@query("""SELECT 'run=' || run_id AS folder, CAST(sum(82 + strlen(kind) + strlen(summary) + strlen(payload)
+ CASE WHEN kind IN ('Error', 'ToolResult') THEN 4 ELSE 5 END) + CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 6 ELSE 0 END AS BIGINT) AS byte_size FROM te GROUP BY run_id""")
def manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths of the written trace files, without the names that Spark gives them, and their sizes."""
    found = contracts.manifest_files(spark, _written_traces(spark, sf_dir))
    return found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "byte_size")


@query("""SELECT run_id, CASE WHEN n > 70 THEN 'Rejected' WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 'Partial' ELSE 'Imported' END AS outcome,
CASE WHEN n > 70 THEN 'RECORD_COUNT_LIMIT' END AS code FROM (SELECT run_id, events + CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS n FROM runs)""")
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the streaming import of all files, of which those of more than 70 records are rejected."""
    path, store = _written_traces(spark, sf_dir), _folder(spark, "store")
    import_traces_stream(spark, path, store, traces.ImportLimits(records=70)).awaitTermination()
    return traces.stored(spark, store, "outcomes", schemas.OUTCOMES).select(F.regexp_extract("path", "run=(run-[0-9]+)", 1).alias("run_id"), "outcome", "code")


@query(_IDS_SQL + """SELECT '<!doctype html><meta charset="utf-8"><title>Trace report</title><pre>' || replace(replace(replace(replace(replace(report, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
'"', '&quot;'), '''', '&#39;') || '</pre>' AS page FROM (SELECT """ + _OF_REPORTS_SQL + ")")
def write_html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all runs as escaped pages, written and read again."""
    from ..operators import views
    from .queries import export_report

    folder = _folder(spark, "pages")
    views.write_reports(export_report(spark, sf_dir), folder, "html")
    return spark.read.text(folder).withColumnRenamed("value", "page")


@query(_REPORT_SQL.replace("SELECT run_id, identity AS content_identity_sha256, ", "SELECT run_id || '.json' AS name, ").replace("AS report FROM ids", "|| chr(10) AS content FROM ids"))
def write_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each run's report: names and whole contents."""
    from .queries import export_report

    folder = _folder(spark, "reports")
    report_files.write_report_files(export_report(spark, sf_dir), folder)
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.substring_index("_metadata.file_path", "/", -1).alias("name"), F.col("value").alias("content"))


@query("""SELECT run_id, sequence, event_id, sequence // 20 AS page, CASE WHEN sequence >= 20 THEN sequence // 20 * 20 - 1 END AS cursor,
CASE WHEN top > sequence // 20 * 20 + 19 THEN sequence // 20 * 20 + 19 END AS next_cursor FROM (SELECT *, max(sequence) OVER (PARTITION BY run_id) AS top FROM te)""")
def clustered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the layout for pages, each with the page of 20 that following cursors comes upon it."""
    folder = _folder(spark, "clustered")
    clustered_events.write_clustered(trace_events(spark, sf_dir), folder)
    pages = clustered_events.all_pages(clustered_events.read_clustered(spark, folder), 20)
    return pages.select("run_id", "sequence", "event_id", "page", "cursor", "next_cursor")


@query("""SELECT run_id, sha256(string_agg(line || chr(10), '' ORDER BY sequence) || CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN '{"cut' || chr(10) ELSE '' END) AS sha256
FROM (SELECT run_id, sequence, '{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || '","kind":"' || kind || '","actor":"'
|| CASE WHEN kind IN ('Error', 'ToolResult') THEN 'tool' ELSE 'agent' END || '","summary":"' || summary || '","payload":' || payload || '}' AS line FROM te) GROUP BY run_id""")
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the written trace files, as a manifest lists them, by run."""
    found = contracts.manifest_files(spark, _written_traces(spark, sf_dir))
    return found.select(F.regexp_extract("path", "run=(run-[0-9]+)", 1).alias("run_id"), "sha256")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN category IS NULL OR category NOT IN ('fake', 'fixture', 'live') THEN 'SOURCE_CATEGORY' END,
CASE WHEN coalesce(licence, '') IN ('', '  ') THEN 'LICENSE_OR_CONSENT' END, CASE WHEN mode = 'batch' THEN 'MODE' END, CASE WHEN before NOT BETWEEN 0 AND 64 THEN 'CONTEXT_BEFORE' END,
CASE WHEN after NOT BETWEEN 0 AND 64 THEN 'CONTEXT_AFTER' END, CASE WHEN mode = 'online' AND after <> 0 THEN 'LOOKS_AHEAD' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT event_id, ['fake', 'fixture', 'live', 'real', NULL][sequence % 5 + 1] AS category, ['CC0-1.0', 'consent', '', '  ', NULL, 'MIT'][sequence % 6 + 1] AS licence,
['online', 'offline', 'offline-analysis', 'batch'][k % 4 + 1] AS mode, k % 70 - 2 AS before, k % 67 - 1 AS after FROM te)""".replace("k % ", "CAST(substr(event_id, 4) AS BIGINT) % "))
def export_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export options made from every event, good ones and bad, and what of them doesn't hold."""
    events, number = trace_events(spark, sf_dir), F.substring("event_id", 4, 20).cast("bigint")
    at = lambda by, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    options = events.select(
        "event_id", at(F.col("sequence"), "fake", "fixture", "live", "real", None).alias("source_category"),
        at(F.col("sequence"), "CC0-1.0", "consent", "", "  ", None, "MIT").alias("license_or_consent"),
        at(number, "online", "offline", "offline-analysis", "batch").alias("mode"), (number % 70 - 2).alias("before"), (number % 67 - 1).alias("after"),
    )
    return options.select("event_id", F.concat_ws(",", candidates.option_violations()).alias("violations"))


_PEM = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
#: Lines with a secret, what is left of them, the kind in reports, and that in scans where it is another.
_PLANTED = (
    ("mail a.b@example.org now", "mail <REDACTED:EMAIL:1> now", "EMAIL", None), ("call +1 (212) 555-0100", "call <REDACTED:PHONE:1>", "PHONE", None),
    (_PEM, "<REDACTED:PRIVATE_KEY:1>", "PRIVATE_KEY", None), ("Bearer abcdefgh12", "<REDACTED:AUTH:1>", "AUTH", None),
    ("eyJabcdefg.abcdefg.abcdefg", "<REDACTED:JWT:1>", "JWT", None), ("ghp_" + "a" * 20, "<REDACTED:GITHUB_TOKEN:1>", "GITHUB_TOKEN", None),
    ("sk-" + "b" * 20, "<REDACTED:API_TOKEN:1>", "API_TOKEN", None), ("AIza" + "c" * 35, "<REDACTED:GOOGLE_API_KEY:1>", "GOOGLE_API_KEY", None),
    ("AKIA" + "D" * 16, "<REDACTED:AWS_ACCESS_KEY:1>", "AWS_ACCESS_KEY", None), ("https://user:pw@host/", "https://<REDACTED:URI_PASSWORD:1>@host/", "URI_PASSWORD", None),
    ("cd /home/ann/x", "cd <REDACTED:USER_PATH:1>/x", "USER_PATH", None), ("password = 'x y'", "password = '<REDACTED:CONNECTION_PASSWORD:1>'", "CONNECTION_PASSWORD", "ASSIGNMENT"),
    ("  MY_API_KEY_2=z; rest", "  MY_API_KEY_2=<REDACTED:ENV_SECRET:1>; rest", "ENV_SECRET", "ASSIGNMENT"),
    ("AWS_SECRET_ACCESS_KEY=abc", "AWS_SECRET_ACCESS_KEY=<REDACTED:AWS_SECRET:1>", "AWS_SECRET", "ASSIGNMENT"), ("<REDACTED:NOPE:4>", "<REDACTED:KEYED:1>", "KEYED", "PLACEHOLDER"),
)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their summary and two planted lines, by place in their run."""
    lines, n = F.array(*[F.lit(x[0]) for x in _PLANTED]), len(_PLANTED)
    at = lambda k: F.element_at(lines, (F.pmod(F.col("sequence") + k, F.lit(n)) + 1).cast("int"))
    return trace_events(spark, sf_dir).select("run_id", "sequence", F.concat_ws("\n", "summary", at(0), at(7)).alias("text"))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


_PLANTED_SQL = f""", planted AS (SELECT run_id, sequence, summary, sequence % {len(_PLANTED)} + 1 AS i, (sequence + 7) % {len(_PLANTED)} + 1 AS j, {_list_sql([x[1] for x in _PLANTED])} AS shown,
{_list_sql([x[2] for x in _PLANTED])} AS kinds, {_list_sql([x[3] or x[2] for x in _PLANTED])} AS seen FROM te) """


@query(_PLANTED_SQL + """SELECT run_id, sequence, concat_ws(chr(10), summary, shown[i], shown[j]) AS redacted, CAST(2 AS INTEGER) AS total, true AS passed,
array_to_string(list_sort([kinds[i], kinds[j]]), ',') AS kinds, CAST(NULL AS VARCHAR) AS error_code FROM planted""")
def redact_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all events with planted secrets of every kind, redacted."""
    rows = redaction.redact_text(_planted(spark, sf_dir), "text")
    kinds = F.concat_ws(",", F.array_sort(F.map_keys("redaction.counts"))).alias("kinds")
    return rows.select("run_id", "sequence", "redaction.redacted", "redaction.total", "redaction.passed", kinds, "redaction.error_code")


@query(_PLANTED_SQL + "SELECT kind, count(*) AS rows, count(*) AS replacements FROM (SELECT unnest([kinds[i], kinds[j]]) AS kind FROM planted) GROUP BY kind")
def redaction_totals_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements of every kind over the planted texts."""
    return redaction.redaction_totals(redaction.redact_text(_planted(spark, sf_dir), "text"))


@query(_PLANTED_SQL + "SELECT run_id, sequence, array_to_string(list_sort(list_distinct([seen[i], seen[j]])), ',') AS found FROM planted")
def scan_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds in the planted texts as they stand."""
    found = redaction.secret_scan(_planted(spark, sf_dir), "text")
    return found.select("run_id", "sequence", F.concat_ws(",", "found").alias("found"))
