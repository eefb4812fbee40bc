"""Analysis revisions that are kept: appended under a log of their own, newest first, older ones stay.

Each time runs are analysed, the revisions of those whose content hash has changed are written to folders of their own and
committed by one entry in the log _revisions. The entry's number is the ingest ordinal of all its revisions, so of revisions
of equal time the one that was committed later is the newer. What is newest is told by the last snapshot and the entries after
it, so analysing again reads neither the whole history nor any steps.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import Analysis, alert_index, analyze_runs, latest_analysis
from . import commit_log
from .commit_log import Commit

LOG, SNAPSHOTS = "_revisions", "_newest"
TABLES = ("analyses", "classifications", "alerts", "alert_index")
ANALYSES = (
    "analysis_id string, run_id string, status string, created_at timestamp, classifier_id string, classifier_version string, content_sha256 string, failure string"
)
CLASSIFICATIONS = "run_id string, event_id string, sequence bigint, label string, confidence double, evidence_event_ids array<string>, analysis_id string"
ALERT_INDEX = "analysis_id string, ordinal int, run_id string, start_sequence bigint, end_sequence bigint, code string"
#: Entries after which a new snapshot of the newest revisions is made.
SNAPSHOT_EVERY = 16


def revisions(spark: SparkSession, store: str, after: int = -1) -> DataFrame:
    """All revisions (ANALYSES), with ingest_ordinal."""
    return _numbered(spark, store, commit_log.commits(spark, store, after, LOG))


def _numbered(spark: SparkSession, store: str, of: list[Commit]) -> DataFrame:
    rows = commit_log.read(spark, store, "analyses", ANALYSES, of)
    numbers = spark.createDataFrame([(c.id, c.number) for c in of], "import_id string, ingest_ordinal bigint")  # one row for each entry
    return rows.join(F.broadcast(numbers), "import_id").drop("import_id")


def newest_revisions(spark: SparkSession, store: str) -> DataFrame:
    """The newest revision of each run: of the last snapshot and of the entries after it."""
    number, rows = _snapshot(spark, store)
    later = revisions(spark, store, number)
    return latest_analysis(later if rows is None else rows.unionByName(later))


def _snapshot(spark: SparkSession, store: str) -> tuple[int, DataFrame | None]:
    where, fs = commit_log._hadoop(spark, f"{store}/{SNAPSHOTS}")
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return -1, None
    stream = fs.open(commit_log._hadoop(spark, f"{store}/{SNAPSHOTS}/{max(numbers):020d}.json")[0])
    folder = json.loads(bytes(stream.readAllBytes()))["folder"]
    stream.close()
    return max(numbers), spark.read.schema(f"{ANALYSES}, ingest_ordinal bigint").parquet(f"{store}/{folder}")


def snapshot(spark: SparkSession, store: str) -> None:
    """Stores the newest revisions as of the last entry, for later readers. Of several writers one counts."""
    done = commit_log.commits(spark, store, log=LOG)
    if not done:
        return
    folder = f"newest/{uuid.uuid4().hex}"
    newest_revisions(spark, store).filter(F.col("ingest_ordinal") <= done[-1].number).write.parquet(f"{store}/{folder}")
    if not commit_log.put_new(spark, f"{store}/{SNAPSHOTS}/{done[-1].number:020d}.json", json.dumps({"folder": folder}).encode()):
        commit_log.removed(spark, f"{store}/{folder}")


def analyze_into(
    spark: SparkSession, store: str, runs: DataFrame, events: DataFrame, created_at: Column, requested: DataFrame | None = None, only_changed: bool = True
) -> DataFrame:
    """Analyses runs (analyze_runs) and appends their revisions to the store; returns the outcomes of the requested runs.
    Runs whose content hash is that of their newest revision get no new one (only_changed=False: each gets one each time).
    What others commit meanwhile is looked at before this is committed, so of equal analyses at the same time one is kept."""
    made = analyze_runs(runs, events, created_at, requested)
    number, ordinal = uuid.uuid4().hex, _last(spark, store)
    analyses = made.analyses
    if only_changed:
        analyses = analyses.join(newest_revisions(spark, store).select("run_id", "content_sha256"), ["run_id", "content_sha256"], "left_anti")
    analyses = _put(analyses.select(*made.analyses.columns), store, "analyses", number)
    while True:
        newer = commit_log.commits(spark, store, ordinal, LOG)
        if newer:
            ordinal = newer[-1].number
            if only_changed:
                same = _numbered(spark, store, newer).select("run_id", "content_sha256")
                number = uuid.uuid4().hex
                analyses = _put(analyses.join(same, ["run_id", "content_sha256"], "left_anti").select(*analyses.columns), store, "analyses", number)
        if not _committed(spark, store, made, analyses, number, ordinal + 1):
            continue
        if (ordinal + 2) % SNAPSHOT_EVERY == 0:
            snapshot(spark, store)
        return made.outcomes


def _last(spark: SparkSession, store: str) -> int:
    done = commit_log.commits(spark, store, log=LOG)
    return done[-1].number if done else -1


def _committed(spark: SparkSession, store: str, made: Analysis, analyses: DataFrame, number: str, ordinal: int) -> bool:
    """Writes the steps and alerts of these revisions, and the index of alerts in a folder for each code, and commits them."""
    if analyses.isEmpty():
        return True  # nothing has changed, so there is nothing to commit
    if not commit_log.exists(spark, commit_log.folder(store, "classifications", number)):
        ids = analyses.select("analysis_id")
        _put(made.classifications.join(ids, "analysis_id", "left_semi"), store, "classifications", number)
        alerts = _put(made.alerts.join(ids, "analysis_id", "left_semi"), store, "alerts", number)
        alert_index(alerts).write.partitionBy("code").parquet(commit_log.folder(store, "alert_index", number))
    return commit_log.try_commit(spark, store, Commit(ordinal, number, TABLES), LOG)


def _put(df: DataFrame, store: str, table: str, number: str) -> DataFrame:
    where = commit_log.folder(store, table, number)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def stored_alerts(spark: SparkSession, store: str, code: str | None = None) -> DataFrame:
    """The index of alerts of all revisions, or of one code, of which the folders of that code alone are read."""
    found = commit_log.read(spark, store, "alert_index", ALERT_INDEX, commit_log.commits(spark, store, log=LOG)).drop("import_id")
    return found if code is None else found.filter(F.col("code") == code)
