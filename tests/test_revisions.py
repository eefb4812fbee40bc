"""Stored analysis revisions."""

import threading

from pyspark.sql import functions as F

from runlore.operators import analysis, detect
from runlore.plans.driver_views import trace_events, trace_runs
from runlore.sources import commit_log, revisions

SF = "/root/testdata/sf0.001"


def at():
    return F.lit("2026-01-01").cast("timestamp")


def few(spark, below):
    events = trace_events(spark, SF).filter(f"sequence < {below}").filter(F.substring("run_id", 5, 9).cast("int") < 6)
    return trace_runs(events), events


def count(spark, store, name, schema):
    return commit_log.read(spark, store, name, schema, commit_log.commits(spark, store, log=revisions.LOG)).count()


def test_a_revision_for_each_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(revisions, "SNAPSHOT_EVERY", 2)
    store, (runs, events) = str(tmp_path / "store"), few(spark, 10)
    n = runs.count()
    for _ in range(2):
        outcomes = revisions.analyze_into(spark, store, runs, events, at())
        assert {r.outcome for r in outcomes.collect()} == {"Completed"}
        assert revisions.revisions(spark, store).count() == n
        assert count(spark, store, "classifications", revisions.CLASSIFICATIONS) == events.count()
    one = runs.limit(1).first().run_id
    changed = events.filter((F.col("run_id") != one) | (F.col("sequence") > 0))
    revisions.analyze_into(spark, store, runs, changed, at())
    newest = {r.run_id: r.ingest_ordinal for r in revisions.newest_revisions(spark, store).collect()}
    assert newest == {r: int(r == one) for r in newest} and len(newest) == n  # of equal times the later entry counts
    assert revisions.revisions(spark, store).count() == n + 1
    assert (tmp_path / "store" / "_newest" / f"{1:020d}.json").exists()  # after two entries
    revisions.analyze_into(spark, store, runs, events, at())  # as at first, but not as the newest one
    assert revisions.revisions(spark, store).count() == n + 2
    whole = {tuple(r) for r in analysis.latest_analysis(revisions.revisions(spark, store)).select("run_id", "analysis_id").collect()}
    assert whole == {tuple(r) for r in revisions.newest_revisions(spark, store).select("run_id", "analysis_id").collect()}
    revisions.analyze_into(spark, store, runs, events, at(), only_changed=False)
    assert revisions.revisions(spark, store).count() == 2 * n + 2


def test_two_at_the_same_time_keep_one(spark, tmp_path):
    store, (runs, events) = str(tmp_path / "store"), few(spark, 6)
    writers = [threading.Thread(target=lambda: revisions.analyze_into(spark, store, runs, events, at())) for _ in range(2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert revisions.revisions(spark, store).count() == runs.count()
    assert count(spark, store, "classifications", revisions.CLASSIFICATIONS) == events.count()


def test_alerts_of_a_code_are_read_from_its_folders(spark, tmp_path):
    store, events = str(tmp_path / "store"), trace_events(spark, SF)
    revisions.analyze_into(spark, store, trace_runs(events), events, at())
    every = revisions.stored_alerts(spark, store)
    codes = {r.code: r["count"] for r in every.groupBy("code").count().collect()}
    assert codes == {r.code: r.alerts for r in analysis.alert_summary(detect.detect_all(revisions_labels(events))).collect()}
    code = min(codes)
    found = revisions.stored_alerts(spark, store, code)
    assert found.count() == codes[code]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(code#" in plan.partition("PartitionFilters: [")[2].partition("]")[0] and f"= {code})" in plan


def revisions_labels(events):
    from runlore.operators.classify import label_steps

    return label_steps(events)


def test_nothing_stored(spark, tmp_path):
    store = str(tmp_path / "store")
    assert revisions.newest_revisions(spark, store).count() == 0 and revisions.stored_alerts(spark, store).count() == 0
    revisions.snapshot(spark, store)
    runs, events = few(spark, 0)
    revisions.analyze_into(spark, store, runs, events, at())
    assert commit_log.commits(spark, store, log=revisions.LOG) == []
