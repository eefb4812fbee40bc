"""Shuffles of rows that are stored don't stay on disk."""

import gc
import time

from runlore.llm import shared_files


def test_stored_rows_leave_no_shuffle(spark, tmp_path):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before = held()
    for i in range(8):  # two shuffles each, of which the last may still be in use
        shared_files.stored(spark.range(5000).repartition(3).groupBy("id").count(), str(tmp_path), str(i))
    for _ in range(20):  # the cleaner works in a thread of its own
        if held() <= before + 4:
            break
        time.sleep(0.5)
    assert held() <= before + 4
