"""The import of trace files as they arrive."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.commit_log import commits
from ..sources.traces import ImportLimits, _import
from .file_names import FileNames

#: Bytes of the files of a batch, unless one file alone has more.
BATCH_BYTES = 64 << 30


def import_traces_stream(
    spark: SparkSession, directory: str, store: str, limits: ImportLimits = ImportLimits(), batch_bytes: int = BATCH_BYTES, keep_on: bool = False
) -> StreamingQuery:
    """Imports the files of a directory that have not been seen, in batches of bounded bytes, then stops; or goes on
    with those that arrive (keep_on). Files without a byte are runs without events, those beyond the limit of bytes are
    rejected without being read. Each batch is an import: its rows and outcomes count by one entry in the store's log, which
    has the batch's number, so a batch that runs again after a failure is imported once. A directory may be given as a
    pattern whose last parts are wildcards; what is below its fixed part is read."""

    def batch(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        if any(c.batch == number for c in commits(session, store)):
            return
        if not files.isEmpty():
            _import(session, files.select("path", "length"), store, limits, batch=number)

    spark.dataSource.register(FileNames)
    fixed = directory.partition("*")[0].rpartition("/")[0] if "*" in directory else directory
    options = {"path": fixed, "log": f"{store}/_stream_files", "max_bytes": str(batch_bytes), "file_bytes": str(limits.total_bytes)}
    files = spark.readStream.format("runlore_file_names").options(**options).load()
    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/_stream").trigger(processingTime="0 seconds").start()
    if not keep_on:
        threading.Thread(target=_stopped_when_done, args=(query,), daemon=True).start()
    return query


def _stopped_when_done(query: StreamingQuery) -> None:
    """Stops a stream once it has imported all that it finds; a failure ends it with its own error."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
