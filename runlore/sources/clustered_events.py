"""Events sorted by run and sequence, so that a page of one run reads little.

Files hold ranges of (run_id, sequence) and are sorted, in small row groups, so a filter on both passes over all row groups
and pages but those that hold the answer. A table with one row for each file, its first and last run, tells which files can hold a
run: of many thousand files a page opens one or two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.views import DEFAULT_PAGE, MAX_PAGE, event_page
from . import commit_log

ROW_GROUP_BYTES, PAGE_ROWS = 8 << 20, 2_000
#: Events of a file, about.
FILE_ROWS = 1_000_000
RANGES = "file string, first_run string, last_run string, events bigint"


def write_clustered(events: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Writes events in this layout to a new folder. Ranges are cut by Spark's sample of the keys, so a run of any number
    of events is spread over as many files as it takes."""
    spark = events.sparkSession
    n = max(1, -(-events.count() // file_rows))
    dealt = events.repartitionByRange(n, "run_id", "sequence").sortWithinPartitions("run_id", "sequence")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.row.count.limit": PAGE_ROWS}
    dealt.write.options(**options).parquet(f"{path}/events")
    ranges = spark.read.schema(events.schema).parquet(f"{path}/events").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.count(F.lit(1)).alias("events")
    )
    ranges.repartition(1).write.parquet(f"{path}/ranges")  # last, so a layout with ranges is a whole one


def read_clustered(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """All events of a layout, or those of one run, of which only the files that can hold it are opened."""
    if not commit_log.exists(spark, f"{path}/ranges/_SUCCESS"):
        raise FileNotFoundError(f"no whole layout at {path}")
    whole = spark.read.parquet(f"{path}/events")
    if run_id is None:
        return whole
    files = spark.read.schema(RANGES).parquet(f"{path}/ranges").filter((F.col("first_run") <= run_id) & (F.col("last_run") >= run_id))
    names = [r["file"] for r in files.select("file").collect()]  # those of one run
    found = spark.read.schema(whole.schema).parquet(*names) if names else spark.createDataFrame([], whole.schema)
    return found.filter(F.col("run_id") == run_id)


def run_page(spark: SparkSession, path: str, run_id: str, cursor: int | None = None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """event_page of one run, from a layout."""
    return event_page(read_clustered(spark, path, run_id), cursor, limit)


def all_pages(events: DataFrame, limit: int = DEFAULT_PAGE) -> DataFrame:
    """Each event on the page that following next_cursor from the run's first page comes upon it: events with page (from
    0), cursor (that asks for the page; null for the first) and next_cursor (null on the last). A run's sequences are
    unique, as imports make them."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError("bad limit")
    order, page = Window.partitionBy("run_id").orderBy("sequence"), Window.partitionBy("run_id", "page")
    placed = events.withColumn("page", F.floor((F.row_number().over(order) - 1) / limit).cast("bigint"))
    near = placed.withColumn("before", F.lag("sequence").over(order)).withColumn("after", F.lead("sequence").over(order))
    more = F.max("after").over(page) > F.max("sequence").over(page)
    return near.select(
        *events.columns, "page", F.when(F.col("page") > 0, F.min("before").over(page)).alias("cursor"), F.when(more, F.max("sequence").over(page)).alias("next_cursor")
    )
