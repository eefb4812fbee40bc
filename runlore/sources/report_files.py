"""One file for each report, none of which is ever written over.

Tasks write reports under names of their own in a staging folder and tell where; then tasks put each of them in place where
there is no file. If any place is taken, those that were put are taken away again and nothing has changed. Both steps can
run again after a lost executor: of a task that is repeated only the files that its last attempt told count, and a
place that holds the very file that was staged for it is not taken.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.views import rendered
from . import commit_log
from .stores import located
from .traces import bounded_batches

SUFFIX = {"json": ".json", "html": ".html"}


def file_name(run_id: str, kind: str) -> str:
    """The name of a run's report: its id with all but letters, digits and _.-~ escaped."""
    return quote(run_id, safe="") + SUFFIX[kind]


def write_report_files(reports: DataFrame, path: str, kind: str = "json") -> int:
    """Writes each of reports(run_id, report) to <path>/<run_id>.json or .html, as one line of JSON or an escaped page, and
    returns how many there are. FileExistsError, and nothing is changed, if one of these files is there already or a run has
    two reports. Rows without a run or report are an error. The folder has to be one that all tasks share."""
    spark = reports.sparkSession
    bounded_batches(spark)
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    rows = reports.select("run_id", F.concat(rendered(kind), F.lit("\n")).alias("value"))

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = located(f"{staging}/{uuid.uuid4().hex}")
        store.create_dir(folder, recursive=True)
        n = 0
        for b in batches:
            names, staged = [], []
            for run_id, value in zip(b["run_id"], b["value"], strict=True):
                if run_id is None or value is None:
                    raise ValueError("a report needs a run and a text")
                with store.open_output_stream(f"{folder}/{n}") as out:
                    out.write(value.encode())
                names.append(file_name(run_id, kind))
                staged.append(f"{folder}/{n}")
                n += 1
            yield pd.DataFrame({"name": pd.Series(names, dtype=object), "staged": pd.Series(staged, dtype=object)})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = located(path)
        for b in batches:
            done = [_put(store, s, f"{folder}/{n}") for n, s in zip(b["name"], b["staged"], strict=True)]
            yield pd.DataFrame({"name": b["name"], "put": pd.Series(done, dtype=bool)})

    def taken_away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = located(path)
        for b in batches:
            for n, s in zip(b["name"], b["staged"], strict=True):
                _take_away(store, s, f"{folder}/{n}")
            yield b[["name"]]

    try:
        rows.mapInPandas(stage, "name string, staged string").write.parquet(f"{staging}/_names")
        names = spark.read.schema("name string, staged string").parquet(f"{staging}/_names")
        names.mapInPandas(placed, "name string, put boolean").write.parquet(f"{staging}/_placed")
        result = spark.read.schema("name string, put boolean").parquet(f"{staging}/_placed")
        refused = [r["name"] for r in result.filter("not put").orderBy("name").limit(5).collect()]
        if refused:
            names.mapInPandas(taken_away, "name string").write.format("noop").mode("overwrite").save()
            raise FileExistsError(f"reports exist or come twice: {', '.join(refused)}")
        return result.count()
    finally:
        commit_log.removed(spark, staging)


def _put(store: fs.FileSystem, staged: str, target: str) -> bool:
    """Puts a staged file in place; False if the place is taken by another file. A local file is linked, which the system
    refuses if the name is taken; elsewhere it is moved where there is none. (A store whose moving isn't one step takes one
    writer.) A staged file is gone only where an attempt before has moved it."""
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(staged, target)
        except FileExistsError:
            return os.path.samefile(staged, target)
        return True
    here, there = (store.get_file_info(p).type != fs.FileType.NotFound for p in (staged, target))
    if not here or there:
        return there and not here
    store.move(staged, target)
    return True


def _take_away(store: fs.FileSystem, staged: str, target: str) -> None:
    """Undoes _put where it put this file."""
    if isinstance(store, fs.LocalFileSystem):
        if os.path.exists(target) and os.path.samefile(staged, target):
            os.unlink(target)
    elif store.get_file_info(staged).type == fs.FileType.NotFound and store.get_file_info(target).type != fs.FileType.NotFound:
        store.move(target, staged)
