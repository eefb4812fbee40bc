"""A stream of the names and lengths of files as they appear in a directory, empty and very large ones included.

Contents are not read here. A new offset admits files up to a number of bytes and of names; which files it admits is written to a log
beside the stream's checkpoint before it is used, so a batch that runs again gets the same files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAMES = "path string, length bigint"
#: Files of a batch, whose names its import lists.
MOST_FILES = 50_000


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """A file system, the path in it, and what comes before that path in a file's name."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), os.path.abspath(path if not rest else "/" + rest.lstrip("/")), "file:"
    store, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else f"{scheme}://"


class FileNames(DataSource):
    """Options: path (a directory, read with all below it; names that begin with _ or . don't count), log (a folder for
    what has been admitted), max_bytes (of a batch; a file of more than file_bytes counts as none, as it will not be read)."""

    @classmethod
    def name(cls) -> str:
        return "runlore_file_names"

    def schema(self) -> str:
        return NAMES

    def streamReader(self, schema) -> FileNamesReader:  # noqa: N802
        return FileNamesReader(self.options)


class FileNamesReader(DataSourceStreamReader):
    """Offsets are numbers of admissions; admission n holds a list of files in the log."""

    def __init__(self, options: dict):
        self.path, self.log = options["path"], options["log"]
        self.max_bytes, self.file_bytes = int(options["max_bytes"]), int(options["file_bytes"])
        self.admitted: int | None = None
        self.seen: set[str] = set()

    def _load(self) -> None:
        store, folder, _ = _opened(self.log)
        store.create_dir(folder, recursive=True)
        self.admitted = 0
        while store.get_file_info(f"{folder}/{self.admitted}.json").type == fs.FileType.File:
            self.seen.update(p for p, _ in self._files(self.admitted))
            self.admitted += 1

    def _files(self, n: int) -> list[tuple[str, int]]:
        store, folder, _ = _opened(self.log)
        with store.open_input_stream(f"{folder}/{n}.json") as file:
            return [tuple(x) for x in json.loads(file.read())]

    def _listed(self) -> list[tuple[str, int]]:
        store, folder, prefix = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(folder) :].split("/") if x)
        files = [(f.mtime_ns or 0, prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path)]
        return [(p, size) for _, p, size in sorted(files) if p not in self.seen]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"admitted": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.admitted is None:
            self._load()
        chosen, held = [], 0
        for path, size in self._listed():
            counted = size if size <= self.file_bytes else 0
            if chosen and held + counted > self.max_bytes or len(chosen) == MOST_FILES:
                break
            chosen.append((path, size))
            held += counted
        if chosen:
            store, folder, _ = _opened(self.log)
            made = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(made) as out:
                out.write(json.dumps(chosen).encode())
            store.move(made, f"{folder}/{self.admitted}.json")
            self.seen.update(p for p, _ in chosen)
            self.admitted += 1
        return {"admitted": self.admitted}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(n) for n in range(start["admitted"], end["admitted"])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        yield from self._files(partition.value)

    def commit(self, end: dict) -> None:
        """Nothing is let go: names that were admitted are not to be admitted again."""
