"""Arrays in files of the folder that driver and executors share: written whole by one task, read by any worker.

In a mounted folder workers map them into memory. In another store (what pyarrow opens by its address, such as s3 or
hdfs) workers read the files that they need and keep the last ones, up to KEEP bytes. A file that isn't there or isn't
whole is an error, never an empty array.
"""

from __future__ import annotations

import gc
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir

#: Bytes of files out of other stores that a worker keeps.
KEEP = 512_000_000
#: Folders whose files a worker keeps mapped; those of older ones are let go.
FOLDERS = 2
_MAGIC = 0x52C3A11E


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = folder.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), folder if not rest else "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for files of this kind."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return folder


def put(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other, behind their lengths and widths. A task that runs again writes the same file, and
    each appears whole, by a rename."""
    store, path = _store(folder)
    head = np.array([_MAGIC, len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], np.uint64)
    made = f"{path}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(made) as out:
        out.write(head.tobytes())
        for a in arrays:
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
            out.write(b"\0" * (-a.nbytes % 8))
    store.move(made, f"{path}/{name}")


def arrays(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, as unsigned numbers of their widths."""
    key = f"{folder}/{name}"
    if key in _maps.get(folder, {}):
        return _maps[folder][key]
    store, path = _store(key)
    if isinstance(store, fs.LocalFileSystem):
        if folder not in _maps:
            while len(_maps) >= FOLDERS:
                _maps.popitem(last=False)
            _maps[folder] = {}
        return _maps[folder].setdefault(key, _split(np.memmap(path, np.uint8, "r"), key))
    if key not in _read:
        with store.open_input_file(path) as file:
            _read[key] = _split(np.frombuffer(file.read(), np.uint8), key)
        while len(_read) > 1 and sum(a.nbytes for x in _read.values() for a in x) > KEEP:
            _read.popitem(last=False)
    _read.move_to_end(key)
    return _read[key]


def _split(whole: np.ndarray, key: str) -> list[np.ndarray]:
    n = int(whole[8:16].view(np.uint64)[0]) if len(whole) >= 16 and int(whole[:8].view(np.uint64)[0]) == _MAGIC else -1
    head = whole[16 : 16 + 16 * n].view(np.uint64).astype(int).reshape(-1, 2) if n >= 0 else np.zeros((0, 2), int)
    at, out = 16 + 16 * n, []
    if n < 0 or len(head) != n or len(whole) != at + sum(x * w + -x * w % 8 for x, w in head):
        raise OSError(f"{key} is not a whole file of arrays")
    for length, width in head:
        out.append(whole[at : at + length * width].view(f"u{width}"))
        at += length * width + -length * width % 8
    return out


#: Of a Python worker.
_maps: OrderedDict[str, dict[str, list[np.ndarray]]] = OrderedDict()
_read: OrderedDict[str, list[np.ndarray]] = OrderedDict()


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, written as Parquet to a folder of the shared one and read again: their lineage is cut, and the shuffles
    that they came from are let go."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    let_shuffles_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def let_shuffles_go(spark: SparkSession) -> None:
    """Deletes the files of shuffles that no frame needs any more. Spark does so when the driver's garbage is collected, which
    comes with the driver's work and not with the disk that they take: with large tables they would all stay to a stage's end."""
    gc.collect()
    spark._jvm.System.gc()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder whose rows are needed no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
