"""Sorted arrays of 64-bit hashes with values, in files of the shared folder, that tasks look hashes up in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_files import arrays, new_folder, put

#: Keys of a file on average.
FILE_KEYS = 2_000_000


class HashFiles:
    """A multimap from 64-bit hashes to 64-bit values. It can be pickled; each worker maps the files that it needs, so
    its own memory doesn't grow with them."""

    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, files
        #: Number of keys, sum of values (exact below 2^53), and greatest value.
        self.keys = self.total = self.greatest = 0

    @classmethod
    def written(cls, df: DataFrame, rows: int) -> HashFiles:
        """The files of df(key bigint, value bigint), which is taken to have so many rows at most. Each file is written,
        also where it has no keys, so one that is missing later is an error. Content depends on df alone."""
        spark = df.sparkSession
        folder, files = new_folder(spark, "hashes"), max(8, math.ceil(rows / FILE_KEYS))

        def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part[part["counts"]]
            order = np.lexsort((part["value"], part["key"]))
            put(folder, str(key[0]), part["key"].to_numpy()[order], part["value"].to_numpy()[order])
            return pd.DataFrame({"n": [len(part)], "total": [part["value"].to_numpy(float).sum()], "most": [int(part["value"].max()) if len(part) else 0]})

        parted = df.select("key", "value", F.pmod("key", F.lit(files)).alias("file"), F.lit(True).alias("counts"))
        every = spark.range(0, files, 1, 1).selectExpr("0L key", "0L value", "id file", "false counts")
        written = parted.unionByName(every).repartition(files, "file").groupBy("file").applyInPandas(write, "n bigint, total double, most bigint")
        out = cls(folder, files)
        out.keys, out.total, out.greatest = (int(x) for x in written.agg(F.sum("n"), F.sum("total"), F.max("most")).first())
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in keys (int64) and values of all matches."""
        places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for file, at in by_number(keys % self.files):
            stored, value = (x.view(np.int64) for x in arrays(self.folder, str(file)))
            wanted = keys[at]
            low = np.searchsorted(stored, wanted, "left")
            n = np.searchsorted(stored, wanted, "right") - low
            hit = np.flatnonzero(n)
            n = n[hit]
            places.append(np.repeat(at[hit], n))
            values.append(value[np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(places), np.concatenate(values)


def by_number(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different number and where it stands."""
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(number[at[0]]), at


class Repeated:
    """Which 64-bit hashes are sent at least twice: exact for those that are, and true of few others, as only part of
    a hash's bits is sent and kept (of shard: hash % shards, 32 bits of what is left)."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    @staticmethod
    def packed(hashes: np.ndarray, shards: int) -> pd.DataFrame:
        """Rows (shard, keys) of hashes (uint64): sorted keys of each shard, those that repeat here twice."""
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        key = (hashes // np.uint64(shards)).astype(np.uint32)
        order = np.lexsort((key, shard))
        shard, key = shard[order], key[order]
        keep = np.ones(len(key), bool)
        keep[2:] = (key[2:] != key[:-2]) | (shard[2:] != shard[:-2])
        shard, key = shard[keep], key[keep]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
        runs = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pd.DataFrame({"shard": [int(shard[a]) for a, _ in runs], "keys": pd.Series([key[a:b].tobytes() for a, b in runs], dtype=object)})

    @classmethod
    def written(cls, df: DataFrame, shards: int) -> Repeated:
        """From df(shard int, keys binary) as packed makes it."""
        spark = df.sparkSession
        folder = new_folder(spark, "repeated")

        def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            keys = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in part["keys"]]))
            again = keys[1:][keys[1:] == keys[:-1]]
            again = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
            put(folder, str(key[0]), again)
            return pd.DataFrame({"n": [len(again)]})

        every = spark.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"))
        df.unionByName(every).repartition(shards, "shard").groupBy("shard").applyInPandas(write, "n bigint").agg(F.sum("n")).first()
        return cls(folder, shards)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash (uint64), whether it is sent twice."""
        out = np.zeros(len(hashes), bool)
        key = (hashes // np.uint64(self.shards)).astype(np.uint32)
        for shard, at in by_number((hashes % np.uint64(self.shards)).astype(np.int64)):
            (known,) = arrays(self.folder, str(shard))
            if len(known):
                wanted = key[at]
                out[at] = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
        return out
