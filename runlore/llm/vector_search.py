"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted by one coordinate, x' = (x, sqrt(M^2 - |x|^2)) with M the largest norm, and queries by a zero, so that
all lifted rows have norm M and the best product is the least distance. Every row is keyed by its nearest pivot and its
distance to it; rows of a pivot with distances between two edges make a cell, an annulus. For a query q and a cell
with distances r0 to r1 from pivot p, the triangle inequality gives each member x' a distance from q of at least
gap = max(0, d(q,p) - r1, r0 - d(q,p)), and with |x| <= m

    q.x = (|q|^2 + M^2 - |q - x'|^2) / 2 <= min((|q|^2 + M^2 - gap^2) / 2, |q| m).

A query first meets the cells of greatest bound that hold enough rows, which gives it a k-th score, and then those of
its other cells whose bound reaches that score; the others can't hold a better row. Pivots and edges are fitted on a
bounded sample, all rows are indexed, and bounds come from all rows, so results are exact. How much the bounds rule
out is up to the data: nothing where vectors point in all directions alike, in many dimensions.

Cells are met in blocks: rows and queries are dealt to blocks of bounded size, and each pair of blocks is one matrix
product. A cell's rows go to those groups of queries only that ask for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

#: Rows that pivots and edges are fitted on at most, and queries of a block.
SAMPLE, QUERY_BLOCK = 4096, 4096
MAX_PIVOTS, MAX_RINGS = 256, 16
#: Above this, sums of products in doubles could lose whole numbers.
EXACT = float(1 << 52)


def usable(vector: Column) -> Column:
    """Whether an array is not null and holds no null and no non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


@dataclass
class Index:
    """Lifted pivots (one row each), the distances that part each pivot's annuli, the square of the largest norm, and what
    is known of the cells."""

    pivots: np.ndarray
    edges: np.ndarray
    square: float = 0.0
    cells: pd.DataFrame | None = None

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.square - (vectors**2).sum(1))
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to the cell's pivot of each lifted vector."""
        d = self.distances(vectors)
        pivot = d.argmin(1)
        near = d[np.arange(len(d)), pivot]
        ring = (near[:, None] > self.edges[pivot]).sum(1)
        return pivot * (self.edges.shape[1] + 1) + ring, near

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        square = (vectors**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * vectors @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Of each query and cell, a number that no member's score exceeds."""
        c = self.cells
        d = self.distances(np.hstack([vectors, np.zeros((len(vectors), 1))]))[:, c["cell"].to_numpy() // (self.edges.shape[1] + 1)]
        gap = np.maximum(0, np.maximum(d - c["most"].to_numpy(), c["least"].to_numpy() - d))
        gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)  # what rounding may have added
        norm = np.sqrt((vectors**2).sum(1))[:, None]
        top = c["norm"].to_numpy()[None]
        return np.minimum((norm**2 + self.square - gap**2) / 2, norm * top) * (1 + np.sign(norm * top) * 1e-9) + 1


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        v = np.frombuffer(x, np.int64)
        out[i, : len(v)] = v
    return out


def fit_index(sample: np.ndarray, pivots: int, rings: int, square: float, steps: int = 8) -> Index:
    """Pivots as means of nearest lifted sample rows, from spread-out starts; edges as quantiles of distances. Equal
    inputs give equal results."""
    sample = Index(sample, sample, square).lifted(sample)
    start = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    for _ in range(min(pivots, len(sample)) - 1):
        start.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[start[-1]]) ** 2).sum(1))
    centres = sample[start].copy()
    for _ in range(steps):
        near = Index(centres, np.zeros((len(centres), 0))).place(sample)[0]
        for p in np.unique(near):
            centres[p] = sample[near == p].mean(0)
    index = Index(centres, np.zeros((len(centres), 0)))
    near, d = index.place(sample)
    shares = np.arange(1, rings) / rings
    edges = [np.quantile(d[near == p], shares) if (near == p).any() else np.zeros(rings - 1) for p in range(len(centres))]
    return Index(centres, np.array(edges).reshape(len(centres), rings - 1), square)


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", factor: float = 256.0,
    pivots: int | None = None, rings: int | None = None, block: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that is_query (a condition on "id") the k rows other than itself
    with the greatest inner product of components floor(factor * x), ties to the smaller id; all, if there are fewer.

    Rows with a null id, or whose vector is null or holds null or non-finite components, take no part. Shorter
    vectors count as if zeros followed. Each row is its own, so of rows of equal id each is a query, with ranks of its
    own, and a candidate of the others. Scores have to fit in 64 bits."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = checkpointed(rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * factor)).alias("v")))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # kept with the members below, so it stays
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    n, dim, square, largest = rows.agg(
        F.count(F.lit(1)), F.max(F.size("v")), F.max(norm), F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    ).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    found_schema = f"query bigint, {schema}"
    if not n:
        return spark.createDataFrame([], schema)
    dim, whole = max(1, dim), float(largest or 0) ** 2 * max(1, dim) < EXACT
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()
    matrix = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        matrix[i, : len(r["v"])] = r["v"]
    pivots = pivots or min(MAX_PIVOTS, max(4, n // 8192))
    rings = rings or min(MAX_RINGS, max(2, n // (pivots * 2048)))
    block = block or min(8192, max(256, n // 64))
    index = fit_index(matrix, pivots, rings, square or 0.0)
    shared = spark.sparkContext.broadcast(index)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [np.asarray(v, np.int64).tobytes() for v in b["v"]]
            m = _matrix(packed, dim)
            cell, distance = shared.value.place(shared.value.lifted(m))
            yield pd.DataFrame({"row": b["row"], "id": b["id"], "vec": packed, "cell": cell, "distance": distance, "norm": np.sqrt((m**2).sum(1))})

    members = checkpointed(
        numbered.mapInPandas(placed, T.StructType([*_fields("row bigint"), T.StructField("id", rows.schema["id"].dataType), *_fields("vec binary, cell int, distance double, norm double")]))
    )
    cells = members.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"), F.max("norm").alias("norm")
    ).orderBy("cell").toPandas()  # at most MAX_PIVOTS * MAX_RINGS rows, of any input
    directory = spark.sparkContext.broadcast(Index(index.pivots, index.edges, index.square, cells))
    blocks = {int(c): max(1, math.ceil(m / block)) for c, m in zip(cells["cell"], cells["n"], strict=True)}
    pieces = F.broadcast(spark.createDataFrame([*blocks.items()], "cell int, pieces int"))
    queries = members.filter(is_query).select("row", "id", "vec")
    groups = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    of_row = members.select("row", "id", "vec", "cell").join(pieces, "cell").select(
        "row", "id", "vec", "cell", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece")
    )

    def wanted(first: bool):
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = directory.value
            cell = index.cells["cell"].to_numpy()
            count = index.cells["n"].to_numpy()
            for b in batches:
                bound = index.bounds(_matrix(b["vec"], dim))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(count[order], 1)
                nearest = held - count[order] <= 4 * k  # the first cells, until they hold enough rows
                chosen = np.zeros(bound.shape, bool)
                np.put_along_axis(chosen, order, nearest, 1)
                if not first:
                    chosen = ~chosen & (bound >= b["kth"].to_numpy(float, na_value=-np.inf)[:, None])
                q, c = np.nonzero(chosen)
                yield pd.DataFrame({"row": b["row"].to_numpy()[q], "id": b["id"].to_numpy()[q], "vec": b["vec"].to_numpy()[q], "cell": cell[c]})

        return ask

    asked_schema = T.StructType([*_fields("row bigint"), T.StructField("id", rows.schema["id"].dataType), *_fields("vec binary, cell int")])

    def meet(asking: DataFrame, first: bool) -> DataFrame:
        """The best rows for each query from each block of the cells that it asks for."""
        asked = asking.mapInPandas(wanted(first), asked_schema).join(pieces, "cell").select(
            "row", "id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"),
        )
        asked = checkpointed(asked)
        parts = asked.select(F.col("cell").alias("of"), F.col("part").alias("part")).distinct()
        dealt = of_row.join(parts, F.col("cell") == F.col("of")).drop("of")
        keys = ("cell", "piece", "part")
        return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, found_schema)

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({c.split()[0]: [] for c in found_schema.split(", ")})
        x = x.sort_values("id", kind="stable")
        a, b = _matrix(q["vec"], dim), _matrix(x["vec"], dim)
        scores = a @ b.T if whole else a.astype(np.int64) @ b.astype(np.int64).T
        scores = scores.astype(np.int64)
        ids, asks, own, query = x["id"].to_numpy(), q["id"].to_numpy(), x["row"].to_numpy(), q["row"].to_numpy()
        out = []
        for i in range(len(q)):
            s, other = scores[i], own != query[i]
            s, at = s[other], ids[other]
            if len(s) > k:
                floor = np.partition(s, len(s) - k)[len(s) - k]
                above, level = np.nonzero(s > floor)[0], np.nonzero(s == floor)[0]
                keep = np.concatenate([above, level[: k - len(above)]])  # ids ascend, so ties go to the smaller
                s, at = s[keep], at[keep]
            out.append(pd.DataFrame({"query": query[i], "query_id": asks[i], "rank": 0, "vec_id": at, "score": s}))
        return pd.concat(out)

    def ranked(found: DataFrame) -> DataFrame:
        ordered = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", ordered).filter(F.col("rank") <= k)

    near = checkpointed(ranked(meet(queries, True)))
    kth = near.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    kth = kth.select(F.col("query").alias("of"), F.when(F.col("n") >= k, F.col("low")).cast("double").alias("kth"))
    rest = meet(queries.join(kth, F.col("row") == F.col("of"), "left").select("row", "id", "vec", "kth"), False)
    return ranked(near.unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def _fields(ddl: str) -> list[T.StructField]:
    return [T.StructField(x.split()[0], {"bigint": T.LongType(), "binary": T.BinaryType(), "int": T.IntegerType(), "double": T.DoubleType()}[x.split()[1]]) for x in ddl.split(", ")]


TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.row <> q.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
