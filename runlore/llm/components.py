"""Connected components of a graph that is given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_parts
from .shared_files import new_folder, removed, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges(a, b) (bigint). Loops and repeats don't
    matter. Neighbours are never gathered: each step takes minima, which meet before the shuffle, and joins them back,
    which Spark can split where a node has very many neighbours. A round's edges are written to the shared folder and
    those of the round before are deleted; edges that fit into one partition are worked on there, without shuffles."""
    spark = edges.sparkSession
    folder = new_folder(spark, "components")
    given = stored(edges.select("a", "b"), folder, "edges")
    e = given.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stored(few_parts(e, given.count()).distinct(), folder, "0")
    loops = given.filter("a = b").select(F.col("a").alias("node")).distinct()
    state, turn = _state(e), 0
    while state[0]:
        here = few_parts(e, state[0])
        both = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = few_parts(both, state[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(few_parts(new, state[0]).distinct(), folder, str(turn + 1))
        removed(spark, f"{folder}/{turn}")
        turn += 1
        before, state = state, _state(e)
        if state == before:
            break
    here = few_parts(e, state[0])
    roots = here.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    found = here.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(alone)
