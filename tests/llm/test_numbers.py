"""Exact search and mixing: against brute force and their bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlore.llm import mixing, vector_search

NAN = float("nan")


def vectors(n=900, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dim))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(0, 0.2, dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(120)]  # one very common vector
    rows += [(2000, None), (2050, [NAN] * dim), (2100, [None] * dim), (2150, [float("inf")] + [0.0] * (dim - 1)), (None, rows[0][1]), (2200, []), rows[50]]
    return rows


@pytest.mark.parametrize(("pivots", "rings", "block"), [(None, None, None), (7, 5, 50), (1, 1, 2000)])
def test_top_k(spark, pivots, rings, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    expected = []
    for a, (i, v) in enumerate(used):
        if i % 50 == 0:
            best = sorted((-score(v, w), j) for b, (j, w) in enumerate(used) if b != a)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = vector_search.top_k(df, F.col("id") % 50 == 0, 5, pivots=pivots, rings=rings, block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0])], "vec_id bigint, embedding array<float>")
    got = vector_search.top_k(df, F.col("id") % 50 == 0).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {(0, 1, 50, 65536), (50, 1, 0, 65536)}
    assert vector_search.top_k(df.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize(("pivots", "block"), [(None, None), (3, 8)])
def test_rows_of_equal_id_are_candidates_of_each_other(spark, pivots, block):
    rng = np.random.default_rng(4)
    rows = [(int(i), [int(x) for x in v]) for i, v in zip(rng.choice([50, 100, 3, 7], 40), rng.integers(-3, 4, (40, 4)), strict=True)]
    rows += rows[:6]  # whole rows that repeat
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>").repartition(3)
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-256 * 256 * sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(rows) if b != a)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = vector_search.top_k(df, F.col("id") % 50 == 0, 5, pivots=pivots, block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_targets(spark):
    sizes = {"a": 100, "b": 900, "c": 10, "d": 500, "é": 300, None: 40}
    df = spark.createDataFrame([*sizes.items()], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, fixed = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        fixed |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(fixed | share)


def test_mix(spark, docs, corpus, no_docs):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.pareto(1.2) * 20 + 1), f"s{i % 5 if i % 3 else 0}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    made = mixing.mix_decisions(df)
    by_source = made.groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("size").alias("largest"), F.max("copies").alias("most")
    ).collect()
    for r in by_source:
        assert abs(r.taken - r.target) <= r.largest / 2 + 1 and r.most <= 2
    again = mixing.mix_decisions(df.repartition(7))
    assert {(r.id, r.copies) for r in made.collect()} == {(r.id, r.copies) for r in again.collect()}
    mixed = mixing.mix_sources(docs)
    rows_of = {(r.id, r.source, r.text_hash): r for r in mixing.mix_decisions(docs).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies * r.n_rows for r in rows_of.values())
    assert mixing.each_row(mixing.mix_decisions(docs), piece=1).count() == len(corpus)
    assert mixing.mix_decisions(no_docs).count() == 0 and mixing.mix_sources(no_docs).count() == 0


def test_shares_on_average(spark):
    """Copies average to what they are due, over seeds."""
    df = spark.createDataFrame([(i, "w " * (5 + i % 7), "a" if i % 2 else "b") for i in range(40)], "doc_id bigint, text string, source string")
    copies = [{r.id: r.copies for r in mixing.mix_decisions(df, seed=s).collect()} for s in range(12)]
    due = {r.id: r.target / r.source_size for r in mixing.mix_decisions(df).collect()}
    mean = {i: np.mean([c[i] for c in copies]) for i in due}
    assert np.mean([mean[i] - due[i] for i in due]) == pytest.approx(0, abs=0.05)
