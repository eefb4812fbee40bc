"""Whitening against a full eigendecomposition and whole numbers in plain Python."""

import numpy as np
import pytest

from runlore.llm import queries
from runlore.llm.whitening import whitened

SCHEMA = "vec_id bigint, embedding array<float>, label string, n string"


def check(rows, got, most=32):
    """got: Rows of whitened(); rows: (id, vector) that take part."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > e[0] * 1e-18).sum()), np.linalg.matrix_rank(c))
    w = c @ q[:, :k] / np.sqrt(e[:k])
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-8
    assert sorted(by) == list(range(1, k + 1)) and all(len(v) == n for v in by.values())
    key = lambda i: -10**9 if i is None else i
    for i, found in by.items():
        own = sorted(range(n), key=lambda j: (key(rows[j][0]), deviation[j], x[j]))
        found = sorted(found, key=lambda r: (key(r.id), r.deviation))
        assert [(r.id, r.deviation) for r in found] == [(rows[j][0], deviation[j]) for j in own]
        gap = min(abs(e[i - 1] - other) for j, other in enumerate(e) if j != i - 1) if len(e) > 1 else 1
        if gap > 1e-6 * e[0]:
            a, b = np.array([r.whitened for r in found]), w[own, i - 1]
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def made(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA).repartition(parts)


def test_more_dimensions_than_are_kept(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(40, 40)) * np.exp(-np.arange(40) / 6)
    rows = [(i, (rng.normal(size=40) @ mix.T).astype(np.float32).tolist()) for i in range(300)]
    check(rows, whitened(made(spark, rows)).collect())
    check(rows, whitened(made(spark, rows), most=3).collect(), 3)


def test_rows_of_all_kinds(spark):
    """Nulls, entries that aren't finite, empty and shorter vectors, repeated rows and ids, a direction without deviation."""
    rng = np.random.default_rng(2)
    good = [(i, [*rng.normal(size=5).astype(np.float32).tolist(), 0.5]) for i in range(40)]
    good += [good[3], good[3], (7, good[9][1]), (None, good[11][1])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (53, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (54, [float("-inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (55, [1.0, 2.0])]
    got = whitened(made(spark, good + bad)).collect()
    assert max(r.component for r in got) == 5
    check(good, got)


def test_eigenvalues_that_repeat(spark):
    """A cross of unit steps: all directions alike, so each step but the first begins in a new direction."""
    rows = [(2 * i + s, [float(s * 2 - 1) if j == i else 0.0 for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = whitened(made(spark, rows)).collect()
    assert sorted({r.component for r in got}) == [1, 2, 3, 4, 5, 6] and all(r.identity_error < 1e-10 for r in got)


def test_few_rows(spark):
    rows = [(1, [0.5, 0.25, 0.1])]
    assert whitened(made(spark, rows)).count() == 0
    assert whitened(made(spark, rows * 4)).count() == 0  # no deviation at all
    assert whitened(made(spark, [])).count() == 0 and whitened(made(spark, [])).columns == whitened(made(spark, rows)).columns
    check([(1, [0.5, 0.25]), (2, [0.75, 0.1])], whitened(made(spark, [(1, [0.5, 0.25]), (2, [0.75, 0.1])])).collect())


def test_deviation_beyond_a_bigint(spark):
    rows = [(i, [float(2**30 * (i - 2)), float(i)]) for i in range(5)]
    found = {r.id: r.deviation for r in whitened(made(spark, rows)).collect()}
    assert found[0] is None and found[2] == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op11_whitening(spark, sf)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, found.withColumnRenamed("vec_id", "id").collect())
