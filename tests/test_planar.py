"""Nearest points by the tile, correlations of changes by the cell, and what is shuffled for them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import planar
from tessella.operators import spatial as P


@pytest.mark.parametrize("most", [5, 4096])
def test_nearest_by_small_parts_with_ties_and_text_ids(spark, monkeypatch, most):
    for name in ("HELD", "POINTS", "PAIRS", "TILE"):
        monkeypatch.setattr(planar, name, most)
    r = np.random.default_rng(0)
    xy = np.round(r.gamma(1, 6, (300, 2)))  # many piles and equal distances
    df = spark.createDataFrame([(f"c{i:03}", *map(float, p)) for i, p in enumerate(xy)], "cell_id string, x double, y double")
    got = {}
    for e in P.nearest(df, df, 4).collect():
        got.setdefault(e.i, {})[e["rank"]] = (e.d2, e.j)
    for i, p in enumerate(xy):
        best = sorted((float(((p - q) ** 2).sum()), f"c{j:03}") for j, q in enumerate(xy) if j != i)[:4]
        assert [got[f"c{i:03}"][k] for k in (1, 2, 3, 4)] == best


def test_no_row_is_made_of_a_place_and_a_candidate(spark):
    """Many places that ask for few points shared a square, and a task sorted a row for each of them and each candidate."""
    df = spark.range(20_000).select(F.col("id").alias("cell_id"), (F.col("id") * 7919 % 10007 / 10).alias("x"), (F.col("id") * 104729 % 9973 / 10).alias("y"))
    grid = spark.createDataFrame([(k, k // 7 * 160.0, k % 7 * 160.0) for k in range(49)], "cell_id long, x double, y double")
    near = P.nearest(df, grid, 1, True)
    assert near.count() == 20_000 and "Window" not in near._jdf.queryExecution().toString()
    one = near.where("i = 777").first()
    x, y = 777 * 7919 % 10007 / 10, 777 * 104729 % 9973 / 10
    assert one.j == min(range(49), key=lambda k: (math.dist((x, y), (k // 7 * 160.0, k % 7 * 160.0)), k))


def test_correlation_of_a_change_over_small_batches(spark):
    r = np.random.default_rng(1)
    n, genes = 40, [f"g{k}" for k in range(9)]
    x, d = (np.where(r.random((n, 9)) < 0.6, np.round(r.gamma(2, 3, (n, 9))), 0) for _ in range(2))
    x[3] = 0  # without expression, the next without a change
    d[4] = 0
    table = lambda m: spark.createDataFrame([(i, g, float(m[i, k])) for i in range(n) for k, g in enumerate(genes) if m[i, k]], "cell_id long, gene string, value double")
    pairs = [(i, int(j), i * 0.5) for i in range(n) for j in r.choice(n, 4, False)] + [(99, 1, 0.0), (1, 99, 0.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(e.i, e.j): (e.w, e.r) for e in P.change_correlation(spark.createDataFrame(pairs, "i long, j long, w double"), table(x), table(d), 9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    zero = np.zeros(9)
    assert len(got) == len(set((i, j) for i, j, _ in pairs))
    for i, j, w in pairs:
        a, b, c = (m[k] if k < n else zero for m, k in ((d, i), (x, j), (x, i)))
        want = np.corrcoef(a, b - c)[0, 1] if a.std() > 0 and (b - c).std() > 0 else None
        assert got[i, j][0] == w and (got[i, j][1] is None if want is None else abs(got[i, j][1] - want) < 1e-9)
