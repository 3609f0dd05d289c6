"""Steps that are made where a cell's rows have met: no row is made of a cell and a step's products, and none is shuffled for them."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import design as G
from tessella.operators import models as M
from tessella.operators import permutation as R
from tessella.operators import propagation


def shuffles(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") + df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")


def test_propagation_by_the_cell(spark, monkeypatch):
    monkeypatch.setattr(propagation, "BLOCK", 10)
    r = np.random.default_rng(2)
    genes = [f"g{k}" for k in range(5)]
    x, w = np.round(r.gamma(2, 3, (30, 5))), np.where(r.random((5, 5)) < 0.5, r.normal(size=(5, 5)), 0)
    base = spark.createDataFrame([(i, g, float(x[i, k])) for i in range(30) for k, g in enumerate(genes) if x[i, k]], "cell_id long, gene string, value double")
    coef = spark.createDataFrame([(a, b, float(w[i, j])) for i, a in enumerate(genes) for j, b in enumerate(genes) if w[i, j]], "source string, target string, coef double")
    now, seen = np.zeros((30, 5)), np.zeros((30, 5), bool)
    now[:, 0], seen[:, 0] = -x[:, 0], x[:, 0] != 0
    held = seen.copy()
    for _ in range(3):
        seen = (seen.astype(int) @ (w != 0) > 0) | held
        now = np.where(seen, np.maximum(np.where(held, -x, now @ w), -x), 0)
    df = M.propagate(base.where("gene = 'g0'").select("cell_id", "gene", (-F.col("value")).alias("d")), coef, base, 3)
    got = {(e.cell_id, e.gene): e.d for e in df.collect()}
    assert set(got) == {(i, genes[k]) for i, k in zip(*np.nonzero(seen))}
    assert all(abs(got[i, g] - now[i, genes.index(g)]) < 1e-9 for i, g in got)
    assert shuffles(df) <= 2  # rows of a cell meet once, whatever the steps


def test_places_of_arrays_are_those_of_columns(spark):
    plan = R.replicates(2, 7)
    for n in (1, 2, 7, 25, 30):
        at = spark.range(n).select(F.col("id"), (F.col("id") * 97 + 5).alias("turn"))
        for keys in plan:
            rows = at.select("id", "turn", R.moved_place(F.col("id"), F.lit(n).cast("long"), F.array(*map(F.lit, keys)), F.col("turn")).alias("p")).collect()
            assert [e.p for e in rows] == R.moved_places(np.array([e.id for e in rows]), n, keys, np.array([e.turn for e in rows])).tolist()
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (None, "a", 3.0)], "cell_id long, gene string, value double")
    df = R.permuted_genes(x, x, plan)
    assert df.count() == 4 and shuffles(df) == 0


def test_factor_values_meet_a_cell_once(spark):
    m = spark.createDataFrame([("T", "L$R"), ("T", "L#U"), ("T", "U"), ("T", "X$R")], "target string, factor string")
    x = spark.createDataFrame([(1, "R", 2.0), (1, "U", 3.0), (2, "U", 5.0), (3, "R", None)], "cell_id long, gene string, value double")
    got = spark.createDataFrame([(1, "L", 0.5), (2, "L", 0.0), (3, "L", 1.0), (3, "X", 1.0)], "cell_id long, gene string, value double")
    df = G.factor_values(m, x, got)
    assert sorted(map(tuple, df.collect())) == [(1, "L#U", 1.5), (1, "L$R", 1.0), (1, "U", 3.0), (2, "U", 5.0)]
    assert shuffles(df) <= 5  # cells meet in one aggregate; the others are tables of names


def test_a_perturbation_reads_its_tables_once(spark):
    """Each hop made expression and coefficients again, several times."""
    from tessella.operators import factors as X

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([(c, g, v) for c in (0, 1) for g, v in (("L", 2.0), ("R", 1.0), ("T", 3.0))], "cell_id long, gene string, value double")
    betas = spark.createDataFrame([("T", c, "L$R", 0.7) for c in (0, 1)], "target string, cell_id long, modulator string, beta double")
    levels = spark.createDataFrame([(c, "L", 0.0) for c in (0, 1)], "cell_id long, gene string, level double")
    out = X.perturb(expr.mapInArrow(seen, expr.schema), cells, betas.mapInArrow(seen, betas.schema), levels, 30.0, hops=2)
    assert out.count() == 6 and read.value == 8
