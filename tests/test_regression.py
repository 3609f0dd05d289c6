"""Fits from sums of products against numpy on the dense tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import tails
from tessella.operators import bayes as B
from tessella.operators import models as M

rng = np.random.default_rng(8)
N, K = 80, 5
X = rng.normal(size=(N, K)) * [1, 2, 3, 1, 0.5]
X[rng.random((N, K)) < 0.3] = 0
Y = X @ [1.5, -1, 0, 0.4, 2] + 3 + rng.normal(size=N)
TYPE = np.array(["a", "b", "c"])[np.arange(N) % 3]
NAMES = [f"f{k}" for k in range(K)]


@pytest.fixture(scope="module")
def tables(spark):
    cells = spark.createDataFrame([(i, str(TYPE[i])) for i in range(N)], "cell_id long, cell_type string")
    rows = [(i, NAMES[k], float(X[i, k])) for i in range(N) for k in range(K) if X[i, k]] + [(i, "t", float(Y[i])) for i in range(N)]
    design = spark.createDataFrame([("t", f, k) for k, f in enumerate(NAMES)], "target string, factor string, pos long")
    return cells, spark.createDataFrame(rows, "cell_id long, factor string, x double").repartition(3), design


def betas(df):
    return {r.factor: r for r in df.collect()}


def test_least_squares_over_all_cells(tables):
    cells, values, design = tables
    got = betas(M.fit_betas(M.products(cells, values), design))
    want, *_ = np.linalg.lstsq(np.c_[X, np.ones(N)], Y, rcond=None)
    left = Y - np.c_[X, np.ones(N)] @ want
    for k, f in enumerate(NAMES):
        r = np.corrcoef(X[:, k], Y)[0, 1]
        assert np.allclose([got[f].beta, got[f].r, got[f].r2], [want[k], r, r * r]) and got[f].n_cells == N
        assert np.isclose(got[f].model_r2, 1 - (left**2).sum() / ((Y - Y.mean()) ** 2).sum())


def lasso(x, y, alpha, ratio):
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(5000):
        for k in range(len(b)):
            rho = xc[:, k] @ (yc - xc @ b + xc[:, k] * b[k]) / len(y)
            b[k] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / ((xc[:, k] ** 2).mean() + alpha * (1 - ratio))
    return b


@pytest.mark.parametrize("method, ratio", [("l1", 1.0), ("elastic", 0.5)])
def test_penalised_fits_and_scaling(tables, method, ratio):
    cells, values, design = tables
    sums = M.products(cells, values)
    got = betas(M.fit_betas(sums, design, method=method, penalty=0.3, l1_ratio=0.5))
    assert np.allclose([got[f].beta for f in NAMES], lasso(X, Y, 0.3, ratio), atol=1e-6)
    got = betas(M.fit_betas(sums, design, method=method, penalty=0.3, l1_ratio=0.5, standardize=True))
    assert np.allclose([got[f].beta for f in NAMES], lasso(X / X.std(0), Y, 0.3, ratio), atol=1e-6)
    ridge = betas(M.fit_betas(sums, design, method="ridge", penalty=7.0))
    xc = X - X.mean(0)
    assert np.allclose([ridge[f].beta for f in NAMES], np.linalg.solve(xc.T @ xc + 7 * np.eye(K), xc.T @ (Y - Y.mean())))
    with pytest.raises(Exception):
        M.fit_betas(sums, design, method="other").collect()


def test_labels_are_projected_out(tables):
    cells, values, design = tables
    hot = M.one_hot(cells, "cell_type")
    labels = ["cell_type[a]", "cell_type[b]", "cell_type[c]"]
    got = betas(M.fit_betas(M.products(cells, values.union(hot)), design, labels=labels))
    dummies = np.c_[TYPE == "b", TYPE == "c"].astype(float)
    want, *_ = np.linalg.lstsq(np.c_[X, dummies, np.ones(N)], Y, rcond=None)
    assert np.allclose([got[f].beta for f in NAMES] + [got[x].beta for x in labels], [*want[:K], 0, *want[K : K + 2]])
    assert got[labels[0]].grp == "onehot"


def test_resampled_cells_are_numpys(tables):
    cells, values, design = tables
    rows = M.bootstrap_betas(cells, values, design, 3, seed0=5).collect()
    for rep in range(3):
        at = np.random.default_rng(5 + rep).integers(0, N, size=N)
        want, *_ = np.linalg.lstsq(np.c_[X[at], np.ones(N)], Y[at], rcond=None)
        assert np.allclose([r.beta for f in NAMES for r in rows if r.rep == rep and r.factor == f], want[:K])


def test_groups_sweeps_and_too_few_cells(tables):
    cells, values, design = tables
    sums = M.products(cells, values)
    got = betas(M.fit_betas(sums, design.withColumn("cluster", F.when(F.col("pos") < 2, 1))))
    z = np.c_[X[:, 2:], X[:, 0] + X[:, 1]]
    want, *_ = np.linalg.lstsq(np.c_[z, np.ones(N)], Y, rcond=None)
    assert np.allclose([got[f].beta for f in ("f2", "f3", "f4", "f0+f1")], want[:4]) and got["f0+f1"].grp == "cluster"
    sweep = M.sweep_betas(sums, design, [0.1, 100.0], method="l1").collect()
    assert len(sweep) == 2 * K and all(r.beta == 0 for r in sweep if r.penalty == 100)
    few = cells.where("cell_id < 5")
    assert M.fit_betas(M.products(few, values.join(few.select("cell_id"), "cell_id")), design).count() == 0


def test_average_linkage():
    points = np.array([0.0, 0.1, 0.2, 5, 5.1, 9])
    assert M.linkage_groups(abs(points[:, None] - points), 1.0) == [1, 1, 1, 2, 2, 3]
    assert M.linkage_groups(np.array([[0, 1, 4], [1, 0, 2], [4, 2, 0.0]]), 2.9) == [1, 1, 2]  # (4 + 2) / 2 = 3


def test_links_find_the_regulators(spark):
    n = 300
    x = rng.normal(size=(n, 4)) + 3
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n)
    rows = [(i, g, float(v)) for i in range(n) for g, v in zip("ABCDT", [*x[i], y[i]])]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(i, "k") for i in range(n)], "cell_id long, cluster string")
    cand = spark.createDataFrame([("T", s) for s in "ABCDT"], "target string, source string")
    for method in ("bagging_ridge", "bayesian_ridge"):
        got = {r.source: r for r in M.infer_links(cells, expr, cand, ["cluster"], method, share=1.0).collect()}
        assert set(got) == set("ABCD") and abs(got["A"].coef_mean - 2) < 0.1 and abs(got["B"].coef_mean + 1) < 0.1
        assert got["A"].p < 1e-6 and abs(got["C"].coef_mean) < 0.1
    bayes = {r.source: r for r in M.infer_links(cells, expr, cand, ["cluster"], "bayesian_ridge").collect()}
    assert bayes["C"].p > got["A"].p and 0 <= bayes["C"].p <= 1


def test_group_lasso_keeps_or_drops_whole_groups():
    x = rng.normal(size=(200, 4))
    y = x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=200)
    xc, yc = x - x.mean(0), y - y.mean()
    b = M.group_lasso(xc.T @ xc, xc.T @ yc, 200, [[0, 1], [2, 3]], 0.2)
    assert (b[:2] > 0.5).all() and (b[2:] == 0).all()


def test_student_tail_against_integration():
    for df in (1, 3, 10, 198):
        t = np.linspace(-2000, 2000, 4_000_001) if df == 1 else np.linspace(-60, 60, 2_000_001)
        from math import lgamma

        d = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / np.sqrt(df * np.pi) * (1 + t * t / df) ** (-(df + 1) / 2)
        for x in (0.0, 0.5, 2.0, 5.0):
            inside = np.trapezoid(d[abs(t) <= x + 1e-9], t[abs(t) <= x + 1e-9]) if x else 0.0
            assert abs(tails.student_two_sided(np.array([x]), np.array([df]))[0] - (1 - inside)) < 1e-4
    assert np.isnan(tails.student_two_sided(np.array([1.0]), np.array([0]))).all()


def test_variational_intervals_cover_the_coefficients(spark):
    """Coefficients drawn from the prior: 95 in 100 intervals hold them, and the normal agrees with dense algebra and the best sigma."""
    r = np.random.default_rng(12)
    n, k, targets = 150, 4, 60
    x = r.normal(size=(n, k))
    w = 0.1 * r.normal(size=(targets, k + 1))
    y = w[:, :1] + w[:, 1:] @ x.T + 0.4 * r.normal(size=(targets, n))
    cells = spark.createDataFrame([(i, "a") for i in range(n)], "cell_id long, cell_type string")
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(k)] + [(i, f"t{t:02d}", float(y[t, i])) for t in range(targets) for i in range(n)]
    values = spark.createDataFrame(rows, "cell_id long, factor string, x double")
    design = spark.createDataFrame([(f"t{t:02d}", f"f{j}", j) for t in range(targets) for j in range(k)] + [("t00", "zero", 9)], "target string, factor string, pos long")
    got = {}
    for v in B.variational_betas(M.products(cells, values, by=["cell_type"]), design, ["cell_type"]).collect():
        got[v.target, v.factor] = v
    assert len(got) == targets * (k + 1) + 1 and np.isclose(got["t00", "zero"].sd, 0.1) and got["t00", "zero"].beta == 0
    name = ["(intercept)", *[f"f{j}" for j in range(k)]]
    inside = [got[f"t{t:02d}", f].lo <= w[t, j] <= got[f"t{t:02d}", f].hi for t in range(targets) for j, f in enumerate(name)]
    assert 0.91 <= np.mean(inside) <= 0.985
    assert abs(np.mean([got[f"t{t:02d}", "f0"].sigma for t in range(targets)]) - 0.4) < 0.02
    one = np.c_[np.ones(n), x]
    for t in range(1, 6):
        beta = np.array([got[f"t{t:02d}", f].beta for f in name])
        sd = np.array([got[f"t{t:02d}", f].sd for f in name])
        precision = None
        for p in np.linspace(4, 9, 5001):  # of the sigma that fits these coefficients best
            u = -np.log(p) / 2
            cov = np.linalg.inv(p * one.T @ one + np.eye(k + 1) * 100)
            left = ((y[t] - one @ beta) ** 2).sum() + np.trace(cov @ one.T @ one)
            gap = abs((n + u) / left - p)
            if precision is None or gap < precision[0]:
                precision = (gap, p)
        cov = np.linalg.inv(precision[1] * one.T @ one + np.eye(k + 1) * 100)
        assert np.allclose(beta, precision[1] * cov @ one.T @ y[t], atol=2e-4) and np.allclose(sd, np.sqrt(np.diag(cov)), atol=2e-4)
