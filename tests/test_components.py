"""Components, neighbours in many dimensions, smoothing and pseudotime against dense numpy."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import components as P
from tessella.operators import diffusion as D
from tessella.operators import metric as M
from tessella.operators import smoothing as SM

rng = np.random.default_rng(3)


def long_table(spark, x, parts=5):
    rows = [(i, f"g{j:03d}", float(x[i, j])) for i, j in np.argwhere(x != 0).tolist()]
    return spark.createDataFrame(rows, "cell_id long, gene string, value double").repartition(parts)


def matrix(n=200, p=90):
    x = rng.poisson(1.5, (n, p)).astype(float) + np.outer(rng.gamma(2, 1, n), rng.gamma(1, 1, p))
    x[rng.random((n, p)) < 0.5] = 0
    x[7] = 0
    return x


@pytest.mark.parametrize("most", [8, 90])
def test_components_equal_those_of_numpy_up_to_sign(spark, most):
    x = matrix()
    pcs, loadings, share = P.components(long_table(spark, x), spark.range(len(x)).withColumnRenamed("id", "cell_id"), most)
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    k = min(most, 90)
    assert np.allclose(share, (s**2 / (s**2).sum())[:k], atol=1e-9)
    got = np.array([r.pcs for r in pcs.orderBy("cell_id").collect()])
    load = np.array([r.loadings for r in loadings.orderBy("gene").collect()])
    sign = np.sign((load * vt[:k].T).sum(0))
    assert np.allclose(load * sign, vt[:k].T, atol=1e-5) and np.allclose(got * sign, (u * s)[:, :k], atol=1e-4)
    assert (load[np.abs(load).argmax(0), np.arange(k)] > 0).all()


def test_components_of_few_and_none(spark):
    cells = spark.range(3).withColumnRenamed("id", "cell_id")
    none = spark.createDataFrame([], "cell_id long, gene string, value double")
    pcs, loadings, share = P.components(none, cells)
    assert pcs.count() == 3 and loadings.count() == 0 and len(share) == 0
    same = spark.createDataFrame([(i, "g", 2.0) for i in range(3)], "cell_id long, gene string, value double")
    pcs, _, share = P.components(same, cells)
    assert pcs.count() == 3 and share.sum() == 0


def test_products_hold_little_whatever_a_batch_has(spark):
    n, p = 20_000, 25
    at = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p, pa.int32()), pa.array(np.tile(np.arange(p, dtype=np.int32), n)))
    x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p, pa.int32()), pa.array(rng.normal(size=n * p)))
    batch = pa.RecordBatch.from_arrays([at, x], ["at", "x"])
    m = np.linalg.qr(rng.normal(size=(p, p)))[0]
    shared = type("Shared", (), {"value": (m, np.zeros(p))})
    whole = batch.column("x").values.to_numpy().reshape(n, p)
    tracemalloc.start()
    (r,), (s,) = P._triangles(shared)([batch]), P._transposed(shared)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    r = np.frombuffer(r.column("r")[0].as_py()).reshape(p, p)
    assert np.allclose(r.T @ r, (whole @ m).T @ (whole @ m))
    assert np.allclose(np.frombuffer(s.column("s")[0].as_py()).reshape(p, p), whole.T @ (whole @ m))


def test_elbow_is_the_first_turn():
    assert P.elbow(np.array([0.6, 0.3, 0.09, 0.001, 0.0005])) == 1
    assert P.elbow(np.array([0.5, 0.3, 0.2])) == 3
    assert P.elbow(np.zeros(0)) == 0


def nearest_of(ids, x, k, with_self):
    out = {}
    for a, i in enumerate(ids):
        d = ((x - x[a]) ** 2).sum(1)
        order = sorted((d[b], j) for b, j in enumerate(ids) if with_self or j != i)
        out[i] = [(j, round(float(y), 9)) for y, j in order[:k]]
    return out


@pytest.mark.parametrize("chunk,block,with_self", [(4096, 8192, False), (16, 8, True)])
def test_neighbours_equal_brute_force(spark, monkeypatch, chunk, block, with_self):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "BLOCK", block)
    x = np.round(10 * rng.normal(size=(500, 6)) + rng.integers(0, 4, (500, 1)) * 50)  # whole numbers: equal distances are exact
    x[100:260] = x[100]  # a third on one place
    x[300:340] = np.round(x[300:340], -1)
    ids = rng.permutation(2_000)[:500].tolist()
    bad = [(3000, None), (3001, [float("nan")] * 6), (3002, [1.0]), (3003, [None] * 6), (3004, []), (3005, [float("inf")] * 6)]
    df = spark.createDataFrame([*zip(ids, x.tolist()), *bad], "cell_id long, v array<double>").repartition(5)
    got = {}
    for r in M.neighbours(df, 7, with_self).orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append((r.j, round(r.d2, 9)))
    assert got == nearest_of(ids, x, 7, with_self)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [9.0, 9.0])], "cell_id long, v array<double>")
    assert {(r.i, r.j, r["rank"]) for r in M.neighbours(df, 5).collect()} == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 1, 2)}
    assert M.neighbours(df.limit(0), 5).count() == 0


def test_places_go_to_few_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 64)
    sent, cut = [], M.cut

    def counted(df):
        df = cut(df)
        if "bound" in df.columns:
            sent.append(df.count())
        return df

    monkeypatch.setattr(M, "cut", counted)
    x = np.round(rng.random((2_000, 3)) * [900, 500, 100])
    df = spark.createDataFrame([*enumerate(x.tolist())], "cell_id long, v array<double>").repartition(5)
    got = {}
    for r in M.neighbours(df, 5, True).orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append((r.j, round(r.d2, 9)))
    assert got == nearest_of(list(range(len(x))), x, 5, True)
    assert sum(sent) < 7 * len(x)  # of 32 cells


def test_cells_are_reached_by_their_boxes():
    v = np.r_[rng.normal(size=(300, 4)), np.full((100, 4), 3.0), np.c_[np.zeros((100, 3)), np.arange(100)]]
    for depth in (0, 1, 5):
        tree = M.Tree(v[::3], depth)
        cell = tree.cell(v)
        low, high = np.full((1 << depth, 4), np.inf), np.full((1 << depth, 4), -np.inf)
        np.minimum.at(low, cell, v)
        np.maximum.at(high, cell, v)
        tree.enclose(low, high)
        bound = rng.random(len(v))
        gap = np.maximum(np.maximum(low - v[:, None], v[:, None] - high), 0)
        want = np.argwhere(((gap**2).sum(2) <= bound[:, None]) & np.isin(np.arange(1 << depth), cell))
        assert set(zip(*(x.tolist() for x in tree.within(v, bound)))) == set(map(tuple, want.tolist()))


def test_sums_are_of_all_rows_of_a_cell_wherever_batches_end():
    p, near = 5, np.repeat(np.arange(7), [3, 1, 4, 1, 5, 2, 6])
    x = rng.integers(0, 3, (len(near), p)) * (rng.random((len(near), p)) < 0.7)
    have = x > 0
    want = {int(i): {g: float(x[near == i, g].sum()) for g in np.flatnonzero(have[near == i].any(0))} for i in range(7)}
    rows = pa.table({"i": near, "at": pa.array([np.flatnonzero(h).astype(np.int32) for h in have]), "x": pa.array([x[k][h].astype(float) for k, h in enumerate(have)])})
    for size in (1, 2, 5, 30):
        got = {}
        for b in SM._sums(p)(iter(rows.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                assert r["cell_id"] not in got
                got[r["cell_id"]] = dict(zip(r["at"], r["x"]))
        assert got == want


def uniform_of(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def components_of(x, d):
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    return (u * s)[:, :d] * np.sign(vt[np.arange(d), np.abs(vt[:d]).argmax(1)])


def test_smoothing_by_doubling_equals_a_dense_version(spark):
    n, p, k, d = 150, 30, 11, 4
    x = rng.poisson(np.outer(rng.gamma(3, 1, n), rng.gamma(2, 2, p)) * (1 + 3 * (np.arange(n) % 3 == 0))[:, None] ** (np.arange(p) % 4 == 1)).astype(float)
    x[5] = 0
    s, have, step = x, 1, 0
    while have < k:
        have, step = min(2 * have, k), step + 1
        total = s.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where(total[:, None] > 0, s * np.median(total[total > 0]) / total[:, None], 0)
        pcs = components_of(np.sqrt(y) + np.sqrt(y + 1), d)
        span = np.ptp(pcs, axis=0)
        pcs = pcs + np.array([[(uniform_of(7, step, c, i) - 0.5) * span[c] * 0.03 for c in range(d)] for i in range(n)])
        order = np.argsort(((pcs[:, None] - pcs[None]) ** 2).sum(2), axis=1, kind="stable")[:, :have]
        s = x[order].sum(1)
    out = SM.smooth_by_doubling(long_table(spark, x), spark.range(n).withColumnRenamed("id", "cell_id"), k, d, seed=7)
    got = np.zeros((n, p))
    for r in out.collect():
        got[r.cell_id, int(r.gene[1:])] = r.value
    assert np.allclose(got, s)


def test_median_is_exact(spark):
    for v, want in (([3.0, 1.0, 2.0], 2.0), ([4.0, 1.0, 2.0, 2.0], 2.0), ([5.0, 1.0], 3.0), ([], None), ([2.0] * 7, 2.0)):
        df = spark.createDataFrame([*enumerate(v), (99, None)], "cell_id long, total double").repartition(3)
        assert SM.median(df, "total", "cell_id") == want


def branches():
    """300 points of a stem that forks, in three dimensions."""
    t = np.linspace(0, 1, 300)
    side = np.where(np.arange(300) % 2 == 0, 1.0, -1.0) * np.maximum(0, t - 0.4)
    return np.c_[4 * t, 3 * side, 0.1 * rng.normal(size=300)]


def test_pseudotime_and_ends_equal_dense_linear_algebra(spark):
    v = branches()
    df = spark.createDataFrame(list(enumerate(v.tolist())), "cell_id long, v array<double>").repartition(4)
    k, adaptive, comps = 12, 4, 4
    near = M.neighbours(df, k)
    edges = D.kernel(near, adaptive)
    value, psi = D.diffusion_map(edges, comps)
    time = D.pseudotime(value, psi, 0).cache()

    dist = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    at = np.argsort(dist, axis=1)[:, :k]
    w = np.zeros((300, 300))
    for i in range(300):
        w[i, at[i]] = np.exp(-dist[i, at[i]] / dist[i, at[i][adaptive - 1]])
    w = w + w.T
    deg = w.sum(1)
    lam, u = np.linalg.eigh(w / np.sqrt(np.outer(deg, deg)))
    lam, u = lam[::-1][: comps + 1], u[:, ::-1][:, : comps + 1] / np.sqrt(deg)[:, None]
    u = u / np.linalg.norm(u, axis=0)
    assert np.allclose(value, lam, atol=1e-9)
    far = np.sqrt((((u[0] - u)[:, 1:] * lam[1:] / (1 - lam[1:])) ** 2).sum(1))
    want = far / far.max()
    got = np.array([r.pseudotime for r in time.orderBy("cell_id").collect()])
    assert np.allclose(got, want, atol=1e-5)

    ends = spark.createDataFrame([(299, "down"), (298, "up")], "cell_id long, state string")
    p = {(r.cell_id, r.state): r.p for r in D.end_probabilities(edges, time, ends, 0.002).collect()}
    q = np.where(got[None, :] >= got[:, None] - 0.002, w, 0)
    q[[298, 299]] = 0
    q = q / np.maximum(q.sum(1), 1e-300)[:, None]
    free = [i for i in range(298)]
    b = np.linalg.solve(np.eye(298) - q[np.ix_(free, free)], q[np.ix_(free, [298, 299])])
    total = b.sum(1)
    for i in free:
        if total[i] > 1e-6:
            assert abs(p[i, "up"] - b[i, 0] / total[i]) < 1e-5 and abs(p[i, "up"] + p[i, "down"] - 1) < 1e-9
    assert p[298, "up"] == 1 and p[299, "down"] == 1 and p[290, "up"] > 0.9 and p[291, "down"] > 0.9


def test_cells_apart_from_the_root_have_no_time(spark):
    v = np.r_[rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 1000]
    df = spark.createDataFrame(list(enumerate(v.tolist())), "cell_id long, v array<double>")
    value, psi = D.diffusion_map(D.kernel(M.neighbours(df, 8), 3), 3)
    got = {r.cell_id: r.pseudotime for r in D.pseudotime(value, psi, 3).collect()}
    assert all((got[i] is None) == (i >= 20) for i in range(40)) and got[3] == 0
    assert all(x is None for x in (r.pseudotime for r in D.pseudotime(value, psi, 77).collect()))
    value, psi = D.diffusion_map(D.kernel(M.neighbours(df.limit(0), 8), 3), 3)
    assert psi.count() == 0 and len(value) == 0
