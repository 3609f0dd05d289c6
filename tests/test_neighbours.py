"""Neighbours, permutations, walks and networks against brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.lineage import numbered
from tessella.operators import communication as C
from tessella.operators import neighbourhoods as N
from tessella.operators import networks as K
from tessella.operators import permutation as M
from tessella.operators import spatial as P
from tessella.operators import statistics as Q

rng = np.random.default_rng(4)


def plane(spark, xy, first=0):
    return spark.createDataFrame([(first + i, None if x is None else float(x), None if y is None else float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double")


@pytest.mark.parametrize("k, own", [(1, False), (4, False), (3, True), (200, False)])
def test_nearest_with_piles_outliers_and_missing_places(spark, k, own):
    xy = [*rng.normal(size=(60, 2)) * 0.01, *[(5.0, 5.0)] * 40, *rng.normal(size=(20, 2)) * 50, (1e4, -1e4), (None, 1.0), (3.0, None)]
    df = plane(spark, xy)
    got = {}
    for r in P.nearest(df, df, k, own).collect():
        got.setdefault(r.i, {})[r["rank"]] = r.j
    ok = [i for i, (x, y) in enumerate(xy) if x is not None and y is not None]
    for i in ok:
        d = sorted(((xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2, j) for j in ok if own or j != i)[:k]
        assert [got[i][r] for r in range(1, len(d) + 1)] == [j for _, j in d]
    assert set(got) == set(ok)


def test_nearest_of_other_points_and_of_nothing(spark):
    cells, grid = plane(spark, rng.random((30, 2)) * 100), plane(spark, [(0, 0), (50, 50), (1000, 1000)], 900)
    near = {r.i: r.j for r in P.nearest(cells, grid, 1, True).collect()}
    xy = {r.cell_id: (r.x, r.y) for r in [*cells.collect(), *grid.collect()]}
    assert all(near[i] == min((900, 901, 902), key=lambda j: (math.dist(xy[i], xy[j]), j)) for i in range(30))
    assert P.nearest(cells.limit(0), grid, 2).count() == 0 and P.nearest(cells, grid.limit(0), 2).count() == 0


def test_balanced_neighbours_bound_both_degrees(spark):
    df = plane(spark, [(0, 0)] + [(math.cos(a) * (10 + a), math.sin(a) * (10 + a)) for a in np.linspace(0, 6, 30)])
    e = N.balanced_neighbours(P.nearest(df, df, 12), 3, 4).collect()
    into, out = np.bincount([r.j for r in e], minlength=31), np.bincount([r.i for r in e], minlength=31)
    assert into.max() <= 4 and out.max() <= 3 and out.min() >= 1


def test_balanced_neighbours_are_those_of_cells_that_choose_in_turn(spark):
    for seed in range(3):
        r = np.random.default_rng(seed)
        n, sight, k, most = 60, 14, 4, 5
        xy = np.round(r.gamma(1, 3, (n, 2)))
        df = plane(spark, xy.tolist())
        near = P.nearest(df, df, sight).cache()
        lists = {}
        for e in near.orderBy("i", "d2", "j").collect():
            lists.setdefault(e.i, []).append(e.j)
        named = np.bincount([j for v in lists.values() for j in v], minlength=n)
        into, want = np.zeros(n, int), set()
        for i in sorted(range(n), key=lambda i: (-named[i], -i)):
            free = [j for j in lists[i] if into[j] < most][:k]
            into[free] += 1
            want |= {(i, j) for j in free}
        assert {(e.i, e.j) for e in N.balanced_neighbours(near, k, most).collect()} == want


def test_places_move_by_bijections_that_reach_every_order(spark):
    plan = M.replicates(3_000, seed=1)
    n = 4
    df = spark.createDataFrame([(m, r, keys) for m, keys in enumerate(plan) for r in range(n)], "m int, r long, keys array<bigint>").repartition(4)
    rows = df.select("m", "r", M.moved_place(F.col("r"), F.lit(n).cast("long"), F.col("keys")).alias("t")).collect()
    orders = {}
    for x in rows:
        orders.setdefault(x.m, [0] * n)[x.r] = x.t
    count = Counter(map(tuple, orders.values()))
    assert set(count) == set(itertools.permutations(range(n)))
    expected = len(plan) / 24
    assert sum((c - expected) ** 2 / expected for c in count.values()) < 49.7  # chi-squared, 23 degrees of freedom, one in a thousand
    for n in (1, 2, 3, 5, 17, 101, 1_009):
        got = spark.range(n).select(M.moved_place(F.col("id"), F.lit(n).cast("long"), F.lit(plan[0]).cast("array<bigint>"), F.lit(7)).alias("t")).collect()
        assert sorted(x.t for x in got) == list(range(n))


def test_p_of_permutations_is_uniform_without_an_effect(spark):
    n, groups, reps = 40, 60, 39
    x = np.random.default_rng(2).normal(size=(groups, n))
    cells = spark.range(n).select(F.col("id").alias("cell_id"))
    perm = np.zeros((reps, n), int)
    for r in M.permutations(cells, M.replicates(reps, seed=9)).collect():
        perm[r.m, r.cell_id] = r.src
    first = np.arange(n) < n // 2
    stat = lambda v: v[:, first].mean(1) - v[:, ~first].mean(1)
    more = sum((stat(x[:, perm[m]]) >= stat(x)).astype(int) for m in range(reps))
    p = np.sort((more + 1) / (reps + 1))
    assert np.abs(p - (np.arange(groups) + 0.5) / groups).max() < 0.21  # Kolmogorov and Smirnov, one in a hundred


def graph(spark, n=14):
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.4), 1)
    x = rng.integers(0, 4, (n, 3)).astype(float) - 1  # some below 0
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "i long, j long, w double")
    expr = spark.createDataFrame([(i, g, float(x[i, k])) for i in range(n) for k, g in enumerate("abc") if x[i, k]], "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(n)], "cell_id long, cell_type string")
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "b")], "g1 string, g2 string")
    return w + w.T, w, x, edges, expr, cells, pairs


def moved(r, n, keys):
    """Where a place goes, in plain integers."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        for key in keys:
            first, last = divmod(r, b)
            y = ((first if key % 2 else last) + key // 2) % M.PRIME
            y = (y**3 + key // 2) % M.PRIME
            r = first * b + (last + y) % b if key % 2 else (first + y) % a * b + last
        if r < n:
            return r


def test_scores_z_and_permutations_equal_matrices(spark):
    both, w, x, edges, expr, cells, pairs = graph(spark)
    n, at = len(x), {"a": 0, "b": 1, "c": 2}
    score = lambda u, v, same: u @ both @ v / (2 if same else 1)
    plan = M.replicates(5, seed=3)
    perm = M.permutations(cells, plan)
    src = [[moved(r, n, keys) for r in range(n)] for keys in plan]
    assert {(r.m, r.cell_id): r.src for r in perm.collect()} == {(m, i): s[i] for m, s in enumerate(src) for i in range(n)}
    moments, w2 = {g: ((both @ x[:, k]) ** 2).sum() for g, k in at.items()}, (w**2).sum()
    z = {(r.g1, r.g2): r for r in C.z_scores(C.pair_scores(edges, expr, pairs), C.pair_moments(pairs, C.second_moment(edges, expr), C.squared_weights(edges))).collect()}
    got = {(r.g1, r.g2): r.p for r in M.pair_significance(edges, expr, pairs, perm, 5).collect()}
    per_cell = {(r.cell_id, r.g1, r.g2): r.p for r in M.cell_significance(edges, expr, pairs, perm, 5).collect()}
    for g, h in [("a", "b"), ("c", "a"), ("b", "b")]:
        u, v, same = x[:, at[g]], x[:, at[h]], g == h
        c = score(u, v, same)
        ea, eb = (w2, w2) if same else (moments[g], moments[h])
        za, zb = c / math.sqrt(ea), c / math.sqrt(eb)
        assert np.isclose(z[g, h].z, za if abs(za) < abs(zb) else zb)
        a = [score(u[s] if same else u, v[s], same) for s in src]
        b = [score(u[s], v[s] if same else v, same) for s in src]
        assert np.isclose(got[g, h], max((sum(t > c + 1e-9 for t in side) + 1) / 6 for side in (a, b)))
        own = u * (both @ v) / (2 if same else 1)
        ca = [(u[s] if same else u) * (both @ v[s]) / (2 if same else 1) for s in src]
        cb = [ca[m] if same else (both @ u[s]) * v for m, s in enumerate(src)]
        for i in range(n):
            if (i, g, h) in per_cell:
                assert np.isclose(per_cell[i, g, h], max((sum(t[i] > own[i] + 1e-9 for t in side) + 1) / 6 for side in (ca, cb)))


def test_permutations_inside_types_and_rates(spark):
    *_, cells, _ = graph(spark)
    t = {r.cell_id: r.cell_type for r in cells.collect()}
    for m, rows in itertools.groupby(sorted(M.permutations(cells, M.replicates(3), "cell_type").collect()), key=lambda r: r.m):
        rows = list(rows)
        assert sorted(r.src for r in rows) == sorted(t) and all(t[r.src] == t[r.cell_id] for r in rows)
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.04, 0.04, 0.2, None, 0.01])], "k long, p double")
    a = {r.k: r.fdr for r in C.adjusted_over_cells(p).collect()}
    b = {r.k: r.fdr for r in C.benjamini_hochberg(p, tie=["k"]).collect()}
    assert all(np.isclose(a[k], b[k]) for k in a)


def test_walks_follow_the_probabilities(spark):
    p = spark.createDataFrame([(0, 1, 0.25), (0, 2, 0.75), (1, 1, 1.0), (2, 2, 1.0)], "i long, j long, p double")
    starts = spark.createDataFrame([(0,), (7,)], "cell_id long")
    rows = N.walk(p, starts, 2, copies=2000).collect()
    end = [r.cell for r in rows if r.start == 0 and r.step == 2]
    assert len(end) == 2000 and abs(end.count(1) / 2000 - 0.25) < 0.04 and {r.cell for r in rows if r.start == 7} == {7}
    assert {(r.start, r.copy, r.cell) for r in N.walk(p, starts, 2, copies=3).where("step = 2").collect()} <= {(r.start, r.copy, r.cell) for r in rows if r.step == 2}


def test_centralities_by_brute_force(spark):
    links = [(s, t, float(rng.integers(1, 6))) for s in "abcdef" for t in "abcdef" if s != t and rng.random() < 0.5]
    df = spark.createDataFrame([("k", s, t, w) for s, t, w in links], "cluster string, source string, target string, coef_mean double")
    length = {(s, t): w for s, t, w in links}
    want = dict.fromkeys("abcdef", 0.0)
    for s, t in itertools.permutations("abcdef", 2):
        best, paths = math.inf, []
        for r in range(5):
            for mid in itertools.permutations([v for v in "abcdef" if v not in (s, t)], r):
                way = [s, *mid, t]
                if all(e in length for e in zip(way, way[1:])):
                    d = sum(length[e] for e in zip(way, way[1:]))
                    if d < best - 1e-9:
                        best, paths = d, [mid]
                    elif abs(d - best) < 1e-9:
                        paths.append(mid)
        for mid in paths:
            for v in mid:
                want[v] += 1 / len(paths)
    got = {r.gene: r.betweenness for r in K.betweenness(df).collect()}
    assert all(np.isclose(got[g], want[g]) for g in got)
    a = np.zeros((6, 6))
    for s, t, w in links:
        i, j = ord(s) - 97, ord(t) - 97
        a[i, j] += w
        a[j, i] += w
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    eig = {r.gene: r.eigenvector for r in K.eigenvector_centrality(df).collect()}
    assert all(np.isclose(eig[g], v[ord(g) - 97] / v.max(), atol=1e-4) for g in eig)


def test_signed_rank_and_tables_by_definition(spark):
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    d = (x - y)[x != y]
    rank = np.array([(abs(d) < abs(v)).sum() + ((abs(d) == abs(v)).sum() + 1) / 2 for v in d])
    w, n = rank[d > 0].sum(), len(d)
    ties = sum(c**3 - c for c in np.unique(abs(d), return_counts=True)[1])
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    (r,) = Q.signed_rank(df, True).collect()
    assert (r.n, r.w) == (n, w) and np.isclose(r.z, z) and np.isclose(r.p, math.erfc(z / math.sqrt(2)) / 2, atol=1e-6)
    s = spark.createDataFrame([(i, "e", float(v)) for i, v in enumerate(x)], "cell_id long, entity string, value double")
    m = spark.createDataFrame([(i, k, float(v)) for k, u in (("m", y), ("none", x * 0)) for i, v in enumerate(u)], "cell_id long, module string, value double")
    got = {r.module: r for r in Q.table_correlation(s, m, 40).collect()}
    c = np.corrcoef(x, y)[0, 1]
    assert np.isclose(got["m"].r, c) and (got["none"].r, got["none"].p) == (0, 1) and 0 < got["m"].p < 1 and got["m"].fdr >= got["m"].p


def test_numbered_is_a_place_in_order(spark):
    df = spark.createDataFrame([(int(v),) for v in rng.permutation(500)], "k long").repartition(7)
    assert all(r.k == r.at for r in numbered(df, ["k"], "at").collect())


def test_replicate_stats_count_absent_rows_as_zero(spark):
    o = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "k string, v double")
    r = spark.createDataFrame([(0, "a", 2.0), (1, "a", 4.0)], "m int, k string, v double")
    got = {x.k: x for x in M.replicate_stats(o, r, ["k"], 3).collect()}
    v = np.array([2, 4, 0.0])
    assert np.isclose(got["a"].z, (5 - v.mean()) / v.std()) and got["a"].p == 0 and got["b"].z == 1 and got["b"].p == 0


def test_annotated_gradient_and_type_correlation(spark):
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "cell_id long, cell_type string")
    x, y = rng.random((6, 5)), rng.random((6, 5))
    long = lambda v: spark.createDataFrame([(i, f"g{k}", float(v[i, k])) for i in range(6) for k in range(5)], "cell_id long, gene string, value double")
    z = lambda v: (v - v.mean(1, keepdims=True)) / v.std(1, keepdims=True)
    zx, zy = z(x), z(y)
    for r in Q.type_correlations(long(x), long(y), cells, 5).collect():
        a, b = np.arange("ab".index(r.type1), 6, 2), np.arange("ab".index(r.type2), 6, 2)
        cross = np.mean([zx[i] @ zy[j] / 5 for i in a for j in b])
        own = np.mean([zx[i] @ zx[j] / 5 for i in a for j in a])
        assert np.isclose(r.r, cross - own)
    field = rng.random((4, 4))
    g = spark.createDataFrame([(i, j, float(field[i, j])) for i in range(4) for j in range(4)], "gx long, gy long, value double")
    dx, dy = np.gradient(field)
    assert all(np.isclose(r.dx, dx[r.gx, r.gy]) and np.isclose(r.dy, dy[r.gx, r.gy]) for r in N.gradient(g).collect())
    assert cells.where(F.col("cell_id") < 0).count() == 0


def test_centralities_of_several_clusters_in_blocks(spark, monkeypatch):
    """Blocks of two genes give what one block gives, and each cluster's vector is its own."""
    rows = [(c, f"g{a}", f"g{b}", float(w)) for c in ("k", "m") for a, b, w in zip(rng.integers(0, 25, 80), rng.integers(0, 25, 80), rng.integers(-5, 6, 80)) if a != b and w]
    df = spark.createDataFrame([*rows, ("z", "a", "b", 2.0), ("z", "a", None, 1.0)][:-1], "cluster string, source string, target string, coef_mean double").repartition(3)
    whole = {(r.cluster, r.gene): r.betweenness for r in K.betweenness(df).collect()}
    monkeypatch.setattr(K, "ROOTS", 2)
    parts = {(r.cluster, r.gene): r.betweenness for r in K.betweenness(df).collect()}
    assert parts.keys() == whole.keys() and all(np.isclose(parts[k], whole[k]) for k in whole)
    eig = {(r.cluster, r.gene): r.eigenvector for r in K.eigenvector_centrality(df).collect()}
    for c in ("k", "m", "z"):
        genes = sorted(g for k, g in eig if k == c)
        a = np.zeros((len(genes), len(genes)))
        for k, s, t, w in [*rows, ("z", "a", "b", 2.0)]:
            if k == c:
                a[genes.index(s), genes.index(t)] += abs(w)
                a[genes.index(t), genes.index(s)] += abs(w)
        v = np.abs(np.linalg.eigh(a)[1][:, -1])
        assert np.allclose([eig[c, g] for g in genes], v / v.max(), atol=1e-6)
    assert K.betweenness(df.limit(0)).count() == 0 and K.eigenvector_centrality(df.limit(0)).count() == 0
