import math

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import communication as C
from tessella.operators import factors as X
from tessella.operators import spatial as P
from tessella.operators import statistics as Q
from tessella.operators import tables as T


def points(spark):
    return spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "a", 30.0, 0.0), (2, "b", 0.0, 30.0), (3, "b", -0.1, -29.0), (4, "b", 500.0, 500.0)], "cell_id long, cell_type string, x double, y double")


def test_range_join_keeps_the_boundary_and_self(spark):
    p = points(spark)
    got = {(r.i, r.j) for r in P.range_join(p, p, 30.0).collect()}
    xy = {r.cell_id: (r.x, r.y) for r in p.collect()}
    assert got == {(i, j) for i in xy for j in xy if math.dist(xy[i], xy[j]) <= 30}
    assert (0, 1) not in {(r.i, r.j) for r in P.range_join(p, p, 30.0, strict=True).collect()}


def test_received_divides_by_all_cells(spark):
    p = points(spark)
    e = spark.createDataFrame([(4, "g", 10.0)], "cell_id long, gene string, value double")
    assert [(r.cell_id, round(r.value, 9)) for r in P.received(p, e, 30.0, 5).collect()] == [(4, 2.0)]


def test_benjamini_hochberg_counts_null_as_one(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r.k: round(r.fdr, 6) for r in C.benjamini_hochberg(df, tie=["k"]).collect()}
    assert got == {"a": 0.04, "b": round(0.04 * 4 / 3, 6), "c": round(0.04 * 4 / 3, 6), "d": 1.0}


def test_names_and_tails(spark):
    df = spark.createDataFrame([("metab@x$y", 0.0), ("a$b", 1.96), ("a#b", -1.0), ("tf", 3.0)], "m string, z double")
    got = df.select(S.modulator_group(F.col("m")).alias("g"), S.normal_sf(F.col("z")).alias("p")).collect()
    assert [r.g for r in got] == ["metab", "lr", "ltf", "tf"]
    assert np.allclose([r.p for r in got], [0.5, 0.0249979, 0.8413447, 0.0013499], atol=1e-6)


def test_equal_pair_sets_merge(spark):
    df = spark.createDataFrame([("m1", "a", "b"), ("m2", "b", "a"), ("m3", "a", "c")], "name string, g1 string, g2 string")
    assert {r.name for r in T.merge_equal_sets(df).collect()} == {"m1|m2", "m3"}


def test_interval_overlap_makes_each_pair_once(spark):
    a = spark.createDataFrame([("c", 0, 500, 1), ("c", 900, 1000, 2)], "chrom string, start long, end long, id long")
    b = spark.createDataFrame([("c", 100, 950, 7), ("d", 0, 10, 8), ("c", 500, 600, 9)], "chrom string, start long, end long, id long")
    assert sorted((r.a_id, r.b_id) for r in P.interval_overlap(a, b, 100).collect()) == [(1, 7), (2, 7)]


def test_perturbation_equals_matrices(spark):
    """Ligand L, receptor R, regulator U, target T and a plain factor, over four cells, hop by hop with dense arrays."""
    rng = np.random.default_rng(3)
    genes, names = ["L", "R", "U", "T"], {"T": ["L$R", "L#U", "U"], "R": ["U"]}
    x = rng.integers(0, 5, (4, 4)).astype(float)
    xy = np.array([[0, 0], [10, 0], [0, 20], [300, 300]], float)
    beta = {(t, m): rng.normal(size=4) for t in names for m in names[t]}
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    kernel = np.where(d2 <= 900, np.exp(-d2 / (2 * S.sigma(30.0) ** 2)), 0) / 4
    given = np.zeros((4, 4))
    given[:, 0] = 7 - x[:, 0]
    top, w0 = x.max(0), kernel @ x[:, 0]
    now, got, delta = x, w0, given
    for _ in range(3):
        slope = {g: np.zeros((4, 4)) for g in "TR"}
        slope["R"][:, 2] = beta["R", "U"]
        slope["T"][:, 0] = beta["T", "L$R"] * now[:, 1] + beta["T", "L#U"] * now[:, 2]
        slope["T"][:, 1] = np.where(now[:, 1] > 0, beta["T", "L$R"] * got, 0)
        slope["T"][:, 2] = beta["T", "L#U"] * got + beta["T", "U"]
        now = x + delta
        got = kernel @ now[:, 0]
        step = delta.copy()
        step[:, 0] = got - w0
        moved = np.zeros((4, 4))
        moved[:, 3], moved[:, 1] = (slope["T"] * step).sum(1), (slope["R"] * step).sum(1)
        delta = np.clip(x + np.where(given != 0, given, moved), 0, top) - x
    want = x + delta
    want[:, 0] = 7
    cells = spark.createDataFrame([(i, *map(float, xy[i])) for i in range(4)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([(i, g, float(x[i, k])) for i in range(4) for k, g in enumerate(genes) if x[i, k]], "cell_id long, gene string, value double")
    betas = spark.createDataFrame([(t, i, m, float(b[i])) for (t, m), b in beta.items() for i in range(4)], "target string, cell_id long, modulator string, beta double")
    levels = spark.createDataFrame([(i, "L", 7.0) for i in range(4)], "cell_id long, gene string, level double")
    out = np.zeros((4, 4))
    for r in X.perturb(expr, cells, betas, levels, 30.0, hops=3).collect():
        out[r.cell_id, genes.index(r.gene)] = r.value
    assert np.allclose(out, want)


def test_combined_p_follows_fisher(spark):
    rows = [(b, "g", 1.0, 1.0, p, 0.01) for b, p in zip("abc", [0.1, 0.02, 0.5])]
    df = spark.createDataFrame([*rows, ("a", "h", 1.0, 1.0, 0.5, 0.5)], "batch string, gene string, log2fc double, score double, pval double, pval_adj double")
    (r,) = Q.combine_degs(df, 3).collect()
    half = -math.log(0.1 * 0.02 * 0.5)
    assert r.gene == "g" and math.isclose(r.pval, math.exp(-half) * (1 + half + half**2 / 2))


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "cell_id long, cell_type string, x double, y double")
    expr = spark.createDataFrame([], "cell_id long, gene string, value double")
    assert Q.standardise_counts(expr, cells).count() == 0
    assert Q.rank_sum_degs(expr, cells, F.col("cell_type") == "a").count() == 0
    assert P.received(cells, expr, 30.0, 1).count() == 0


def test_readers(spark, tmp_path):
    from tessella.sources import readers as R

    spark.createDataFrame([("c0", 1.0, 2.0, 0.5, 3.0)], "cell string, beta0 double, `beta_metab@G` double, `beta_A$B` double, beta_TF double").write.parquet(str(tmp_path / "b" / "CD4_betadata.parquet"))
    long = R.read_wide_betas(spark, str(tmp_path / "b" / "*_betadata.parquet"), "lr")
    assert "modulator" in long.columns and [(r.modulator, r.beta, r.grp) for r in long.collect()] == [("A$B", 0.5, "lr")]
    (tmp_path / "s.json").write_text('{"metabolites": [{"name": "m", "gene_pairs": [["a", "b"]]}, {"name": "m", "gene_pairs": [["c", "d"]]}]}')
    assert [(r.metabolite, r.g1, r.pos) for r in R.read_selection(spark, str(tmp_path / "s.json")).collect()] == [("m", "a", 0), ("m", "c", 1)]
    (tmp_path / "r.csv").write_text(",Metabolite,C_p,selected\n0,m,1.5,True\n1,n,,False\n")
    assert [(r.metabolite, r.C_p, r.selected) for r in R.read_result_csv(spark, str(tmp_path / "r.csv")).collect()] == [("m", 1.5, True), ("n", None, False)]
    peaks = spark.createDataFrame([("chr_Un_1_10_20",)], "peak_id string")
    assert R.peak_columns(peaks).select("chrom", "start", "end").first() == ("chr_Un_1", 10, 20)


def test_rank_tests_of_a_hundred_thousand_cells(spark):
    """Products of group sizes beyond the integers: both tests' statistics from their formulas in plain floats."""
    n = 100_000
    cells = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") % 2 == 0).alias("one"))
    values = spark.range(n).select(F.col("id").alias("cell_id"), F.lit("g").alias("gene"), ((F.col("id") * 7919) % 1000 + 1 + (F.col("id") % 2)).cast("double").alias("value"))
    v = np.array([i * 7919 % 1000 + 1 + i % 2 for i in range(n)], float)
    one = np.arange(n) % 2 == 0
    _, at, m = np.unique(v, return_inverse=True, return_counts=True)
    rank = (np.cumsum(m) - (m - 1) / 2)[at]
    n1, n2 = float(one.sum()), float((~one).sum())
    r1 = rank[one].sum()
    got = Q.rank_sum_degs(values, cells, F.col("one")).first()
    assert abs(got.score - (r1 - n1 * (n + 1) / 2) / (n1 * n2 * (n + 1) / 12) ** 0.5) < 1e-9
    ties = (m.astype(float) ** 3 - m).sum()
    got = Q.mann_whitney_greater(values, cells, F.col("one")).first()
    sd = (n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1.0)))) ** 0.5
    assert abs(got.z - (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sd) < 1e-9


def test_equal_means_rank_by_name_whatever_the_last_bit(spark):
    rows = [("t", "b", 0.1 + 0.2), ("t", "a", 0.3), ("t", "c", 0.30000001), ("t", "d", -0.25)]
    w = spark.createDataFrame(rows, "tf string, ligand string, weight double")
    assert [r.ligand for r in X.top_ligands(w, -0.25, 3).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.ligand for r in X.top_then_back_fill(w, -0.25 + 1e-12, 5).orderBy("rank").collect()] == ["c", "a", "b"]


def test_support_vectors_are_optimal_for_the_exact_kernel():
    """No pair of points gains from moving weight, which makes the solution of this convex problem; bins cost less than the tolerance."""
    r = np.random.default_rng(6)
    x = np.r_[r.normal(size=150) * 3, 1.0, 1.0]
    y = np.sin(x) + 0.3 * r.normal(size=152)
    for gamma, c in ((1.0, 1.0), (150 / 152, 0.2)):
        w, centre, weight, bias = Q.support_vectors(x, y, gamma, c, 0.1, bins=1 << 14)
        assert abs(w.sum()) < 1e-9 and np.abs(w).max() <= c
        f = np.exp(-gamma * (x[:, None] - x) ** 2) @ w
        up, down = f - y + np.where(w >= 0, 0.1, -0.1), f - y + np.where(w > 0, 0.1, -0.1)
        assert down[w > -c].max() - up[w < c].min() < 0.01
        assert np.abs(np.exp(-gamma * (x[:, None] - centre) ** 2) @ weight - f).max() < 0.005
        inside = (np.abs(w) > 1e-9) & (np.abs(w) < c - 1e-9)  # on the edge of the tube
        assert np.allclose(np.abs(f + bias - y)[inside], 0.1, atol=0.01)


def test_variable_genes_lie_above_the_curve(spark):
    r = np.random.default_rng(7)
    mean = np.exp(r.uniform(-1, 2, 60))
    x = r.poisson(mean, (200, 60)).astype(float)
    x[:, 5] *= r.gamma(0.5, 2, 200)
    rows = [(int(i), f"g{j:02d}", float(x[i, j])) for i, j in np.argwhere(x > 0)]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    for fit in ("kernel", "parabola"):
        got = {v.gene: v for v in Q.variable_genes(expr, 200, 3, fit=fit).collect()}
        assert len(got) == 60 and max(got.values(), key=lambda v: v.score).gene == "g05" and sum(v.selected for v in got.values()) == 4
    assert Q.variable_genes(expr.limit(0), 200, 3).count() == 0
