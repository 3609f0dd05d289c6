"""Queries of regressions: fits from sums of products over all cells, zeros included."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import models as M
from tessella.operators.bayes import variational_betas
from tessella.operators.components import components, elbow
from tessella.plans.registry import query, rounded
from tessella.sources import views as V

_DENSE = "dense AS (SELECT c.cell_id AS cell_id, cell_type, g.gene AS gene, coalesce(e.value, 0) AS x FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"
#: Each gene on the next two in name order.
_TWO = "two AS (SELECT ligand AS target, receptor AS f1, (SELECT receptor FROM lr b WHERE b.ligand = a.receptor) AS f2 FROM lr a)"


def _values(spark, d):
    return V.expr(spark, d).select("cell_id", F.col("gene").alias("factor"), F.col("value").alias("x"))


def _two(spark, d):
    lr = V.lr(spark, d).select("ligand", "receptor")
    j = lr.join(lr.toDF("receptor", "_f2"), "receptor")
    one = j.select(F.col("ligand").alias("target"), F.explode(F.array(F.struct(F.col("receptor").alias("f"), F.lit(1).alias("p")), F.struct(F.col("_f2").alias("f"), F.lit(2).alias("p")))).alias("e"))
    return one.select("target", F.col("e.f").alias("factor"), F.col("e.p").cast("long").alias("pos"))


def _all(spark, d):
    """Each gene on all others, in name order."""
    g = V.lr(spark, d).select("ligand", "ord")
    return g.select(F.col("ligand").alias("target")).join(g.select(F.col("ligand").alias("factor"), F.col("ord").alias("pos")), F.col("target") != F.col("factor"))


def _sums(spark, d, by=()):
    return M.products(V.cells(spark, d), _values(spark, d), by=list(by))


_M1 = f"""{V.with_views('expr', 'cells', 'lr')}, {_DENSE}, {_TWO},
w AS (SELECT target, f1, f2, y.cell_id, y.x AS y, a.x AS a, b.x AS b FROM two JOIN dense y ON y.gene = target JOIN dense a ON a.cell_id = y.cell_id AND a.gene = f1 JOIN dense b ON b.cell_id = y.cell_id AND b.gene = f2),
s AS (SELECT target, f1, f2, count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, var_pop(y) AS yy, corr(a, y) AS ra, corr(b, y) AS rb FROM w GROUP BY 1, 2, 3),
f AS (SELECT *, {{a}} AS beta_a, {{b}} AS beta_b FROM s)
SELECT target, f1 AS factor, round(beta_a, 6) AS beta, round(ra, 6) AS r, round(1 - (yy - 2 * beta_a * ay - 2 * beta_b * yb + beta_a * beta_a * aa + 2 * beta_a * beta_b * ab + beta_b * beta_b * bb) / yy, 6) AS model_r2, n AS n_cells FROM f
UNION ALL SELECT target, f2, round(beta_b, 6), round(rb, 6), round(1 - (yy - 2 * beta_a * ay - 2 * beta_b * yb + beta_a * beta_a * aa + 2 * beta_a * beta_b * ab + beta_b * beta_b * bb) / yy, 6), n FROM f"""


def _cramer(ridge: str) -> dict:
    aa, bb = f"(aa + {ridge} / n)", f"(bb + {ridge} / n)"
    return {"a": f"({bb} * ay - ab * yb) / ({aa} * {bb} - ab * ab)", "b": f"({aa} * yb - ab * ay) / ({aa} * {bb} - ab * ab)"}


def _tidy(fits):
    return rounded(fits.select("target", "factor", "beta", "r", "model_r2", "n_cells"), "beta", "r", "model_r2")


@query(_M1.format(**_cramer("0")))
def m1_least_squares(spark, d):
    return _tidy(M.fit_betas(_sums(spark, d), _two(spark, d)))


@query(_M1.format(**_cramer("500")))
def m2_ridge(spark, d):
    return _tidy(M.fit_betas(_sums(spark, d), _two(spark, d), method="ridge", penalty=500.0))


@query()
def m2_elastic_net(spark, d):
    return M.fit_betas(_sums(spark, d), _all(spark, d), method="elastic", penalty=0.5, l1_ratio=0.5)


@query()
def m3_without_labels(spark, d):
    c = V.cells(spark, d)
    hot = M.one_hot(c, "cell_type")
    labels = sorted(r[0] for r in hot.select("factor").distinct().collect())
    return M.fit_betas(M.products(c, _values(spark, d).union(hot)), _all(spark, d), labels=labels, method="l1", penalty=0.2, standardize=True)


@query()
def m4_tidy_fits(spark, d):
    return M.fit_betas(_sums(spark, d), _all(spark, d))


@query()
def m5_bootstrap(spark, d):
    return M.bootstrap_betas(V.cells(spark, d), _values(spark, d), _two(spark, d), 10)


@query()
def m6_sweep(spark, d):
    return M.sweep_betas(_sums(spark, d), _all(spark, d), [0.05, 0.5, 5.0], method="l1")


@query()
def m7_factor_groups(spark, d):
    return M.cluster_factors(_sums(spark, d), _all(spark, d), 0.95)


@query(f"""{V.with_views('expr', 'cells', 'lr')}, {_DENSE}, {_TWO},
z AS (SELECT cell_id, gene, (x - avg(x) OVER (PARTITION BY gene)) / stddev_samp(x) OVER (PARTITION BY gene) AS z FROM dense),
w AS (SELECT target, f1 || '+' || f2 AS factor, y.x AS y, a.z + b.z AS s FROM two JOIN dense y ON y.gene = target JOIN z a ON a.cell_id = y.cell_id AND a.gene = f1 JOIN z b ON b.cell_id = y.cell_id AND b.gene = f2)
SELECT target, factor, 'cluster' AS grp, round(regr_slope(y, s) * stddev_pop(s), 6) AS beta, round(corr(y, s), 6) AS r FROM w GROUP BY 1, 2""")
def m8_reduced_groups(spark, d):
    fits = M.fit_betas(_sums(spark, d), _two(spark, d).withColumn("cluster", F.lit(1)), standardize=True)
    return rounded(fits.select("target", "factor", "grp", "beta", "r"), "beta", "r")


def _candidates(spark, d):
    return V.lr(spark, d).select(F.col("ligand").alias("target")).join(V.lr(spark, d).select(F.col("ligand").alias("source")), F.col("target") != F.col("source"))


@query()
def m9_bayesian_links(spark, d):
    return M.infer_links(V.cells(spark, d), V.expr(spark, d), _candidates(spark, d), ["cell_type"], method="bayesian_ridge")


@query()
def m10_bagging_ridge(spark, d):
    return M.infer_links(V.cells(spark, d), V.expr(spark, d), _candidates(spark, d), bags=20, alpha=5.0)


@query()
def m11_links(spark, d):
    return M.infer_links(V.cells(spark, d), V.expr(spark, d), _candidates(spark, d), ["cell_type"], bags=5, alpha=5.0)


@query()
def m12_ridge_matrix(spark, d):
    return M.ridge_coefficients(V.cells(spark, d), V.expr(spark, d), _candidates(spark, d), alpha=1.0)


@query()
def m25_components(spark, d):
    pcs, _, share = components(V.expr(spark, d), V.cells(spark, d), 20)
    kept = elbow(share)
    return pcs.select("cell_id", F.posexplode("pcs").alias("component", "score")).withColumn("kept", F.col("component") < kept)


@query()
def m26_anchors(spark, d):
    return M.anchor_betas(_sums(spark, d, ["cell_type"]), _all(spark, d), ["cell_type"], penalty=0.05, least_r2=0.0)


@query(f"""{V.with_views('expr', 'cells', 'lr')}, {_DENSE}
SELECT y.cell_type AS cell_type, ligand AS target, receptor AS factor, round(regr_slope(y.x, a.x), 6) AS beta, round(corr(y.x, a.x), 6) AS r, count(*) AS n_cells FROM lr JOIN dense y ON y.gene = ligand JOIN dense a ON a.cell_id = y.cell_id AND a.gene = receptor GROUP BY 1, 2, 3""")
def m27_per_cluster(spark, d):
    design = V.lr(spark, d).select(F.col("ligand").alias("target"), F.col("receptor").alias("factor"), F.lit(1).cast("long").alias("pos"))
    return rounded(M.fit_betas(_sums(spark, d, ["cell_type"]), design, ["cell_type"]).select("cell_type", "target", "factor", "beta", "r", "n_cells"), "beta", "r")


@query()
def m27_variational(spark, d):
    return variational_betas(_sums(spark, d, ["cell_type"]), _all(spark, d), ["cell_type"])


@query(f"{V.with_views('betas')}, m AS (SELECT target, modulator, avg(beta) AS beta FROM betas GROUP BY 1, 2)\nSELECT target, modulator, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(round(beta, 9)) DESC, modulator) AS rank FROM m) q")
def w5_ranked_coefficients(spark, d):
    b = V.betas(spark, d).groupBy("target", F.col("modulator").alias("factor")).agg(F.round(F.avg("beta"), 9).alias("beta"))
    return M.rank_coefficients(b).select("target", F.col("factor").alias("modulator"), F.col("rank").cast("long").alias("rank"))
