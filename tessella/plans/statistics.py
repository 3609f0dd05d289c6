"""Queries of the tests and summaries, with the same in SQL over dense tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import statistics as X
from tessella.operators import tables as T
from tessella.plans.registry import bh, longs, normal_sf, query, rounded
from tessella.sources import views as V

_DENSE = "dense AS (SELECT c.cell_id, cell_type, g.gene, coalesce(e.value, 0) AS x FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"
_LOGGED = _DENSE.replace("coalesce(e.value, 0)", "ln(1 + coalesce(e.value, 0))")
_RANKED = "r AS (SELECT gene, x, cell_type = 'BUILDING' AS one, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0e0 AS rank, count(*) OVER (PARTITION BY gene, x) AS m FROM dense)"


def _danb(keys: str, on: str) -> str:
    return f"""{V.with_views('cells', 'expr')}, {_DENSE}, u AS (SELECT cell_id, sum(x) AS u FROM dense GROUP BY 1), d AS (SELECT dense.*, u FROM dense JOIN u USING (cell_id)),
tot AS (SELECT {keys}sum(u) AS total, sum(u * u) AS u2 FROM cells JOIN u USING (cell_id){' GROUP BY 1' if keys else ''}), g AS (SELECT {keys}gene, sum(x) AS t FROM d GROUP BY {'1, 2' if keys else '1'}),
m AS (SELECT d.cell_id, d.gene, d.cell_type, x, t, total, u2, t * u / total AS mu FROM d JOIN g ON g.gene = d.gene{on.format('g')} JOIN tot ON true{on.format('tot')}),
s AS (SELECT {keys}gene, max(t * t / total * u2 / total) / (sum((x - mu) * (x - mu)) - max(t) + 1e-10) AS size FROM m GROUP BY {'1, 2' if keys else '1'}), z AS (SELECT {keys}gene, greatest(CASE WHEN size < 0 THEN 1e9 ELSE size END, 1e-10) AS size FROM s)
SELECT m.cell_id, m.gene, round(CASE WHEN mu > 0 THEN (x - mu) / sqrt(mu * (1 + mu / size)) ELSE 0 END, 5) AS z FROM m JOIN z ON z.gene = m.gene{on.format('z').replace('d.', 'm.')}{' WHERE t > 0' if keys else ''}"""


@query(_danb("", ""))
def a18_standardised(spark, d):
    return rounded(X.standardise_counts(V.expr(spark, d), V.cells(spark, d)), "z", digits=5)


@query(_danb("cell_type, ", " AND {}.cell_type = d.cell_type"))
def a19_standardised_by_type(spark, d):
    return rounded(X.standardise_counts(V.expr(spark, d), V.cells(spark, d), "cell_type"), "z", digits=5)


@query(f"{V.with_views('cells', 'expr')}, {_LOGGED}, {_RANKED}, s AS (SELECT gene, sum(rank) FILTER (one) AS r1, CAST(count(*) FILTER (one) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT one) AS DOUBLE) AS n2, avg(x) FILTER (one) AS m1, avg(x) FILTER (NOT one) AS m2 FROM r GROUP BY 1), z AS (SELECT gene, log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)) AS log2fc, (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS score FROM s), p AS (SELECT gene, least(1, 2 * {normal_sf('abs(score)')}) AS p FROM z)\nSELECT gene, round(log2fc, 6) AS log2fc, round(score, 6) AS score, round(f.p, 6) AS p, round(fdr, 6) AS p_adj FROM z JOIN {bh('p', 'gene', 'gene')} f USING (gene)")
def a30_rank_sum_degs(spark, d):
    logged = V.expr(spark, d).withColumn("value", F.log1p("value"))
    return rounded(X.adjusted_degs(X.rank_sum_degs(logged, V.cells(spark, d), F.col("cell_type") == "BUILDING")), "log2fc", "score", "p", "p_adj")


@query(f"{V.with_views('cells', 'expr')}, {_DENSE}, {_RANKED}, s AS (SELECT gene, sum(rank) FILTER (one) AS r1, CAST(count(*) FILTER (one) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT one) AS DOUBLE) AS n2, avg(x) FILTER (one) AS m1, avg(x) FILTER (NOT one) AS m2, var_samp(x) FILTER (one) AS v1, var_samp(x) FILTER (NOT one) AS v2, sum(m * m - 1.0e0) AS ties FROM r GROUP BY 1)\nSELECT gene, round(z, 6) AS z, round(d, 6) AS d, round({normal_sf('z')}, 6) AS p FROM (SELECT gene, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5e0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s) q")
def a32_mann_whitney(spark, d):
    return rounded(X.mann_whitney_greater(V.expr(spark, d), V.cells(spark, d), F.col("cell_type") == "BUILDING"), "z", "d", "p")


@query(f"{V.with_views('links')}, degs AS (SELECT cluster AS batch, source AS gene, avg(coef_mean) AS log2fc, sum(coef_mean) AS score, least(1, avg(p)) AS pval, min(p) AS pval_adj FROM links GROUP BY 1, 2), g AS (SELECT gene, avg(log2fc) AS log2fc, avg(score) AS score, count(log2fc) AS n_batches, count(*) FILTER (pval_adj < 0.05) AS n_batches_sig, greatest(count(*) FILTER (log2fc > 0), count(*) FILTER (log2fc < 0)) / CAST(count(log2fc) AS DOUBLE) AS sc, sum(-ln(greatest(pval, 1e-300))) AS x FROM degs GROUP BY 1)\nSELECT gene, round(log2fc, 6) AS log2fc, round(score, 6) AS score, n_batches, n_batches_sig, round(sc, 6) AS sign_consistency, round(k.p, 8) AS pval, round(fdr, 8) AS pval_adj FROM g JOIN {bh("(SELECT gene, exp(-x) * (1 + x + x * x / 2) AS p FROM g WHERE sc >= 0.6 AND n_batches_sig >= 0.3 * 3)", 'gene', 'gene')} k USING (gene)")
def a31_combined_degs(spark, d):
    by = V.links(spark, d).groupBy(F.col("cluster").alias("batch"), F.col("source").alias("gene")).agg(F.avg("coef_mean").alias("log2fc"), F.sum("coef_mean").alias("score"), F.least(F.lit(1.0), F.avg("p")).alias("pval"), F.min("p").alias("pval_adj"))
    out = X.combined_and_adjusted(by, 3, sign_share=0.6, sig_share=0.3)
    return rounded(rounded(out, "log2fc", "score", "sign_consistency"), "pval", "pval_adj", digits=8)


@query(f"{V.with_views('cells', 'expr')}, {_DENSE}\nSELECT gene, count(*) FILTER (x > 0) AS detected, round(log2(avg(x)), 6) AS log_mean, round(log2(stddev_samp(x) / avg(x)), 6) AS log_cv FROM dense GROUP BY 1")
def a49_variation(spark, d):
    return rounded(X.variation_fit(V.expr(spark, d), V.cells(spark, d).count()), "log_mean", "log_cv")


@query(f"{V.with_views('betas')}\nSELECT target, modulator, round(min(beta), 6) AS least, round(max(beta), 6) AS most, round(avg(beta), 6) AS mean, round(var_pop(beta), 6) AS var, round(avg(beta) * avg(beta), 5) AS mean_sq, round(avg(beta * beta), 5) AS msd, round(quantile_cont(beta, 0.05), 6) AS p5, round(quantile_cont(beta, 0.95), 6) AS p95 FROM betas GROUP BY 1, 2")
def a52_interval_stats(spark, d):
    return rounded(rounded(X.interval_stats(V.betas(spark, d), ["target", "modulator"], "beta"), "least", "most", "mean", "var", "p5", "p95"), "mean_sq", "msd", digits=5)


@query(f"{V.with_views('betas')}, b AS (SELECT target, modulator, cell_id, sign(beta) AS s, beta FROM betas), nz AS (SELECT *, lag(s) OVER (PARTITION BY target, modulator ORDER BY cell_id) AS last FROM b WHERE s <> 0), f AS (SELECT target, modulator, count(*) FILTER (last <> s) AS n FROM nz GROUP BY 1, 2)\nSELECT target, modulator, min(beta) AS least, max(beta) AS most, coalesce(max(n), 0) AS n_sign_flips, round(avg(CASE WHEN beta = 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS frac_zero, coalesce(max(n), 0) = 0 AS stable_sign FROM b LEFT JOIN f USING (target, modulator) GROUP BY 1, 2")
def a54_penalty_path(spark, d):
    return rounded(X.penalty_path(V.betas(spark, d).withColumnRenamed("cell_id", "penalty"), ["target", "modulator"]), "frac_zero")


@query(f"{V.with_views('betas')}, s AS (SELECT target, modulator, quantile_cont(beta, 0.45) AS lo, quantile_cont(beta, 0.55) AS hi FROM betas GROUP BY 1, 2)\nSELECT target, modulator FROM s WHERE lo >= 0 OR hi <= 0")
def f13_sign_stable(spark, d):
    s = X.interval_stats(V.betas(spark, d), ["target", "modulator"], "beta", (0.45, 0.55))
    return s.where(X.sign_stable(F.col("p45"), F.col("p55"))).select("target", "modulator")


@query(f"{V.with_views('expr')}\nSELECT cell_id, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000), 6) AS value FROM expr")
def a27_log_normalised(spark, d):
    return rounded(T.log_cpm(V.expr(spark, d), 1e4), "value")


@query(f"{V.with_views('expr')}\nSELECT cell_id, gene, round(CASE WHEN (SELECT max(value) FROM expr) > 100 THEN ln(1 + value) ELSE value END, 6) AS value FROM expr")
def a28_conditional_log(spark, d):
    return rounded(X.conditional_log(V.expr(spark, d)), "value")


_CORR = f"{V.with_views('cells', 'expr')}, {_DENSE}, ent AS (SELECT cell_id, gene AS entity, {{v}} AS v FROM dense), mod AS (SELECT cell_id, 'mod' || CAST(length(gene) % 2 AS VARCHAR) || substr(gene, length(gene)) AS module, {{w}} AS w FROM dense GROUP BY 1, 2)"


def _tables(spark, d):
    e = V.expr(spark, d)
    module = F.concat(F.lit("mod"), (F.length("gene") % 2).cast("string"), F.substring("gene", -1, 1))
    return e.select("cell_id", F.col("gene").alias("entity"), "value"), e.groupBy("cell_id", module.alias("module")).agg(F.sum("value").alias("value")), V.cells(spark, d).count()


@query(f"{_CORR.format(v='x', w='sum(x)')}\nSELECT entity, module, round(corr(v, w), 6) AS r FROM ent JOIN mod USING (cell_id) GROUP BY 1, 2")
def a23_correlation(spark, d):
    return rounded(X.table_correlation(*_tables(spark, d)).select("entity", "module", "r"), "r")


@query(f"{_CORR.format(v='x', w='sum(x)')}, er AS (SELECT cell_id, entity, rank() OVER (PARTITION BY entity ORDER BY v) + (count(*) OVER (PARTITION BY entity, v) - 1) / 2.0e0 AS v FROM ent), mr AS (SELECT cell_id, module, rank() OVER (PARTITION BY module ORDER BY w) + (count(*) OVER (PARTITION BY module, w) - 1) / 2.0e0 AS w FROM mod)\nSELECT entity, module, round(corr(v, w), 6) AS r FROM er JOIN mr USING (cell_id) GROUP BY 1, 2")
def a23_rank_correlation(spark, d):
    return rounded(X.table_correlation(*_tables(spark, d), "spearman").select("entity", "module", "r"), "r")


@query()
def a23_significance(spark, d):
    return X.table_correlation(*_tables(spark, d))


@query(f"{V.with_views('cells', 'expr')}, {_DENSE}, other AS (SELECT cell_id, gene, CASE WHEN gene < 'Brand#2' THEN 2 * x ELSE x / 2 END AS x FROM dense), za AS (SELECT d.cell_id, cell_type, gene, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM dense d WINDOW w AS (PARTITION BY d.cell_id)), zb AS (SELECT o.cell_id, c.cell_type, gene, (o.x - avg(o.x) OVER w) / stddev_pop(o.x) OVER w AS z FROM other o JOIN cells c ON c.cell_id = o.cell_id WINDOW w AS (PARTITION BY o.cell_id)), n AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1), ma AS (SELECT cell_type, gene, sum(CASE WHEN isfinite(z) THEN z ELSE 0 END) / max(n) AS m FROM za JOIN n USING (cell_type) GROUP BY 1, 2), mb AS (SELECT cell_type, gene, sum(CASE WHEN isfinite(z) THEN z ELSE 0 END) / max(n) AS m FROM zb JOIN n USING (cell_type) GROUP BY 1, 2), own AS (SELECT cell_type, avg(m * m) AS o FROM ma GROUP BY 1)\nSELECT a.cell_type AS type1, b.cell_type AS type2, round(avg(a.m * b.m) - max(o), 6) AS r FROM ma a JOIN mb b ON a.gene = b.gene JOIN own ON own.cell_type = a.cell_type GROUP BY 1, 2")
def a39_type_correlations(spark, d):
    e = V.expr(spark, d)
    other = e.withColumn("value", F.when(F.col("gene") < "Brand#2", 2 * F.col("value")).otherwise(F.col("value") / 2))
    n = e.select("gene").distinct().count()
    return rounded(X.type_correlations(e, other, V.cells(spark, d), n), "r")


_PAIRED = f"{V.with_views('expr')}, d AS (SELECT gene, least(value - 25, 0) - least(25 - value * 0.5e0, 0) AS d FROM expr), nz AS (SELECT gene, abs(d) AS a, d > 0 AS up FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY a) + (count(*) OVER (PARTITION BY gene, a) - 1) / 2.0e0 AS r, count(*) OVER (PARTITION BY gene, a) AS m FROM nz), s AS (SELECT gene, count(*) AS n, CAST(coalesce(sum(r) FILTER (up), 0) AS DOUBLE) AS w, sum(m * m - 1.0e0) AS t FROM r GROUP BY 1), z AS (SELECT gene, n, w, (w - n * (n + 1) / 4.0e0) / sqrt(n * (n + 1.0e0) * (2 * n + 1) / 24 - t / 48) AS z FROM s)"


@query(f"{_PAIRED}\nSELECT gene, n, w, round(z, 6) AS z, round({normal_sf('(-z)')}, 6) AS p FROM z")
def a48_signed_rank(spark, d):
    e = V.expr(spark, d).select("gene", X.clipped(F.col("value") - 25, False).alias("x"), X.clipped(25 - F.col("value") * 0.5, False).alias("y"))
    return rounded(X.signed_rank(e, False, ["gene"]), "z", "p")


_FIT = f"{V.with_views('cells', 'expr')}, {_DENSE}, g AS (SELECT gene, log2(avg(x)) AS m, log2(stddev_samp(x) / avg(x)) AS c FROM dense GROUP BY 1), s AS (SELECT count(*) * 1.0e0 AS s0, sum(m) AS s1, sum(m * m) AS s2, sum(m * m * m) AS s3, sum(m * m * m * m) AS s4, sum(c) AS t0, sum(c * m) AS t1, sum(c * m * m) AS t2 FROM g), det AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d FROM s), k AS (SELECT (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d AS a, (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / d AS b, (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / d AS c2 FROM det), sc AS (SELECT gene, g.c - (a + b * m + c2 * m * m) AS score FROM g CROSS JOIN k)"


@query(f"{_FIT}\nSELECT gene, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC) <= 9 AS selected FROM sc")
def a49_variable_genes(spark, d):
    return rounded(X.variable_genes(V.expr(spark, d), V.cells(spark, d).count(), 8, most_mean=1e9, fit="parabola"), "score", digits=4)


@query()
def a49_kernel_scores(spark, d):
    return rounded(X.variable_genes(V.expr(spark, d), V.cells(spark, d).count(), 8, most_mean=1e9), "score", digits=4)


@query(f"{V.with_views('cells', 'expr')}, {_DENSE}, g AS (SELECT gene, avg(x) AS mean, var_samp(x) / avg(x) AS disp FROM dense GROUP BY 1), q AS (SELECT quantile_cont(mean, [{', '.join(str(k / 100) for k in range(10, 105, 5))}]) AS q FROM g), b AS (SELECT gene, mean, disp, (SELECT count(*) FROM unnest(q) u(c) WHERE mean > c) AS b FROM g CROSS JOIN q), m AS (SELECT b, median(disp) AS m FROM b GROUP BY 1), a AS (SELECT b.b AS b, median(abs(disp - m)) / 0.6744897501960817e0 AS d FROM b JOIN m ON m.b = b.b GROUP BY 1), n AS (SELECT gene, mean, disp, CASE WHEN d > 0 THEN (disp - m) / d END AS norm FROM b JOIN m ON m.b = b.b JOIN a ON a.b = b.b)\nSELECT gene, round(mean, 6) AS mean, round(disp, 6) AS dispersion, round(norm, 5) AS norm, rank FROM (SELECT *, row_number() OVER (ORDER BY round(norm, 9) DESC NULLS LAST, gene) AS rank FROM n) x WHERE rank <= 12 AND norm IS NOT NULL")
def a50_highly_variable(spark, d):
    return longs(rounded(rounded(X.highly_variable(V.expr(spark, d), V.cells(spark, d).count(), 12), "mean", "dispersion"), "norm", digits=5), "rank")


@query(f"{V.with_views('cells', 'expr')}, {_DENSE}, q AS (SELECT gene, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.9) AS hi FROM dense GROUP BY 1)\nSELECT cell_id, gene, round(greatest(least(x, hi), lo), 6) AS value FROM dense JOIN q USING (gene) WHERE x > 0")
def a49_winsorised(spark, d):
    return rounded(X.winsorised(V.expr(spark, d), V.cells(spark, d).count(), 0.01, 0.9), "value")
