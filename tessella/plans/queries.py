"""One query per operator over the projected tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions.lineage import cut
from tessella.operators import communication as C
from tessella.operators import factors as X
from tessella.operators import models as M
from tessella.operators import spatial as P
from tessella.operators import tables as T
from tessella.plans import cellwise, designs, enrichment, factors, filters, neighbourhoods, permutations, regressions, results, statistics, viewer  # noqa: F401  they register their queries
from tessella.plans.registry import EDGES, FOLDED, NEAR, PAIRS, QUERIES, RADIUS, SQL, knn, longs, pairs, query, rounded
from tessella.sources import views as V
from tessella.streaming.incremental import windowed_counts


@query(f"{V.with_views('cells', 'expr')}, {NEAR}\nSELECT i AS cell_id, gene, round(sum(exp(-d2 / {2 * S.sigma(RADIUS) ** 2!r}e0) * value) / (SELECT count(*) FROM cells), 6) AS value FROM near JOIN expr ON j = expr.cell_id GROUP BY 1, 2")
def a1_received_ligand(spark, d):
    c = V.cells(spark, d)
    return rounded(P.received(c, V.expr(spark, d), RADIUS, c.count()), "value")


@query(f"{V.with_views('cells')}, {NEAR}\nSELECT i AS cell_id, cell_type AS nbr_type, count(*) AS n FROM near JOIN cells ON j = cells.cell_id GROUP BY 1, 2")
def j2_neighbour_types(spark, d):
    return P.neighbour_types(V.cells(spark, d), RADIUS)


@query(f"{V.with_views('cells')}, {knn(5)}\nSELECT i, j, round(d2, 6) AS d2, rank FROM knn")
def j3_nearest_cells(spark, d):
    c = V.cells(spark, d)
    return longs(rounded(P.nearest(c, c, 5), "d2"), "rank")


@query(f"{V.with_views('cells')}, {NEAR}\nSELECT DISTINCT i AS cell_id FROM near WHERE j % 97 = 0")
def j5_within_of_seeds(spark, d):
    c = V.cells(spark, d)
    return P.within_of(c, c.where("cell_id % 97 = 0"), RADIUS)


_IV = "a AS (SELECT 'chr' || CAST(p_partkey % 5 AS VARCHAR) AS chrom, p_partkey * 37 % 100000 AS s, p_partkey * 37 % 100000 + p_size * 20 AS e, p_partkey AS id FROM part), b AS (SELECT 'chr' || CAST(s_suppkey % 5 AS VARCHAR) AS chrom, s_suppkey * 101 % 100000 AS s, s_suppkey * 101 % 100000 + 500 AS e, s_suppkey AS id FROM supplier)"


@query(f"WITH {_IV}\nSELECT a.chrom AS chrom, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e")
def j10_interval_overlap(spark, d):
    p, s = V.table(spark, d, "part"), V.table(spark, d, "supplier")
    a = p.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")).alias("chrom"), (F.col("p_partkey") * 37 % 100000).alias("start"), (F.col("p_partkey") * 37 % 100000 + F.col("p_size") * 20).alias("end"), F.col("p_partkey").alias("id"))
    b = s.select(F.concat(F.lit("chr"), (F.col("s_suppkey") % 5).cast("string")).alias("chrom"), (F.col("s_suppkey") * 101 % 100000).alias("start"), (F.col("s_suppkey") * 101 % 100000 + 500).alias("end"), F.col("s_suppkey").alias("id"))
    return P.interval_overlap(a, b, 2000)


_AGN = f"{V.with_views('cells', 'expr', 'lr')}, {EDGES}, {PAIRS}, {FOLDED}"
_SCORES = "scores AS (SELECT g1, g2, sum(x.value * w * y.value) / CASE WHEN g1 = g2 THEN 2 ELSE 1 END AS c FROM twice JOIN expr x ON i = x.cell_id JOIN pairs ON x.gene = g1 JOIN expr y ON j = y.cell_id AND y.gene = g2 GROUP BY g1, g2)"
_MOMENTS = "per AS (SELECT i, gene, sum(w * value) AS s FROM twice JOIN expr ON j = expr.cell_id GROUP BY 1, 2), moments AS (SELECT gene, sum(s * s) AS eg2 FROM per GROUP BY 1)"
#: Scores about their mean, so that some are below 0.
_OFF = "off AS (SELECT g1, g2, c - avg(c) OVER () AS c FROM scores)"
_SIDES = "w2 AS (SELECT sum(w * w) AS w2 FROM folded), sides AS (SELECT o.g1 AS g1, o.g2 AS g2, c, CASE WHEN o.g1 = o.g2 THEN w2 ELSE a.eg2 END AS a, CASE WHEN o.g1 = o.g2 THEN w2 ELSE b.eg2 END AS b FROM {scores} o JOIN moments a ON a.gene = o.g1 JOIN moments b ON b.gene = o.g2 CROSS JOIN w2), zz AS (SELECT g1, g2, c, CASE WHEN abs(c / sqrt(CASE WHEN a = 0 THEN 1 ELSE a END)) < abs(c / sqrt(CASE WHEN b = 0 THEN 1 ELSE b END)) THEN a ELSE b END AS eg2 FROM sides)"
_ROOT = "sqrt(CASE WHEN eg2 = 0 THEN 1 ELSE eg2 END)"


def _scores(spark, d):
    return C.near_pair_scores(V.cells(spark, d), V.expr(spark, d), pairs(spark, d), RADIUS)


@query(f"{_AGN}, {_SCORES}\nSELECT g1, g2, round(c, 3) AS c FROM scores")
def a10_pair_scores(spark, d):
    return rounded(_scores(spark, d), "c", digits=3)


@query(f"{V.with_views('cells', 'expr', 'lr')}, {EDGES}, {PAIRS}\nSELECT p.cell_type AS ct1, q.cell_type AS ct2, g1, g2, round(sum(x.value * w * y.value), 3) AS c FROM edges JOIN expr x ON i = x.cell_id JOIN pairs ON x.gene = g1 JOIN expr y ON j = y.cell_id AND y.gene = g2 JOIN cells p ON i = p.cell_id JOIN cells q ON j = q.cell_id GROUP BY 1, 2, 3, 4")
def a11_typed_scores(spark, d):
    return rounded(C.near_typed_scores(V.cells(spark, d), V.expr(spark, d), pairs(spark, d), RADIUS), "c", digits=3)


@query(f"{_AGN}, {_MOMENTS}\nSELECT gene, round(eg2, 2) AS eg2 FROM moments")
def a13_second_moment(spark, d):
    e = V.expr(spark, d)
    return rounded(C.second_moment(None, e, C.near_sums(V.cells(spark, d), e, RADIUS)), "eg2", digits=2)


def _z(spark, d, centre=False):
    c, e, p = V.cells(spark, d), cut(V.expr(spark, d)), pairs(spark, d)  # read three times
    scores = cut(C.near_pair_scores(c, e, p, RADIUS))
    if centre:
        mean = scores.agg(F.avg("c")).first()[0] or 0.0
        scores = scores.withColumn("c", F.col("c") - mean)
    moments = C.second_moment(None, e, C.near_sums(c, e, RADIUS, p))
    return C.z_scores(scores, C.pair_moments(p, cut(moments), C.near_squared_weights(c, RADIUS)))


@query(f"{_AGN}, {_SCORES}, {_MOMENTS}, {_OFF}, {_SIDES.format(scores='off')}\nSELECT g1, g2, round(c / {_ROOT}, 5) AS z FROM zz")
def a14_z_scores(spark, d):
    return rounded(_z(spark, d, centre=True).select("g1", "g2", "z"), "z", digits=5)


_METABS = "members AS (SELECT 'm' || CAST(ord % 4 AS VARCHAR) AS metabolite, ligand AS g1, receptor AS g2 FROM lr)"


@query(f"{_AGN}, {_SCORES}, {_MOMENTS}, {_SIDES.format(scores='scores')}, {_METABS}, m AS (SELECT metabolite, sum(c) AS c, sum(eg2) AS eg2 FROM members JOIN zz USING (g1, g2) GROUP BY 1)\nSELECT metabolite, round(c, 2) AS c, round(c / {_ROOT}, 5) AS z FROM m")
def a14_metabolite_z(spark, d):
    members = V.lr(spark, d).select(F.concat(F.lit("m"), (F.col("ord") % 4).cast("string")).alias("metabolite"), F.col("ligand").alias("g1"), F.col("receptor").alias("g2"))
    return rounded(rounded(C.metabolite_z(_z(spark, d), members), "c", digits=2), "z", digits=5)


_TYPED = "t AS (SELECT i, j, w, p.cell_type AS ct1, q.cell_type AS ct2 FROM edges JOIN cells p ON i = p.cell_id JOIN cells q ON j = q.cell_id)"


@query(f"{V.with_views('cells', 'expr', 'lr')}, {EDGES}, {PAIRS}, {_TYPED}, a AS (SELECT ct1, ct2, sum(w * w) AS w2 FROM t GROUP BY 1, 2), c AS (SELECT ct1, ct2, gene, sum(w * w * value * value) AS e FROM t JOIN expr ON j = expr.cell_id GROUP BY 1, 2, 3), g AS (SELECT ct1, ct2, g1, g2, sum(w * w * x.value * x.value * y.value * y.value) AS e FROM t JOIN expr x ON i = x.cell_id JOIN pairs ON x.gene = g1 JOIN expr y ON j = y.cell_id AND y.gene = g2 GROUP BY 1, 2, 3, 4)\nSELECT 'all' AS fix, ct1, ct2, g1, g2, round(w2, 4) AS eg2 FROM a CROSS JOIN pairs UNION ALL SELECT 'ct', ct1, ct2, g1, g2, round(e, 1) FROM c JOIN pairs ON gene = g1 UNION ALL SELECT 'gp', ct1, ct2, g1, g2, round(e, -3) FROM g")
def a13_typed_moments(spark, d):
    args = V.cells(spark, d), V.expr(spark, d), pairs(spark, d), RADIUS
    out = None
    for fix, digits in ((None, 4), ("ct", 1), ("gp", -3)):
        one = C.near_typed_moments(*args, fix).select(F.lit(fix or "all").alias("fix"), "ct1", "ct2", "g1", "g2", F.round("eg2", digits).alias("eg2"))
        out = one if out is None else out.union(one)
    return out


@query(f"{V.with_views('cells')}, {EDGES}, folded AS (SELECT least(i, j) AS i, greatest(i, j) AS j, sum(w) AS w FROM edges GROUP BY 1, 2)\nSELECT node, round(sum(w), 6) AS degree FROM (SELECT i AS node, w FROM folded UNION ALL SELECT j, w FROM folded) x GROUP BY 1")
def a16_degrees(spark, d):
    return rounded(C.near_degrees(V.cells(spark, d), RADIUS), "degree")


@query(f"{V.with_views('betas', 'cells')}\nSELECT target, modulator, cell_type, round(avg(beta), 9) + 0.0e0 AS mean, round(stddev_samp(beta), 7) AS std, count(*) AS n FROM betas JOIN cells USING (cell_id) GROUP BY 1, 2, 3")
def a5_beta_stats(spark, d):
    b = V.betas(spark, d).join(V.cells(spark, d).select("cell_id", "cell_type"), "cell_id")
    # a mean of tenths has few digits, which none of its roundings falls between; adding 0 makes -0 plain 0
    out = rounded(rounded(T.beta_stats(b, ["target", "modulator", "cell_type"]), "mean", digits=9), "std", digits=7)
    return out.withColumn("mean", F.col("mean") + 0.0)


@query(f"{V.with_views('betas')}\nSELECT modulator, round(avg(beta), 6) AS mean, min(beta) AS least, max(beta) AS most, round(sum(beta), 3) AS total, round(avg(greatest(beta, 0)), 6) AS positive, round(avg(least(beta, 0)), 6) AS negative FROM betas WHERE abs(beta) > 0 GROUP BY 1")
def a6_interaction_summary(spark, d):
    return rounded(rounded(T.interaction_summary(V.betas(spark, d), ["modulator"]), "mean", "positive", "negative"), "total", digits=3)


@query(f"{V.with_views('expr')}, lim AS (SELECT gene, min(value) AS lo, max(value) AS hi FROM expr GROUP BY 1), k AS (SELECT gene, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 10), 9) END AS BIGINT) AS bin, count(*) AS n FROM expr JOIN lim USING (gene) GROUP BY 1, 2)\nSELECT lim.gene AS gene, lo, hi, b AS bin, coalesce(n, 0) AS n FROM lim CROSS JOIN range(10) t(b) LEFT JOIN k ON k.gene = lim.gene AND k.bin = b")
def a7_histogram(spark, d):
    return T.histogram(V.expr(spark, d), "value", "gene", 10)


@query(f"{V.with_views('expr', 'cells')}, size AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1), m AS (SELECT gene, cell_type, sum(value) AS s FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2)\nSELECT gene, round(max(s / n), 6) AS top_mean FROM m JOIN size USING (cell_type) GROUP BY 1 HAVING max(s / n) > 10")
def f4_receptor_filter(spark, d):
    return rounded(T.receptor_filter(V.expr(spark, d), V.cells(spark, d), 10.0), "top_mean")


@query(f"{V.with_views('expr', 'cells')}\nSELECT gene, count(*) AS n_cells FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) >= 0.2 * (SELECT count(*) FROM cells)")
def f7_frequent_genes(spark, d):
    return T.frequent_genes(V.expr(spark, d), V.cells(spark, d).count(), 0.2)


@query(f"{V.with_views('expr')}\nSELECT cell_id, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1000000), 6) AS value FROM expr")
def a26_log_cpm(spark, d):
    return rounded(T.log_cpm(V.expr(spark, d)), "value")


@query(f"{V.with_views('expr')}\nSELECT cell_id, sum(value) AS total, count(*) FILTER (value > 0) AS n_genes FROM expr GROUP BY 1")
def a29_count_covariates(spark, d):
    return T.count_covariates(V.expr(spark, d))


@query(f"{V.with_views('links')}\nSELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(coef_mean) DESC, source, target) AS rank FROM links WHERE p <= 0.5) x WHERE rank <= 200")
def f11_filter_links(spark, d):
    return T.filter_links(V.links(spark, d), 0.5, 200).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT c_custkey AS cell_id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS cell_type_int FROM customer")
def f20_encode_labels(spark, d):
    return T.encode_labels(V.cells(spark, d).select("cell_id", "cell_type"), "cell_type", "cell_type_int").drop("cell_type")


@query("SELECT modulator, CASE WHEN contains(modulator, '@') THEN 'metab' WHEN contains(modulator, '$') THEN 'lr' WHEN contains(modulator, '#') THEN 'ltf' ELSE 'tf' END AS grp, n FROM (" + V.with_views("betas") + " SELECT modulator, count(*) AS n FROM betas GROUP BY 1) x")
def f1_modulator_groups(spark, d):
    return V.betas(spark, d).groupBy("modulator").agg(F.count("*").alias("n")).select("modulator", S.modulator_group(F.col("modulator")).alias("grp"), "n")


@query(f"{V.with_views('expr')}, lim AS (SELECT gene, min(value) AS lo, max(value) AS hi FROM expr GROUP BY 1)\nSELECT cell_id, gene, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS value FROM expr JOIN lim USING (gene)")
def f18_min_max(spark, d):
    return rounded(T.min_max(V.expr(spark, d), "value", "gene"), "value")


@query(f"{V.with_views('cells')}\nSELECT cell_id, cell_type FROM (SELECT *, count(*) OVER (PARTITION BY cell_type) AS n FROM cells) x WHERE n >= 16")
def f16_drop_tiny(spark, d):
    return T.drop_tiny(V.cells(spark, d), 16).select("cell_id", "cell_type")


@query(f"{V.with_views('links')}, b AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS m, row_number() OVER (PARTITION BY cluster ORDER BY p, source, target) AS r FROM links)\nSELECT cluster, source, target, p, round(least(1, min(p * m / r) OVER (PARTITION BY cluster ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS fdr FROM b")
def a51_benjamini_hochberg(spark, d):
    return rounded(C.benjamini_hochberg(V.links(spark, d), by=["cluster"], tie=["source", "target"]).select("cluster", "source", "target", "p", "fdr"), "fdr", digits=8)


@query(f"{V.with_views('links')}, s AS (SELECT cluster, target, abs(coef_mean) / sum(abs(coef_mean)) OVER (PARTITION BY cluster, target) AS s FROM links WHERE coef_mean <> 0)\nSELECT cluster, target, round(CASE WHEN count(*) > 1 THEN -sum(s * ln(s)) / ln(count(*)) ELSE 0 END, 6) AS entropy, count(*) AS k FROM s GROUP BY 1, 2")
def a44_network_entropy(spark, d):
    return rounded(T.network_entropy(V.links(spark, d)), "entropy")


@query(f"{V.with_views('links')}, e AS (SELECT cluster, source AS gene, 1 AS o, 0 AS i FROM links UNION ALL SELECT cluster, target, 0, 1 FROM links), n AS (SELECT cluster, count(DISTINCT gene) AS nodes FROM e GROUP BY 1)\nSELECT cluster, gene, CAST(sum(o) AS BIGINT) AS degree_out, CAST(sum(i) AS BIGINT) AS degree_in, CAST(count(*) AS BIGINT) AS degree_all, round(count(*) / CAST(greatest(max(nodes) - 1, 1) AS DOUBLE), 6) AS centrality FROM e JOIN n USING (cluster) GROUP BY 1, 2")
def a43_network_degree(spark, d):
    return rounded(T.network_degree(V.links(spark, d)), "centrality")


@query(f"{V.with_views('links')}, w AS (SELECT target AS tf, source AS ligand, avg(coef_mean) AS weight FROM links GROUP BY 1, 2), back AS (SELECT DISTINCT source AS tf, target AS ligand FROM links WHERE p < 0.1)\nSELECT tf, ligand, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY round(weight, 9) DESC, ligand) AS rank FROM w) x WHERE rank <= 5 AND round(weight, 9) > -0.25 AND NOT EXISTS (SELECT 1 FROM back WHERE back.tf = x.tf AND back.ligand = x.ligand)")
def w1_top_sources(spark, d):
    k = V.links(spark, d)
    w = k.groupBy(F.col("target").alias("tf"), F.col("source").alias("ligand")).agg(F.avg("coef_mean").alias("weight"))
    back = k.where("p < 0.1").select(F.col("source").alias("tf"), F.col("target").alias("ligand")).distinct()
    return longs(rounded(X.top_ligands(w, -0.25, 5, back), "weight"), "rank").select("tf", "ligand", "weight", "rank")


@query(f"{V.with_views('cells')}\nSELECT CAST(floor(x / 100) AS BIGINT) AS gx, CAST(floor(y / 100) AS BIGINT) AS gy, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM cells GROUP BY 1, 2")
def a38_grid_means(spark, d):
    return rounded(P.grid_means(V.cells(spark, d), ["x", "y"], 100.0), "x", "y")


def _step(before: str, after: str) -> str:
    return f"m_{after} AS (SELECT cell_id, target AS gene, sum(d * coef) AS d FROM {before} JOIN c ON gene = source GROUP BY 1, 2), {after} AS (SELECT coalesce(m.cell_id, h.cell_id) AS cell_id, coalesce(m.gene, h.gene) AS gene, greatest(coalesce(h.d, m.d), -coalesce(e.value, 0)) AS d FROM m_{after} m FULL JOIN d0 h ON m.cell_id = h.cell_id AND m.gene = h.gene LEFT JOIN expr e ON e.cell_id = coalesce(m.cell_id, h.cell_id) AND e.gene = coalesce(m.gene, h.gene))"


@query(f"{V.with_views('links', 'expr')}, c AS (SELECT source, target, avg(coef_mean) AS coef FROM links GROUP BY 1, 2), d0 AS (SELECT cell_id, gene, -value AS d FROM expr WHERE gene = 'Brand#11'), {_step('d0', 's1')}, {_step('s1', 's2')}\nSELECT cell_id, gene, round(d, 3) + 0.0e0 AS d FROM s2")
def m13_propagation(spark, d):
    coef = V.links(spark, d).groupBy("source", "target").agg(F.avg("coef_mean").alias("coef"))
    e = cut(V.expr(spark, d))
    delta = e.where("gene = 'Brand#11'").select("cell_id", "gene", (-F.col("value")).alias("d"))
    return rounded(M.propagate(delta, coef, e, 2), "d", digits=3).withColumn("d", F.col("d") + 0.0)  # plain 0 for -0


@query(f"{V.with_views('links')}, e AS (SELECT DISTINCT source, target FROM links), h1 AS (SELECT DISTINCT target AS node FROM e WHERE source = 'Brand#11' AND target <> 'Brand#11'), h2 AS (SELECT DISTINCT target AS node FROM e JOIN h1 ON source = node WHERE target <> 'Brand#11' AND target NOT IN (SELECT node FROM h1))\nSELECT 'Brand#11' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def m29_reachable(spark, d):
    e = V.links(spark, d).select("source", "target").distinct()
    return M.reachable(e, spark.range(1).select(F.lit("Brand#11").alias("node")), 2)


@query(f"{V.with_views('betas')}\nSELECT target, modulator, round(avg(beta), 6) AS mean, round(var_pop(beta), 6) AS var, round(quantile_cont(beta, 0.025), 6) AS lo, round(quantile_cont(beta, 0.975), 6) AS hi, round(avg(CASE WHEN beta <> 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS selected, round(least(1, 2 * least(avg(CASE WHEN beta <= 0 THEN 1.0e0 ELSE 0.0e0 END), avg(CASE WHEN beta >= 0 THEN 1.0e0 ELSE 0.0e0 END))), 6) AS p_stability FROM betas GROUP BY 1, 2")
def a53_bootstrap_summary(spark, d):
    return rounded(M.bootstrap_summary(V.betas(spark, d), ["target", "modulator"]), "mean", "var", "lo", "hi", "selected", "p_stability")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x1_windowed_events(spark, d):
    return windowed_counts(V.table(spark, d, "events"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


