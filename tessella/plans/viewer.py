"""Queries of what the viewer shows, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import results as R
from tessella.plans.registry import longs, query, rounded
from tessella.sources import views as V


@query(f"{V.with_views('links')}, b AS (SELECT source AS entity, cluster AS ct1, target AS ct2, p AS fdr, -coef_mean AS c FROM links WHERE p < 0.2 AND -coef_mean > 0)\nSELECT entity, count(*) AS n, round(max(c), 6) AS strongest, arg_max(ct2, ROW(abs(c), ct1, ct2)) AS target FROM b GROUP BY 1")
def m48_edge_bundle(spark, d):
    k = V.links(spark, d).select(F.col("source").alias("entity"), F.col("cluster").alias("ct1"), F.col("target").alias("ct2"), F.col("p").alias("fdr"), (-F.col("coef_mean")).alias("c"))
    b = R.edge_bundle(k, 0.2)
    return rounded(longs(b.select("entity", F.size("edges").alias("n"), F.col("edges")[0]["c"].alias("strongest"), F.col("edges")[0]["target"].alias("target")), "n"), "strongest")


@query(f"{V.with_views('links')}, r AS (SELECT source AS id, min(p) < 0.004 AS gs, count(*) FILTER (p < 0.01) AS ng, count(*) FILTER (cluster = 'c0' AND p < 0.03) AS n0, bool_or(cluster = 'c0' AND p < 0.01) AS t0, count(*) FILTER (cluster = 'c1' AND p < 0.03) AS n1, bool_or(cluster = 'c1' AND p < 0.01) AS t1 FROM links GROUP BY 1), s AS (SELECT id, CASE WHEN t0 THEN 1000000 ELSE 0 END + n0 * 1000 + CASE WHEN gs THEN 100 ELSE 0 END + ng AS score, NOT (gs OR ng > 0 OR n0 > 0 OR t0 OR n1 > 0 OR t1) AS eliminated, t0 AS involved FROM r)\nSELECT id, CAST(score AS BIGINT) AS score, eliminated, involved, row_number() OVER (ORDER BY eliminated, score DESC, id) AS rank FROM s")
def w7_ranked_metabolites(spark, d):
    tier = lambda c: F.struct(F.bool_or((F.col("cluster") == c) & (F.col("p") < 0.01)).alias("tcell_involved"), F.count_if((F.col("cluster") == c) & (F.col("p") < 0.03)).alias("n_sig_pairs"))
    e = V.links(spark, d).groupBy(F.col("source").alias("id")).agg((F.min("p") < 0.004).alias("global_significant"), F.count_if(F.col("p") < 0.01).alias("n_sig_gene_pairs_global"), tier("c0").alias("_a"), tier("c1").alias("_b"))
    e = e.withColumn("tiers", F.create_map(F.lit("c0"), F.col("_a"), F.lit("c1"), F.col("_b")))
    return longs(R.ranked_metabolites(e, "c0"), "score", "rank")


@query(f"{V.with_views('links')}, pr AS (SELECT least(source, target) || '__' || greatest(source, target) AS id, count(DISTINCT cluster) AS nm FROM links GROUP BY 1), r AS (SELECT least(source, target) || '__' || greatest(source, target) AS id, count(*) AS n FROM links WHERE p < 0.1 AND -coef_mean > 0 GROUP BY 1)\nSELECT id, nm AS n_metabolites, coalesce(n, 0) AS n_sig, coalesce(n, 0) = 0 AS eliminated, row_number() OVER (ORDER BY coalesce(n, 0) = 0, coalesce(n, 0) DESC, nm DESC, id) AS rank FROM pr LEFT JOIN r USING (id)")
def w7_ranked_pairs(spark, d):
    k = V.links(spark, d)
    pairs = k.groupBy(R.pair_key("source", "target").alias("id")).agg(F.countDistinct("cluster").alias("n_metabolites"))
    res = k.select(F.concat("target", F.lit("__"), "source").alias("id"), F.col("p").alias("fdr"), (-F.col("coef_mean")).alias("c"))
    return longs(R.ranked_pairs(pairs, res, 0.1).select("id", "n_metabolites", "n_sig", "eliminated", "rank"), "rank")


@query(f"{V.with_views('links')}, t AS (SELECT max(abs(coef_mean)) AS t FROM links)\nSELECT cluster, source, target, round(CASE WHEN abs(coef_mean) <= t / 10000 THEN 0 ELSE least(1, greatest(0, (log10(abs(coef_mean)) - log10(t / 10000)) / 4)) END, 6) AS scaled FROM links CROSS JOIN t")
def f25_beta_scale(spark, d):
    return rounded(R.beta_scale(V.links(spark, d), "coef_mean").select("cluster", "source", "target", "scaled"), "scaled")


@query(f"{V.with_views('links')}, v AS (SELECT cluster, source, target, greatest(-coef_mean * 10, 0) AS v FROM links), l AS (SELECT ln(1 + min(v)) AS a, ln(1 + max(v)) AS b FROM v)\nSELECT cluster, source, target, round(2 + 13 * CASE WHEN b > a THEN least(1, greatest(0, (ln(1 + v) - a) / (b - a))) ELSE 1 END, 6) AS width FROM v CROSS JOIN l")
def f26_edge_widths(spark, d):
    e = V.links(spark, d).withColumn("s", -F.col("coef_mean") * 10)
    return rounded(R.edge_widths(e, "s").select("cluster", "source", "target", "width"), "width")


_ROWS = "rw AS (SELECT cluster AS cell_type, source AS a, CASE WHEN source < target THEN target END AS b, target AS gene, avg(coef_mean) AS mean, max(length(source)) AS n FROM links GROUP BY 1, 2, 3, 4), f AS (SELECT cell_type, a || '__' || coalesce(b, '') AS feature, gene, mean, n FROM rw)"


def _rows(spark, d):
    k = V.links(spark, d)
    return k.groupBy(F.col("cluster").alias("cell_type"), F.col("source").alias("a"), F.when(F.col("source") < F.col("target"), F.col("target")).alias("b"), F.col("target").alias("gene")).agg(F.avg("coef_mean").alias("mean"), F.max(F.length("source")).alias("n"))


@query(f"{V.with_views('links')}, {_ROWS}, g AS (SELECT cell_type, feature, max(n) AS n, max(abs(mean)) AS peak, count(*) AS genes FROM f GROUP BY 1, 2)\nSELECT cell_type, feature, CAST(n AS BIGINT) AS n, round(peak, 6) AS peak, genes, row_number() OVER (PARTITION BY cell_type ORDER BY round(peak, 9) DESC, feature) AS place FROM g")
def m50_beta_blocks(spark, d):
    rows = _rows(spark, d).withColumn("mean", F.round("mean", 9))
    b = R.beta_blocks(rows).select("cell_type", "feature", "n", "peak", F.size("means").alias("genes"), "place")
    return rounded(longs(b, "n", "genes", "place"), "peak")


@query(f"{V.with_views('links')}, {_ROWS}\nSELECT cell_type, feature, gene, round(mean, 6) AS mean FROM f WHERE feature IN ('Brand#3__', 'Brand#1__Brand#2', 'Brand#11__Brand#12')")
def m50_selected_rows(spark, d):
    s = R.selected_rows(_rows(spark, d), ["Brand#3__", "Brand#1__Brand#2", "Brand#11__Brand#12"])
    return rounded(s.select("cell_type", F.concat("a", F.lit("__"), F.coalesce("b", F.lit(""))).alias("feature"), "gene", "mean"), "mean")
