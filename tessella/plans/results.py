"""Queries of result tables and networks, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import networks as K
from tessella.operators import results as R
from tessella.plans.registry import query, rounded, uniform
from tessella.sources import views as V

_MEMBERS = "members AS (SELECT 'm' || CAST(ord % 5 AS VARCHAR) AS metabolite, ligand AS g1, receptor AS g2 FROM lr)"
#: Results per pair of genes and of metabolites between types, made from the links.
_PAIRS = "pr AS (SELECT CASE cluster WHEN 'c0' THEN 'other' WHEN 'c1' THEN 'CD4' ELSE 'CD8' END AS ct1, CASE WHEN coef_mean > -0.25 THEN 'CD8' ELSE 'other' END AS ct2, receptor AS g1, ligand AS g2, p AS fdr, -coef_mean AS c, p < 0.3 AS selected FROM links JOIN lr ON (source = ligand AND target = receptor) OR (source = receptor AND target = ligand))"
_TIER = "tr AS (SELECT 'm' || CAST(ord % 5 AS VARCHAR) AS metabolite, CASE cluster WHEN 'c0' THEN 'other' WHEN 'c1' THEN 'CD4' ELSE 'CD8' END AS ct1, CASE WHEN ord % 2 = 0 THEN 'CD8' ELSE 'other' END AS ct2, p + ord / 1000.0e0 AS fdr, p < 0.12 AS selected FROM links JOIN lr ON source = ligand)"


def _members(spark, d):
    return V.lr(spark, d).select(F.concat(F.lit("m"), (F.col("ord") % 5).cast("string")).alias("metabolite"), F.col("ligand").alias("g1"), F.col("receptor").alias("g2"))


def _ct1():
    return F.when(F.col("cluster") == "c0", "other").when(F.col("cluster") == "c1", "CD4").otherwise("CD8")


def _pairs(spark, d):
    lr = V.lr(spark, d)
    both = lr.select("ligand", "receptor", F.col("ligand").alias("source"), F.col("receptor").alias("target")).union(lr.select("ligand", "receptor", "receptor", "ligand"))
    j = V.links(spark, d).join(both, ["source", "target"])
    return j.select(_ct1().alias("ct1"), F.when(F.col("coef_mean") > -0.25, "CD8").otherwise("other").alias("ct2"), F.col("receptor").alias("g1"), F.col("ligand").alias("g2"), F.col("p").alias("fdr"), (-F.col("coef_mean")).alias("c"), (F.col("p") < 0.3).alias("selected"))


def _tier(spark, d):
    j = V.links(spark, d).join(V.lr(spark, d), F.col("source") == F.col("ligand"))
    return j.select(F.concat(F.lit("m"), (F.col("ord") % 5).cast("string")).alias("metabolite"), _ct1().alias("ct1"), F.when(F.col("ord") % 2 == 0, "CD8").otherwise("other").alias("ct2"), (F.col("p") + F.col("ord") / 1000).alias("fdr"), (F.col("p") < 0.12).alias("selected"))


@query(f"{V.with_views('links', 'lr')}, {_MEMBERS}, {_PAIRS}\nSELECT metabolite, count(*) AS n FROM pr JOIN (SELECT DISTINCT metabolite, least(g1, g2) AS a, greatest(g1, g2) AS b FROM members) m ON a = least(pr.g1, pr.g2) AND b = greatest(pr.g1, pr.g2) WHERE selected GROUP BY 1")
def a25_significant_pairs(spark, d):
    return R.significant_pair_counts(_pairs(spark, d).where("selected"), _members(spark, d))


_LABEL = "CASE WHEN ct1 = ct2 THEN ct1 || ' (self)' ELSE least(ct1, ct2) || '--' || greatest(ct1, ct2) END || ' (' || printf('%.1e', fdr) || ')'"
_SUMMARY = f"ts AS (SELECT metabolite, {_LABEL} AS label, fdr, ct1 <> 'other' OR ct2 <> 'other' AS t, ct1 = ct2 AND ct1 <> 'other' AS within, ct1 <> ct2 AND (ct1 <> 'other' OR ct2 <> 'other') AS face FROM tr WHERE selected), sm AS (SELECT metabolite, count(*) AS n_sig_pairs, string_agg(label, '; ' ORDER BY NOT t, fdr, label) AS interactions, coalesce(string_agg(label, '; ' ORDER BY fdr, label) FILTER (within), '') AS within_tcell, coalesce(string_agg(label, '; ' ORDER BY fdr, label) FILTER (face), '') AS tcell_interfaces, bool_or(t) AS tcell_involved FROM ts GROUP BY 1)"


@query(f"{V.with_views('links', 'lr')}, {_TIER}, {_SUMMARY}\nSELECT * FROM sm")
def a24_tier_summary(spark, d):
    return R.tier_summary(_tier(spark, d))


@query(f"{V.with_views('links', 'lr')}, {_MEMBERS}, {_PAIRS}, {_TIER}, {_SUMMARY}, base AS (SELECT metabolite, count(*) AS n, string_agg(DISTINCT g, ', ' ORDER BY g) AS genes FROM (SELECT metabolite, g1, g2, unnest([g1, g2]) AS g FROM members) q GROUP BY 1), cnt AS (SELECT metabolite, count(*) AS n FROM members GROUP BY 1), own AS (SELECT metabolite, min(fdr) AS fdr, min(fdr) < 0.01 AS sel FROM tr WHERE metabolite <> 'm3' GROUP BY 1), sp AS (SELECT metabolite, count(*) AS n FROM pr JOIN (SELECT DISTINCT metabolite, least(g1, g2) AS a, greatest(g1, g2) AS b FROM members) m ON a = least(pr.g1, pr.g2) AND b = greatest(pr.g1, pr.g2) WHERE selected GROUP BY 1)\nSELECT metabolite, cnt.n AS n_gene_pairs, genes AS transporter_genes, coalesce(sel, false) AS global_significant, round(fdr, 6) AS global_fdr, coalesce(sp.n, 0) AS n_sig_gene_pairs_global, coalesce(n_sig_pairs, 0) AS t1_n_sig_pairs, coalesce(interactions, '') AS t1_interactions, coalesce(tcell_involved, false) AS t1_tcell_involved FROM base JOIN cnt USING (metabolite) LEFT JOIN own USING (metabolite) LEFT JOIN sp USING (metabolite) LEFT JOIN sm USING (metabolite)")
def a24_master_table(spark, d):
    t = _tier(spark, d)
    own = t.where("metabolite <> 'm3'").groupBy("metabolite").agg(F.min("fdr").alias("fdr"), (F.min("fdr") < 0.01).alias("selected"))
    m = R.master_table(_members(spark, d), own, _pairs(spark, d).where("selected"), {"t1": t})
    cols = ["metabolite", "n_gene_pairs", "transporter_genes", "global_significant", "global_fdr", "n_sig_gene_pairs_global", "t1_n_sig_pairs", "t1_interactions", "t1_tcell_involved"]
    return rounded(m.select(*cols), "global_fdr")


@query(f"{V.with_views('links', 'lr')}, {_MEMBERS}, {_PAIRS}\nSELECT 't1' AS tier, ct1, ct2, pr.g1 AS g1, pr.g2 AS g2, round(fdr, 6) AS fdr, round(c, 6) AS c, coalesce(ms, '') AS metabolites, CASE WHEN ct1 = ct2 THEN CASE WHEN ct1 <> 'other' THEN 'within_Tcell' ELSE 'within_other' END WHEN ct1 <> 'other' OR ct2 <> 'other' THEN 'Tcell_interface' ELSE 'non_Tcell_interface' END AS involvement FROM pr LEFT JOIN (SELECT least(g1, g2) AS a, greatest(g1, g2) AS b, string_agg(DISTINCT metabolite, ' | ' ORDER BY metabolite) AS ms FROM members GROUP BY 1, 2) m ON a = least(pr.g1, pr.g2) AND b = greatest(pr.g1, pr.g2) WHERE selected")
def a24_pair_table(spark, d):
    return rounded(R.pair_table({"t1": _pairs(spark, d)}, _members(spark, d)), "fdr", "c")


@query(f"{V.with_views('links', 'cells')}, v AS (SELECT source AS ligand, target AS receptor, CASE cluster WHEN 'c0' THEN 'BUILDING' WHEN 'c1' THEN 'MACHINERY' ELSE 'FURNITURE' END AS ct1, 'BUILDING' AS ct2, p AS value, p FROM links), s AS (SELECT ct1 AS cell_type, ligand AS gene, value FROM v WHERE p < 0.3 UNION ALL SELECT ct2, receptor, value FROM v WHERE p < 0.3), lv AS (SELECT ligand, receptor FROM v WHERE p < 0.3 GROUP BY 1, 2 HAVING sum(value) > 0), s2 AS (SELECT ct1 AS cell_type, ligand AS gene, value FROM v JOIN lv USING (ligand, receptor) WHERE p < 0.3 UNION ALL SELECT ct2, receptor, value FROM v JOIN lv USING (ligand, receptor) WHERE p < 0.3), t AS (SELECT cell_type, gene, sum(value) AS value FROM s2 GROUP BY 1, 2)\nSELECT cell_id, gene, round(value, 6) AS value FROM cells JOIN t USING (cell_type)")
def m40_cluster_thresholds(spark, d):
    ct1 = F.when(F.col("cluster") == "c0", "BUILDING").when(F.col("cluster") == "c1", "MACHINERY").otherwise("FURNITURE")
    v = V.links(spark, d).select(F.col("source").alias("ligand"), F.col("target").alias("receptor"), ct1.alias("ct1"), F.lit("BUILDING").alias("ct2"), F.col("p").alias("value"), "p")
    return rounded(R.cluster_thresholds(v, V.cells(spark, d)), "value")


@query(f"{V.with_views('lr')}, {_MEMBERS}, tr AS (SELECT rep, t, metabolite, g1, g2 FROM members CROSS JOIN range(4) r(rep) CROSS JOIN range(64) s(t) WHERE {uniform('7', 'rep', 't', 'metabolite', 'g1', 'g2')} < 0.03), f AS (SELECT rep, min(t) AS t FROM tr GROUP BY 1)\nSELECT CAST(tr.rep AS INTEGER) AS rep, metabolite, g1, g2 FROM tr JOIN f ON f.rep = tr.rep AND f.t = tr.t")
def m38_subsampled_pairs(spark, d):
    return R.subsampled_pairs(_members(spark, d), 4, 0.03, 7)


@query(f"{V.with_views('lr')}, {_MEMBERS}\nSELECT metabolite || '-' || g1 || '_' || g2 AS metabolite, g1, g2 FROM members")
def m38_pair_names(spark, d):
    return R.pair_names(_members(spark, d))


_SPECS = [(label, value) for label, _, value, _ in R.type_specs(["BUILDING", "MACHINERY"], "cell_type", [None])]
_RUNS = "runs AS (SELECT ligand AS target, label, penalty FROM lr CROSS JOIN (VALUES " + ", ".join(f"('{label}')" for label, _ in _SPECS) + ") s(label) CROSS JOIN (VALUES (0.5e0), (5.0e0)) p(penalty))"


@query(f"{V.with_views('lr')}, {_RUNS}\nSELECT r.target AS target, label, penalty FROM runs r WHERE NOT (label = 'all_pooled' AND penalty < 1 AND target < 'Brand#2')")
def m39_run_grid(spark, d):
    specs = spark.createDataFrame([(label,) for label, _ in _SPECS], "label string")
    targets = V.lr(spark, d).select(F.col("ligand").alias("target"))
    done = targets.where("target < 'Brand#2'").select("target", F.lit("all_pooled").alias("label"), F.lit(0.5).alias("penalty"))
    return R.run_grid(targets, specs, [0.5, 5.0], done)


@query(f"{V.with_views('links')}, e AS (SELECT cluster, source AS gene FROM links UNION ALL SELECT cluster, target FROM links), g AS (SELECT cluster, gene, count(*) AS degree FROM e GROUP BY 1, 2)\nSELECT cluster, CAST(degree AS BIGINT) AS degree, count(*) AS nodes FROM g GROUP BY 1, 2")
def a45_node_degrees(spark, d):
    return K.node_degrees(V.links(spark, d)).withColumn("degree", F.col("degree").cast("long"))


@query()
def a43_network_scores(spark, d):
    return K.network_scores(V.links(spark, d))
