"""Queries of link tables, factors and perturbation, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.operators import factors as X
from tessella.operators import spatial as P
from tessella.plans.registry import KERNEL, NEAR, RADIUS, query, rounded
from tessella.sources import views as V

_ROLES = "roles AS (SELECT DISTINCT 'm' || CAST(p_size % 5 AS VARCHAR) AS metabolite, p_brand AS gene, CAST(p_partkey % 3 - 1 AS INTEGER) AS role FROM part)"
_PRESENT = "present AS (SELECT DISTINCT cell_type, gene FROM expr JOIN cells USING (cell_id) WHERE value > 60)"
#: Gene names of the tables hold the character that joins ligand and regulator; factors are named without it.
_PLAIN = "pe AS (SELECT cell_id, replace(gene, '#', '') AS gene, value FROM expr), plr AS (SELECT replace(ligand, '#', '') AS ligand, replace(receptor, '#', '') AS receptor FROM lr)"
_FACTORS = "fb AS (SELECT e.cell_id AS cell_id, l.receptor AS target, CASE e.cell_id % 3 WHEN 0 THEN ligand WHEN 1 THEN ligand || '$' || receptor ELSE ligand || '#' || receptor END AS modulator, e.cell_id % 3 AS kind, ligand AS l, value / 100.0e0 - 0.2e0 AS beta FROM pe e JOIN plr l ON e.gene = l.ligand)"


def _plain(c):
    return F.replace(F.col(c), F.lit("#"), F.lit(""))


def _plain_expr(spark, d):
    return V.expr(spark, d).withColumn("gene", _plain("gene"))


def _factor_betas(spark, d, expr=None):
    lr = V.lr(spark, d).select(_plain("ligand").alias("ligand"), _plain("receptor").alias("receptor"))
    j = (expr or _plain_expr(spark, d)).join(lr, F.col("gene") == F.col("ligand"))
    k = F.col("cell_id") % 3
    name = F.when(k == 0, F.col("ligand")).when(k == 1, F.concat("ligand", F.lit("$"), "receptor")).otherwise(F.concat("ligand", F.lit("#"), "receptor"))
    return j.select("cell_id", F.col("receptor").alias("target"), name.alias("modulator"), (F.col("value") / 100 - 0.2).alias("beta"))


@query(f"{V.with_views('lr', 'expr')}, g AS (SELECT DISTINCT gene FROM expr WHERE value > 70)\nSELECT t.ligand AS target, p.ligand AS ligand, p.receptor AS receptor FROM lr p JOIN lr t ON p.ligand <> t.ligand AND p.receptor <> t.ligand WHERE p.ligand IN (SELECT gene FROM g) AND p.receptor IN (SELECT gene FROM g)")
def f5_pairs_without_target(spark, d):
    lr = V.lr(spark, d)
    return X.known_pairs(lr.select("ligand", "receptor"), V.expr(spark, d).where("value > 70"), lr.select(F.col("ligand").alias("target"))).select("target", "ligand", "receptor")


@query(f"{V.with_views('links', 'lr')}\nSELECT DISTINCT target, source FROM links WHERE p < 0.3 AND source <> target AND source IN (SELECT ligand FROM lr)")
def m30_regulators(spark, d):
    return X.regulators(V.links(spark, d), V.lr(spark, d).select(F.col("ligand").alias("gene")), 0.3)


@query(f"{V.with_views('links', 'expr')}, b AS (SELECT 'Brand#' || CAST(cell_id % 50 AS VARCHAR) AS target, cell_id, replace(gene, '#', '') AS modulator, value AS beta FROM expr), h AS (SELECT DISTINCT cluster, target, replace(source, '#', '') AS source FROM links WHERE p < 0.5)\nSELECT b.target AS target, cell_id, modulator, CAST(CASE WHEN h.source IS NOT NULL THEN beta ELSE 0 END AS DOUBLE) AS beta FROM b LEFT JOIN h ON h.cluster = 'c' || CAST(cell_id % 3 AS VARCHAR) AND h.target = b.target AND h.source = modulator")
def f22_masked_betas(spark, d):
    b = V.expr(spark, d).select(F.concat(F.lit("Brand#"), (F.col("cell_id") % 50).cast("string")).alias("target"), "cell_id", _plain("gene").alias("modulator"), F.col("value").alias("beta"))
    c = V.cells(spark, d).select("cell_id", F.concat(F.lit("c"), (F.col("cell_id") % 3).cast("string")).alias("cluster"))
    return X.mask_by_links(b, V.links(spark, d).withColumn("source", _plain("source")), c, 0.5)


@query(f"{V.with_views('links')}, t AS (SELECT DISTINCT source AS peak, cluster AS gene FROM links), k AS (SELECT source AS peak1, target AS peak2, coef_mean AS coaccess FROM links), u AS (SELECT peak2 AS peak, gene, coaccess FROM k JOIN t ON peak = peak1 UNION ALL SELECT peak, gene, 1.0e0 FROM t)\nSELECT peak, gene, max(coaccess) AS coaccess FROM u GROUP BY 1, 2 HAVING max(coaccess) > 0")
def j9_best_coaccess(spark, d):
    k = V.links(spark, d)
    return X.best_coaccess(k.select(F.col("source").alias("peak1"), F.col("target").alias("peak2"), F.col("coef_mean").alias("coaccess")), k.select(F.col("source").alias("peak"), F.col("cluster").alias("gene")).distinct())


@query(f"{V.with_views('links')}\nSELECT least(source, target) AS g1, greatest(source, target) AS g2, string_agg(DISTINCT cluster, '|' ORDER BY cluster) AS metabolites, count(DISTINCT cluster) AS n FROM links GROUP BY 1, 2")
def j17_pair_members(spark, d):
    return X.pair_members(V.links(spark, d).select(F.col("cluster").alias("metabolite"), F.col("source").alias("g1"), F.col("target").alias("g2")))


@query(f"{V.with_views('cells', 'expr', 'lr')}, {_PRESENT}\nSELECT a.cell_type AS ct1, b.cell_type AS ct2, ligand AS g1, receptor AS g2 FROM lr JOIN present a ON a.gene = ligand JOIN present b ON b.gene = receptor")
def j11_typed_pairs(spark, d):
    present = V.expr(spark, d).where("value > 60").join(V.cells(spark, d).select("cell_id", "cell_type"), "cell_id").select("cell_type", "gene").distinct()
    return X.typed_pairs(V.lr(spark, d).select(F.col("ligand").alias("g1"), F.col("receptor").alias("g2")), present)


@query(f"WITH {_ROLES}\nSELECT DISTINCT a.metabolite AS metabolite, a.gene AS g1, b.gene AS g2 FROM roles a JOIN roles b ON a.metabolite = b.metabolite AND a.gene <= b.gene WHERE NOT (a.role = b.role AND a.role <> 0)")
def m47_transporter_pairs(spark, d):
    p = V.table(spark, d, "part")
    roles = p.select(F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("metabolite"), F.col("p_brand").alias("gene"), (F.col("p_partkey") % 3 - 1).cast("int").alias("role")).distinct()
    return X.transporter_pairs(roles)


@query(f"WITH {_ROLES}\nSELECT DISTINCT a.metabolite AS metabolite, a.gene AS g1, b.gene AS g2 FROM roles a JOIN roles b ON a.metabolite = b.metabolite WHERE NOT (a.role = b.role AND a.role <> 0)")
def m47_ordered_pairs(spark, d):
    p = V.table(spark, d, "part")
    return X.transporter_pairs(p.select(F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("metabolite"), F.col("p_brand").alias("gene"), (F.col("p_partkey") % 3 - 1).cast("int").alias("role")).distinct(), ordered=True)


@query(f"{V.with_views('lr')}\nSELECT 'lr' || CAST(ord AS VARCHAR) AS metabolite, ligand AS g1, receptor AS g2 FROM lr UNION SELECT 'lr' || CAST(ord AS VARCHAR), receptor, ligand FROM lr")
def m47_receptor_pairs(spark, d):
    return X.receptor_pairs(V.lr(spark, d).select(F.concat(F.lit("lr"), F.col("ord").cast("string")).alias("name"), "ligand", "receptor"), ordered=True)


@query(f"{V.with_views('links', 'lr')}\nSELECT DISTINCT source, target FROM links WHERE p < 0.3 AND target IN (SELECT ligand FROM lr)")
def m30_targets(spark, d):
    return X.targets_of(V.links(spark, d), V.lr(spark, d).select(F.col("ligand").alias("gene")), 0.3)


@query(f"{V.with_views('links', 'lr')}\nSELECT target, source AS tf FROM links WHERE source IN (SELECT ligand FROM lr) AND target IN (SELECT ligand FROM lr) AND source <> target GROUP BY 1, 2 HAVING max(CASE WHEN p < 0.2 THEN 1 ELSE 0 END) > 0")
def m31_base_regulators(spark, d):
    grn = V.links(spark, d).select("target", F.col("source").alias("tf"), (F.col("p") < 0.2).cast("int").alias("flag"))
    return X.base_regulators(grn, V.lr(spark, d).select(F.col("ligand").alias("gene")))


_MOTIFS = "hits AS (SELECT DISTINCT target AS peak, cluster AS motif FROM links WHERE p < 0.1), motifs AS (SELECT DISTINCT cluster AS motif, source AS tf FROM links WHERE p < 0.05)"


@query(f"{V.with_views('links')}, {_MOTIFS}\nSELECT DISTINCT peak, tf FROM hits JOIN motifs USING (motif)")
def m44_motif_table(spark, d):
    k = V.links(spark, d)
    motifs = k.where("p < 0.05").groupBy(F.col("cluster").alias("motif")).agg(F.collect_set("source").alias("tfs"))
    return X.motif_table(k.where("p < 0.1").select(F.col("target").alias("peak"), F.col("cluster").alias("motif")), motifs)


@query(f"{V.with_views('links')}, {_MOTIFS}, tss AS (SELECT DISTINCT target AS peak, source AS gene FROM links WHERE p < 0.02)\nSELECT gene AS target, string_agg(DISTINCT tf, '|' ORDER BY tf) AS tfs FROM hits JOIN motifs USING (motif) JOIN tss USING (peak) GROUP BY 1")
def m44_peak_targets(spark, d):
    tss = V.links(spark, d).where("p < 0.02").select(F.col("target").alias("peak"), F.col("source").alias("gene")).distinct()
    return X.peak_targets(m44_motif_table(spark, d), tss).withColumn("tfs", F.array_join("tfs", "|"))


@query(f"{V.with_views('links')}\nSELECT target AS peak, source AS motif, round(sum(coef_mean), 6) AS score FROM links GROUP BY 1, 2 HAVING sum(coef_mean) >= -0.25")
def f12_motif_hits(spark, d):
    return rounded(X.motif_hits(V.links(spark, d).select(F.col("target").alias("peak"), F.col("source").alias("motif"), F.col("coef_mean").alias("score")), -0.25, summed=True), "score")


@query(f"{V.with_views('links')}, w AS (SELECT target AS tf, source AS ligand, avg(coef_mean) AS weight FROM links GROUP BY 1, 2)\nSELECT tf, ligand, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY round(weight, 9) DESC, ligand) AS rank FROM w WHERE round(weight, 9) > -0.28 AND ligand <> tf) q WHERE rank <= 5")
def w2_back_filled(spark, d):
    w = V.links(spark, d).groupBy(F.col("target").alias("tf"), F.col("source").alias("ligand")).agg(F.avg("coef_mean").alias("weight"))
    return rounded(X.top_then_back_fill(w, -0.28, 5, F.col("ligand") == F.col("tf")), "weight").withColumn("rank", F.col("rank").cast("long"))


@query(f"{V.with_views('links')}\nSELECT least(source, target) AS g1, greatest(source, target) AS g2, count(DISTINCT cluster) AS n_sig, max(-coef_mean) AS c_max FROM links WHERE p < 0.4 AND -coef_mean > 0 GROUP BY 1, 2")
def m49_interface_counts(spark, d):
    s = V.links(spark, d).select(F.col("cluster").alias("ct1"), F.col("cluster").alias("ct2"), F.col("source").alias("g1"), F.col("target").alias("g2"), F.col("p").alias("fdr"), (-F.col("coef_mean")).alias("c"))
    return X.interface_counts(s, 0.4)


@query(f"{V.with_views('cells', 'expr', 'lr')}, {NEAR}, {_PLAIN}, {_FACTORS}, rec AS (SELECT i AS cell_id, gene, sum({KERNEL} * value) / (SELECT count(*) FROM cells) AS w FROM near JOIN pe ON j = pe.cell_id GROUP BY 1, 2), f AS (SELECT fb.cell_id AS cell_id, target, beta, kind, l, coalesce(e.value, 0) AS x, coalesce(w, 0) AS w FROM fb LEFT JOIN pe e ON e.cell_id = fb.cell_id AND e.gene = target LEFT JOIN rec ON rec.cell_id = fb.cell_id AND rec.gene = l), u AS (SELECT target, cell_id, l AS gene, CASE WHEN kind = 0 THEN beta ELSE beta * x END AS d FROM f UNION ALL SELECT target, cell_id, target, CASE WHEN kind = 2 OR x > 0 THEN beta * w ELSE 0 END FROM f WHERE kind > 0)\nSELECT target, cell_id, gene, round(sum(d), 6) AS d FROM u GROUP BY 1, 2, 3")
def m15_splash(spark, d):
    c, e = V.cells(spark, d), _plain_expr(spark, d)
    return rounded(X.splash(_factor_betas(spark, d), e, P.received(c, e, RADIUS, c.count())), "d")


@query(f"{V.with_views('cells', 'expr', 'lr')}, {NEAR}, {_PLAIN}, {_FACTORS}, mb AS (SELECT target, modulator, max(kind) AS kind, max(l) AS l, avg(beta) AS beta FROM fb GROUP BY 1, 2), rec AS (SELECT i AS cell_id, gene, sum({KERNEL} * value) / (SELECT count(*) FROM cells) AS w FROM near JOIN pe ON j = pe.cell_id GROUP BY 1, 2), f AS (SELECT c.cell_id AS cell_id, target, beta, kind, l, coalesce(e.value, 0) AS x, coalesce(w, 0) AS w FROM cells c CROSS JOIN mb LEFT JOIN pe e ON e.cell_id = c.cell_id AND e.gene = target LEFT JOIN rec ON rec.cell_id = c.cell_id AND rec.gene = l), u AS (SELECT target, cell_id, l AS gene, CASE WHEN kind = 0 THEN beta ELSE beta * x END AS d FROM f UNION ALL SELECT target, cell_id, target, CASE WHEN kind = 2 OR x > 0 THEN beta * w ELSE 0 END FROM f WHERE kind > 0)\nSELECT target, cell_id, gene, round(sum(d), 6) AS d FROM u GROUP BY 1, 2, 3")
def m17_mean_splash(spark, d):
    c, e = V.cells(spark, d), _plain_expr(spark, d)
    return rounded(X.mean_splash(_factor_betas(spark, d), c, e, P.received(c, e, RADIUS, c.count())), "d")


@query()
def m14_perturbed(spark, d):
    c, e = V.cells(spark, d), cut(_plain_expr(spark, d))
    gone = c.select("cell_id", F.lit("Brand11").alias("gene"), F.lit(0.0).alias("level"))
    return X.perturb(e, c, _factor_betas(spark, d, e), gone, RADIUS, hops=2)
