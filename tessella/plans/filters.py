"""Queries of filters, names, sets and joins of result tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import communication as C
from tessella.operators import design as G
from tessella.operators import results as R
from tessella.operators import spatial as P
from tessella.operators import statistics as Q
from tessella.plans.registry import KERNEL, NEAR, RADIUS, query, rounded
from tessella.sources import views as V

_LABELS = ("CD4 T cell", "other", "Tregs", "gamma delta", "B cell", " Rest ", "cd8 memory", "macrophage")
_LABEL = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_LABELS)) + " END"


def _plain(c):
    return F.replace(F.col(c), F.lit("#"), F.lit(""))


def _names(spark, d):
    lr = V.lr(spark, d).select(_plain("ligand").alias("l"), _plain("receptor").alias("r"))
    return lr.select(F.explode(F.array("l", F.concat("l", F.lit("$"), "r"), F.concat("l", F.lit("#"), "r"), F.concat(F.lit("metab@"), "l"))).alias("factor")).distinct()


@query(f"{V.with_views('lr')}, p AS (SELECT replace(ligand, '#', '') AS l, replace(receptor, '#', '') AS r FROM lr)\nSELECT l AS factor, l AS genes FROM p UNION SELECT l || '$' || r, l || '|' || r FROM p UNION SELECT l || '#' || r, l || '|' || r FROM p UNION SELECT 'metab@' || l, '' FROM p")
def f2_factor_genes(spark, d):
    return _names(spark, d).select("factor", F.array_join(S.factor_genes(F.col("factor")), "|").alias("genes"))


@query("SELECT c_custkey AS cell_id, c_mktsegment AS cell_type FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def f6_selected_cells(spark, d):
    return R.select_cells(V.cells(spark, d).select("cell_id", "cell_type"), "cell_type", ["BUILDING", "MACHINERY"])


@query(f"{V.with_views('expr', 'cells')}, n AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1)\nSELECT cell_type, gene FROM expr JOIN cells USING (cell_id) JOIN n USING (cell_type) WHERE value > 0 GROUP BY cell_type, gene, n HAVING count(*) >= 0.55 * n")
def f8_type_genes(spark, d):
    return Q.type_gene_filter(V.expr(spark, d), V.cells(spark, d), 0.55)


_RES = "res AS (SELECT cluster, source, target, p AS FDR_np, coef_mean AS C_np, p * 2 AS Z_FDR, coef_mean AS C_p FROM links)"


@query(f"{V.with_views('links')}, {_RES}\nSELECT cluster, source, target, FDR_np < 0.3 AND C_np > -0.25 + 0.25 AS np, Z_FDR < 0.3 AS par FROM res")
def f9_selected(spark, d):
    k = V.links(spark, d).select("cluster", "source", "target", F.col("p").alias("FDR_np"), F.col("coef_mean").alias("C_np"), (F.col("p") * 2).alias("Z_FDR"), F.col("coef_mean").alias("C_p"))
    np_ = C.select_significant(k, "non-parametric", threshold=0.3).withColumnRenamed("selected", "np")
    return C.select_significant(np_, "parametric", threshold=0.3).select("cluster", "source", "target", "np", F.col("selected").alias("par"))


@query(f"{V.with_views('links')}\nSELECT cluster, source, target FROM links WHERE p < 0.3 AND -coef_mean > 0")
def f10_selected_edges(spark, d):
    return V.links(spark, d).where(R.is_selected(F.col("p"), -F.col("coef_mean"), 0.3)).select("cluster", "source", "target")


@query("SELECT DISTINCT p_brand AS gene FROM part WHERE contains(lower(p_brand), 'd#1')")
def f14_search(spark, d):
    return V.table(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct().where(S.contains_ci(F.col("gene"), "D#1"))


@query("SELECT gene, CAST(pos AS INTEGER) AS pos FROM (VALUES ('Brand#7', 0), ('Brand#3', 1), ('Brand#11', 2)) t(gene, pos) WHERE gene IN (SELECT p_brand FROM part)")
def f15_focus(spark, d):
    return R.focus_genes(V.table(spark, d, "part").select(F.col("p_brand").alias("gene")), ["Brand#7", "Brand#3", "Brand#7", "Brand#11"])


@query("SELECT n_name, n_nationkey FROM nation")
def f17_kept_columns(spark, d):
    return R.kept_columns(V.table(spark, d, "nation"), ["n_name", "absent", "n_nationkey"])


@query("SELECT count(DISTINCT CASE WHEN regexp_full_match(p_brand, '[A-Z][^A-Z]+') THEN p_brand END) > count(DISTINCT CASE WHEN regexp_matches(p_brand, '[A-Z]') AND NOT regexp_matches(p_brand, '[a-z]') THEN p_brand END) AS mouse FROM part")
def f19_species(spark, d):
    mouse = R.is_mouse(V.table(spark, d, "part").select(F.col("p_brand").alias("gene")))
    return spark.range(1).select(F.lit(bool(mouse)).alias("mouse"))


@query("SELECT c_custkey AS cell_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'GROUP' ELSE 'other' END AS label FROM customer")
def f21_relabelled(spark, d):
    return R.relabelled(V.cells(spark, d).select("cell_id", "cell_type"), "cell_type", {"GROUP": ["BUILDING", "MACHINERY"]}, "other", "label").drop("cell_type")


@query(f"WITH t AS (SELECT DISTINCT {_LABEL} AS ct FROM part UNION SELECT NULL), x AS (SELECT a.ct AS ct1, b.ct AS ct2, coalesce(lower(trim(a.ct)) <> 'other', false) AS t1, coalesce(lower(trim(b.ct)) <> 'other', false) AS t2 FROM t a CROSS JOIN t b)\nSELECT ct1, ct2, CASE WHEN ct1 IS NULL OR ct2 IS NULL THEN 'cell_type_independent' WHEN ct1 = ct2 THEN CASE WHEN t1 THEN 'within_Tcell' ELSE 'within_other' END WHEN t1 OR t2 THEN 'Tcell_interface' ELSE 'non_Tcell_interface' END AS involvement FROM x")
def f23_involvement(spark, d):
    t = _labels(spark, d).union(spark.range(1).select(F.lit(None).cast("string")))
    return R.combinations(t, "label", "ct1", "ct2", ordered=True).withColumn("involvement", R.involvement(F.col("ct1"), F.col("ct2")))


def _labels(spark, d):
    k = F.col("p_partkey") % 8
    return V.table(spark, d, "part").select(F.element_at(F.array(*map(F.lit, _LABELS)), (k + 1).cast("int")).alias("label")).distinct()


@query(f"SELECT DISTINCT {_LABEL} AS label, CASE WHEN lower(trim({_LABEL})) IN ('other', 'background', 'rest') THEN 'other' WHEN regexp_matches(lower({_LABEL}), 't[ -]cell|cd[48]|\\btregs?\\b|gamma delta') THEN 'tcell' ELSE 'other' END AS family FROM part")
def f24_families(spark, d):
    return _labels(spark, d).withColumn("family", S.cell_family(F.col("label")))


@query(f"{V.with_views('expr', 'cells')}\nSELECT cell_id, gene, value FROM (SELECT cell_id, CASE WHEN gene = 'Brand#3' THEN 'mt-Co1' ELSE gene END AS gene, value FROM expr) e JOIN (SELECT cell_id FROM cells WHERE cell_type <> 'BUILDING') c USING (cell_id) WHERE gene <> 'mt-Co1'")
def f27_without_mitochondria(spark, d):
    e = V.expr(spark, d).withColumn("gene", F.when(F.col("gene") == "Brand#3", "mt-Co1").otherwise(F.col("gene")))
    c = V.cells(spark, d).withColumn("cell_type", F.when(F.col("cell_type") != "BUILDING", F.col("cell_type")))
    return Q.mitochondrial_free(e, c)


@query(f"{V.with_views('cells')}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells), g AS (SELECT k AS id, x0 + (k // 6) * ((x1 - x0) / 5) AS x, y0 + (k % 6) * ((y1 - y0) / 5) AS y FROM range(36) t(k) CROSS JOIN b)\nSELECT cell_id, id AS point FROM (SELECT c.cell_id AS cell_id, g.id AS id, row_number() OVER (PARTITION BY c.cell_id ORDER BY (c.x - g.x) * (c.x - g.x) + (c.y - g.y) * (c.y - g.y), g.id) AS r FROM cells c CROSS JOIN g) q WHERE r = 1")
def j4_nearest_points(spark, d):
    from tessella.operators import neighbourhoods as N

    c = V.cells(spark, d)
    return P.nearest(c, N.grid(c, 6, 6), 1, with_self=True).select(F.col("i").alias("cell_id"), F.col("j").alias("point"))


@query(f"{V.with_views('links')}, pw AS (SELECT DISTINCT 'c' || CAST(p_size % 3 AS VARCHAR) AS metabolite, 'path' || CAST(p_size % 3 AS VARCHAR) AS pathway FROM part WHERE p_size % 3 <> 1)\nSELECT cluster AS metabolite, source, target, coalesce(pathway, cluster) AS pathway FROM links LEFT JOIN pw ON pw.metabolite = cluster")
def j8_with_pathway(spark, d):
    k = (F.col("p_size") % 3).cast("string")
    pw = V.table(spark, d, "part").where("p_size % 3 <> 1").select(F.concat(F.lit("c"), k).alias("metabolite"), F.concat(F.lit("path"), k).alias("pathway"))
    return R.with_pathway(V.links(spark, d).select(F.col("cluster").alias("metabolite"), "source", "target"), pw).select("metabolite", "source", "target", "pathway")


@query(f"{V.with_views('betas', 'cells')}, m AS (SELECT cell_id, cell_id // 2 AS ref FROM cells)\nSELECT m.cell_id AS cell_id, target, modulator, round(beta, 6) AS beta FROM m LEFT JOIN betas b ON b.cell_id = ref")
def j14_matched_betas(spark, d):
    m = V.cells(spark, d).select("cell_id", F.floor(F.col("cell_id") / 2).alias("reference_cell"))
    return rounded(R.matched_betas(V.betas(spark, d), m).select("cell_id", "target", "modulator", "beta"), "beta")


@query(f"{V.with_views('expr', 'cells')}\nSELECT c.cell_id AS cell_id, g.gene AS factor, CAST(coalesce(value, 0) AS DOUBLE) AS x FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene")
def j15_filled(spark, d):
    e = V.expr(spark, d).select("cell_id", F.col("gene").alias("factor"), F.col("value").alias("x"))
    return G.filled(e, V.cells(spark, d), e)


@query(f"{V.with_views('links', 'lr')}\nSELECT ligand AS gene FROM lr WHERE ligand NOT IN (SELECT source FROM links WHERE p < 0.02) AND ligand NOT IN (SELECT target FROM links WHERE p < 0.05)")
def j16_remaining(spark, d):
    k = V.links(spark, d)
    return R.remaining_genes(V.lr(spark, d).select(F.col("ligand").alias("gene")), k.where("p < 0.02").select(F.col("source").alias("gene")), k.where("p < 0.05").select(F.col("target").alias("gene")))


@query(f"{V.with_views('links', 'lr')}, p AS (SELECT DISTINCT least(ligand, receptor) || '__' || greatest(ligand, receptor) AS k, ligand AS g1, receptor AS g2 FROM lr)\nSELECT target || '__' || source AS id, g1, g2, count(*) AS n FROM links JOIN p ON k = least(source, target) || '__' || greatest(source, target) GROUP BY 1, 2, 3")
def j18_either_order(spark, d):
    t = V.links(spark, d).select(F.concat("target", F.lit("__"), "source").alias("id"))
    return R.with_pair(t, V.lr(spark, d).select(F.col("ligand").alias("g1"), F.col("receptor").alias("g2"))).groupBy("id", "g1", "g2").agg(F.count("*").alias("n"))


@query(f"{V.with_views('cells')}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells), g AS (SELECT k AS id, x0 + (k // 8) * ((x1 - x0) / 7) AS x, y0 + (k % 8) * ((y1 - y0) / 7) AS y FROM range(64) t(k) CROSS JOIN b)\nSELECT g.id AS cell_id, c.cell_id AS point FROM g JOIN cells c ON abs(g.x - c.x) <= 60.0e0 AND abs(g.y - c.y) <= 45.0e0")
def j19_box_members(spark, d):
    from tessella.operators import neighbourhoods as N

    c = V.cells(spark, d)
    return P.box_members(N.grid(c, 8, 8), c, 60.0, 45.0)


@query(f"{V.with_views('expr')}, s AS (SELECT 's1' AS sample, cell_id, gene AS factor, value AS x FROM expr WHERE value > 30 UNION ALL SELECT 's2', cell_id, gene, value FROM expr WHERE gene <> 'Brand#5')\nSELECT * FROM s WHERE factor IN (SELECT factor FROM s WHERE sample = 's1' INTERSECT SELECT factor FROM s WHERE sample = 's2')")
def j20_paired_samples(spark, d):
    e = V.expr(spark, d).select("cell_id", F.col("gene").alias("factor"), F.col("value").alias("x"))
    return G.paired_samples({"s1": e.where("x > 30"), "s2": e.where("factor <> 'Brand#5'")}, common=True)


@query(f"{V.with_views('cells', 'expr')}, {NEAR}, src AS (SELECT cell_id, gene, value, false AS masked FROM expr UNION ALL SELECT cell_id, gene, value, true FROM expr WHERE value > 40)\nSELECT i AS cell_id, gene, masked, round(sum({KERNEL} * value) * 100 / (SELECT count(*) FROM cells), 5) AS value FROM near JOIN src ON j = src.cell_id GROUP BY 1, 2, 3")
def a3_received_tables(spark, d):
    c, e = V.cells(spark, d), V.expr(spark, d)
    return rounded(P.received_tables(c, e, e.where("value > 40").select("cell_id", "gene"), RADIUS, c.count()), "value", digits=5)


@query(f"{V.with_views('lr', 'links')}, x AS (SELECT cluster AS k, source, target, p FROM links)\nSELECT k, source, target, p FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, k, target) AS r FROM x) q WHERE r = 1")
def a56_first_kept(spark, d):
    return R.first_kept(V.links(spark, d).select(F.col("cluster").alias("k"), "source", "target", "p"), ["source"], ["p", "k", "target"])


@query(f"{V.with_views('links')}\nSELECT source, NULL AS target, p FROM links WHERE cluster = 'c0' UNION ALL SELECT source, target, NULL FROM links WHERE cluster = 'c1'")
def u1_stacked(spark, d):
    k = V.links(spark, d)
    return R.stacked(k.where("cluster = 'c0'").select("source", "p"), k.where("cluster = 'c1'").select("source", "target")).select("source", "target", "p")


@query(f"{V.with_views('links')}\nSELECT source AS gene FROM links WHERE p < 0.1 UNION SELECT target FROM links WHERE p < 0.05")
def u2_united(spark, d):
    k = V.links(spark, d)
    return R.united(k.where("p < 0.1").select(F.col("source").alias("gene")), k.where("p < 0.05").select("target"))


@query(f"{V.with_views('links')}\nSELECT source AS gene FROM links WHERE cluster = 'c0' INTERSECT SELECT target FROM links INTERSECT SELECT source FROM links WHERE p < 0.2")
def u3_shared(spark, d):
    k = V.links(spark, d)
    return R.shared(k.where("cluster = 'c0'").select(F.col("source").alias("gene")), k.select("target"), k.where("p < 0.2").select("source"))


@query(f"{V.with_views('links')}\nSELECT target AS gene FROM links EXCEPT SELECT source FROM links EXCEPT SELECT target FROM links WHERE p < 0.01")
def u4_without(spark, d):
    k = V.links(spark, d)
    return R.without(k.select(F.col("target").alias("gene")), k.select("source"), k.where("p < 0.01").select("target"))


@query(f"{V.with_views('links')}\nSELECT source, p FROM links WHERE cluster = 'c0' UNION ALL SELECT source, p FROM links WHERE cluster = 'c1'")
def u5_common_columns(spark, d):
    k = V.links(spark, d)
    return R.stacked_common(k.where("cluster = 'c0'").select("source", "p", "coef_mean"), k.where("cluster = 'c1'").select("target", "source", "p"))


@query(f"{V.with_views('links')}\nSELECT DISTINCT cluster AS metabolite, least(source, target) AS g1, greatest(source, target) AS g2 FROM links")
def u6_pair_sets(spark, d):
    return R.pair_sets(V.links(spark, d).select(F.col("cluster").alias("metabolite"), F.col("source").alias("g1"), F.col("target").alias("g2")))


@query(f"{V.with_views('lr')}, e AS (SELECT 'm' || CAST(30 - ord AS VARCHAR) AS name, ligand AS g1, receptor AS g2, ord FROM lr UNION ALL SELECT 'n' || CAST(ord AS VARCHAR), receptor, ligand, ord + 100 FROM lr WHERE ord % 3 = 0), s AS (SELECT name, min(ord) AS o, string_agg(DISTINCT least(g1, g2) || '|' || greatest(g1, g2), ';' ORDER BY least(g1, g2) || '|' || greatest(g1, g2)) AS k FROM e GROUP BY 1)\nSELECT k, string_agg(name, '|' ORDER BY o, name) AS name FROM s GROUP BY 1")
def u7_merged_sets(spark, d):
    from tessella.operators import tables as T

    lr = V.lr(spark, d)
    one = lr.select(F.concat(F.lit("m"), (30 - F.col("ord")).cast("string")).alias("name"), F.col("ligand").alias("g1"), F.col("receptor").alias("g2"), "ord")
    two = lr.where("ord % 3 = 0").select(F.concat(F.lit("n"), F.col("ord").cast("string")), "receptor", "ligand", F.col("ord") + 100)
    return T.merge_equal_sets(one.union(two)).select(F.array_join(F.transform("pairs", lambda p: F.array_join(p, "|")), ";").alias("k"), "name")


@query(f"{V.with_views('lr')}\nSELECT a.signal AS metabolite, a.gene AS g1, b.gene AS g2 FROM (SELECT ord % 4 AS signal, ligand AS gene FROM lr) a JOIN (SELECT ord % 4 AS signal, ligand AS gene FROM lr) b ON a.signal = b.signal AND a.gene <= b.gene")
def u8_combinations(spark, d):
    return R.combinations(V.lr(spark, d).select((F.col("ord") % 4).alias("metabolite"), F.col("ligand").alias("gene")), "gene", "g1", "g2", by=["metabolite"])


@query(f"{V.with_views('links')}\nSELECT cluster, source, target, CASE WHEN p = 0 THEN '0' WHEN p < 0.001 THEN regexp_replace(printf('%.1e', p), 'e([+-])0?', 'e\\1') ELSE printf('%.3f', p) END AS rate, CASE WHEN c = 0 THEN '0' WHEN abs(c) >= 1 THEN printf('%.1f', c) ELSE printf('%.*f', CAST(greatest(0, 1 - floor(log10(abs(c)))) AS INTEGER), c) END AS strength, trim(regexp_replace(source || ' ' || target, '[^0-9A-Za-z]+', '_', 'g'), '_') AS slug FROM (SELECT *, coef_mean * 1.0001e0 AS c FROM links) q")
def s28_texts(spark, d):
    k = V.links(spark, d)
    return k.select("cluster", "source", "target", S.rate_text(F.col("p")).alias("rate"), S.strength_text(F.col("coef_mean") * 1.0001).alias("strength"), S.slug(F.concat("source", F.lit(" "), "target")).alias("slug"))


@query(f"{V.with_views('expr', 'lr')}, s AS (SELECT ligand || '+' || receptor AS side, ligand, receptor FROM lr)\nSELECT cell_id, side AS gene, round(exp((coalesce(max(CASE WHEN gene = ligand THEN ln(value + 1e-8) END), ln(1e-8)) + coalesce(max(CASE WHEN gene = receptor THEN ln(value + 1e-8) END), ln(1e-8))) / 2), 6) AS value FROM expr JOIN s ON gene = ligand OR gene = receptor GROUP BY 1, 2")
def s28_gene_sides(spark, d):
    sides = V.lr(spark, d).select(F.concat("ligand", F.lit("+"), "receptor").alias("side"), F.array("ligand", "receptor").alias("genes"))
    return rounded(C.gene_sides(sides, V.expr(spark, d), "geometric"), "value")
