"""Queries of the factor store and of designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.operators import design as G
from tessella.operators import tables as T
from tessella.plans.registry import KERNEL, NEAR, RADIUS, query, rounded
from tessella.sources import views as V

#: Gene names of the tables hold the character that joins ligand and regulator; factors are named without it.
_PLAIN = "pe AS (SELECT cell_id, replace(gene, '#', '') AS gene, value FROM expr), plr AS (SELECT replace(ligand, '#', '') AS ligand, replace(receptor, '#', '') AS receptor, ord FROM lr), pl AS (SELECT cluster, replace(source, '#', '') AS source, replace(target, '#', '') AS target, coef_mean, p FROM links)"


def _plain(c):
    return F.replace(F.col(c), F.lit("#"), F.lit(""))


def _tables(spark, d):
    e = V.expr(spark, d).withColumn("gene", _plain("gene"))
    lr = V.lr(spark, d).withColumns({"ligand": _plain("ligand"), "receptor": _plain("receptor"), "signaling": F.when(F.col("ord") % 2 == 0, "Secreted Signaling").otherwise("Cell-Cell Contact")})
    k = V.links(spark, d).withColumns({"source": _plain("source"), "target": _plain("target")})
    grn = k.select("target", F.col("source").alias("tf"), (F.col("p") < 0.1).cast("int").alias("flag"))
    w = k.groupBy(F.col("target").alias("tf"), F.col("source").alias("ligand")).agg((F.avg("coef_mean") + 1).alias("weight"))
    return e, lr, grn, w, lr.select(F.col("ligand").alias("target"))


_MAP = f"""{V.with_views('cells', 'expr', 'lr', 'links')}, {_PLAIN}, g AS (SELECT DISTINCT gene FROM pe),
tfs AS (SELECT DISTINCT target, source AS tf FROM pl WHERE p < 0.1 AND source <> target AND source IN (SELECT gene FROM g) AND target IN (SELECT gene FROM g) AND target IN (SELECT ligand FROM plr)),
w AS (SELECT target AS tf, source AS ligand, avg(coef_mean) + 1 AS weight FROM pl GROUP BY 1, 2),
lt AS (SELECT * FROM (SELECT tfs.target AS target, w.tf AS tf, ligand, row_number() OVER (PARTITION BY tfs.target, w.tf ORDER BY round(weight, 9) DESC, ligand) AS r FROM w JOIN tfs ON tfs.tf = w.tf WHERE ligand <> tfs.target AND round(weight, 9) > 0.5 AND ligand IN (SELECT ligand FROM plr)) q WHERE r <= 5),
fm AS (SELECT target, tf AS factor, 'tf' AS kind, 0 AS k, tf AS a, 0 AS c FROM tfs UNION ALL SELECT t.ligand, p.ligand || '$' || p.receptor, 'lr', 1, '', p.ord FROM plr t JOIN plr p ON p.ligand <> t.ligand AND p.receptor <> t.ligand UNION ALL SELECT target, ligand || '#' || tf, 'ltf', 2, tf, r FROM lt)"""


@query(f"{_MAP}\nSELECT target, factor, kind, row_number() OVER (PARTITION BY target ORDER BY k, a, c, factor) AS pos FROM fm")
def m32_factor_map(spark, d):
    e, lr, grn, w, targets = _tables(spark, d)
    return G.factor_map(e.select("gene").distinct(), grn, G.first_pairs(lr), w, targets, 0.5)


@query(f"{_MAP}, {NEAR}, rec AS (SELECT i AS cell_id, gene, sum({KERNEL} * value) / (SELECT count(*) FROM cells) AS r FROM near JOIN pe ON j = pe.cell_id GROUP BY 1, 2), f AS (SELECT DISTINCT factor, split_part(replace(factor, '$', '#'), '#', 1) AS l, CASE WHEN kind <> 'tf' THEN split_part(replace(factor, '$', '#'), '#', 2) END AS q FROM fm)\nSELECT cell_id, factor, round(CAST(value AS FLOAT), 3) AS x FROM f JOIN pe ON gene = l WHERE q IS NULL AND value <> 0 UNION ALL SELECT rec.cell_id, factor, round(CAST(r * value AS FLOAT), 3) FROM f JOIN rec ON rec.gene = l JOIN pe ON pe.cell_id = rec.cell_id AND pe.gene = q")
def m32_factor_values(spark, d):
    from tessella.operators import spatial as P

    e, *_ = _tables(spark, d)
    e, c = cut(e), V.cells(spark, d)
    out = G.factor_values(m32_factor_map(spark, d), e, P.received(c, e, RADIUS, c.count()))
    return out.withColumn("x", F.round(F.col("x").cast("float"), 3))


@query()
def m32_store(spark, d):
    e, lr, grn, w, targets = _tables(spark, d)
    _, map_ = G.build_store(V.cells(spark, d), cut(e), grn, lr, w, targets, 60.0, 30.0, 1.0, 0.5)
    return map_.select("target", "factor", "kind", "pos", "n")


@query(f"{_MAP}, own AS (SELECT factor, row_number() OVER (ORDER BY k, a, c, factor) AS pos FROM fm WHERE target = 'Brand7'), m AS (SELECT count(*) AS n FROM own)\nSELECT 'Brand7' AS target, factor, pos FROM own UNION ALL SELECT 'Brand7', 'metab@a', n + 1 FROM m UNION ALL SELECT 'Brand7', 'metab@b|c', n + 2 FROM m UNION ALL SELECT 'Brand7', 'near', n + 3 FROM m")
def m33_gene_design(spark, d):
    metabs = spark.createDataFrame([("metab@a", 0), ("metab@b|c", 1), ("metab@x", 2)], "factor string, pos int")
    customs = spark.createDataFrame([("far", 0), ("near", 1)], "factor string, pos int")
    return G.gene_design(m32_factor_map(spark, d), "Brand7", metabs, ["a", "b|c"], customs, ["near"])


@query(f"{V.with_views('expr')}\nSELECT cell_id, gene AS factor, value AS x FROM expr WHERE gene IN ('Brand#1', 'Brand#2') UNION ALL SELECT cell_id, gene, value * 2 FROM expr WHERE gene = 'Brand#3'")
def m34_merged_custom(spark, d):
    e = V.expr(spark, d)
    f = G.expression_factors(e, e.select("gene").where("gene in ('Brand#1', 'Brand#2')"))
    new = e.where("gene in ('Brand#2', 'Brand#3')").select("cell_id", F.col("gene").alias("factor"), (F.col("value") * 2).alias("x"))
    return G.merge_custom(f, new)


@query("SELECT DISTINCT p_brand AS gene FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-4]|Brand#2')")
def m35_pattern_genes(spark, d):
    return G.pattern_genes(V.expr(spark, d), "Brand#1[0-4]|Brand#2")


@query(f"{V.with_views('cells', 'expr', 'lr')}, {NEAR}, sets AS (SELECT 's' || CAST(ord % 3 AS VARCHAR) AS name, ligand AS gene FROM lr), sent AS (SELECT e.cell_id AS cell_id, cell_type || '-' || name AS f, sum(value) AS v FROM expr e JOIN sets USING (gene) JOIN cells c ON c.cell_id = e.cell_id GROUP BY 1, 2 UNION ALL SELECT cell_id, cell_type || '-proximity', 1 FROM cells)\nSELECT i AS cell_id, f AS factor, round(sum({KERNEL} * v) / (SELECT count(*) FROM cells), 6) AS x FROM near JOIN sent ON j = sent.cell_id GROUP BY 1, 2")
def a33_neighbourhood_scores(spark, d):
    sets = V.lr(spark, d).select(F.concat(F.lit("s"), (F.col("ord") % 3).cast("string")).alias("name"), F.col("ligand").alias("gene"))
    return rounded(G.neighbourhood_scores(V.cells(spark, d), V.expr(spark, d), sets, RADIUS, by_type=True, proximity=True), "x")


_MEMBERS = "mem AS (SELECT 's' || CAST(ord % 2 AS VARCHAR) AS name, ligand AS gene, 100 - ord AS o FROM plr WHERE ord <= 6), seen AS (SELECT name, factor, min(o * 100000 + pos) AS seen_at, count(DISTINCT gene) AS n FROM mem JOIN (SELECT target, factor, row_number() OVER (PARTITION BY target ORDER BY k, a, c, factor) AS pos FROM fm) m ON m.target = gene GROUP BY 1, 2), al AS (SELECT name, count(DISTINCT gene) AS n FROM mem WHERE gene IN (SELECT target FROM fm) GROUP BY 1)"


@query(f"{_MAP}, {_MEMBERS}\nSELECT 'union' AS mode, name, factor, row_number() OVER (PARTITION BY name ORDER BY seen_at, factor) AS pos FROM seen UNION ALL SELECT 'intersection', s.name, factor, row_number() OVER (PARTITION BY s.name ORDER BY seen_at, factor) FROM seen s JOIN al ON al.name = s.name AND al.n = s.n")
def a35_signature_factors(spark, d):
    e, lr, *_ = _tables(spark, d)
    members = lr.where("ord <= 6").select(F.concat(F.lit("s"), (F.col("ord") % 2).cast("string")).alias("name"), F.col("ligand").alias("gene"), (100 - F.col("ord")).alias("ord"))  # a signature of six genes
    m = m32_factor_map(spark, d)
    out = [G.signature_factors(m, members, mode).select(F.lit(mode).alias("mode"), "name", "factor", "pos") for mode in ("union", "intersection")]
    return out[0].union(out[1])


@query(f"{_MAP}, sg AS (SELECT ligand AS gene, CASE WHEN ord % 2 = 0 THEN 1 ELSE -1 END AS sign FROM plr WHERE ord <= 6), ff AS (SELECT DISTINCT factor FROM fm WHERE target = 'Brand7'), parts AS (SELECT factor, unnest(string_split(replace(factor, '$', '#'), '#')) AS gene FROM ff), hit AS (SELECT DISTINCT factor, gene FROM parts WHERE gene IN (SELECT gene FROM sg))\nSELECT 'target' AS keep, 'factor' AS kind, factor AS name FROM ff WHERE factor NOT IN (SELECT factor FROM hit) UNION ALL SELECT 'factor', 'gene', gene FROM sg WHERE gene NOT IN (SELECT gene FROM hit) UNION ALL SELECT 'target', 'gene', gene FROM sg UNION ALL SELECT 'factor', 'factor', factor FROM ff")
def a34_settled_overlap(spark, d):
    from tessella.operators import cellwise as W

    _, lr, *_ = _tables(spark, d)
    sets = lr.where("ord <= 6").select(F.lit("s").alias("name"), F.col("ligand").alias("gene"), F.when(F.col("ord") % 2 == 0, 1).otherwise(-1).alias("sign"))  # a signature of six genes
    f = m32_factor_map(spark, d).where("target = 'Brand7'").select(F.lit("s").alias("name"), "factor", "pos")
    out = None
    for keep in ("target", "factor"):
        s, k = W.settle_overlap(sets, f, keep)
        one = s.select(F.lit(keep).alias("keep"), F.lit("gene").alias("kind"), F.col("gene").alias("name")).union(k.select(F.lit(keep), F.lit("factor"), "factor"))
        out = one if out is None else out.union(one)
    return out


@query(f"{V.with_views('expr')}, t AS (SELECT cell_id, sum(value) AS total, count(*) FILTER (value > 0) AS n FROM expr GROUP BY 1)\nSELECT cell_id, 'n_total_transcripts' AS factor, CAST(total AS DOUBLE) AS x FROM t UNION ALL SELECT cell_id, 'n_total_genes', CAST(n AS DOUBLE) FROM t")
def a29_count_columns(spark, d):
    return G.count_columns(T.count_covariates(V.expr(spark, d)))
