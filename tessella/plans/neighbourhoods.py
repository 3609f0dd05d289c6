"""Queries of transitions, smoothing, grids and walks, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.operators import neighbourhoods as N
from tessella.operators import permutation as M
from tessella.operators import spatial as P
from tessella.operators import statistics as Q
from tessella.operators.components import components
from tessella.operators.diffusion import diffusion_map, end_probabilities, kernel, pseudotime
from tessella.operators.metric import neighbours
from tessella.operators.smoothing import smooth_by_doubling
from tessella.plans.permutations import _perm
from tessella.plans.registry import PLAN, knn, longs, query, rounded, uniform
from tessella.sources import views as V

K = 5
_CHANGE = "change AS (SELECT cell_id, gene, value * ((cell_id + ord) % 5 - 2) / 10.0e0 AS d FROM expr JOIN lr ON gene = ligand)"
#: Correlation over all genes of a cell's change with the difference to a neighbour; none counts as 1.
_CORR = "g AS (SELECT DISTINCT gene FROM expr), cr AS (SELECT i, j, {key}CASE WHEN stddev_pop(coalesce(d, 0)) > 1e-9 AND stddev_pop(coalesce(y.value, 0) - coalesce(x.value, 0)) > 1e-9 THEN corr(coalesce(d, 0), coalesce(y.value, 0) - coalesce(x.value, 0)) END AS r FROM knn CROSS JOIN g {cross}LEFT JOIN expr x ON x.cell_id = i AND x.gene = g.gene LEFT JOIN expr y ON y.cell_id = j AND y.gene = g.gene LEFT JOIN {change} c ON c.cell_id = i AND c.gene = g.gene{on} GROUP BY {group}), tp AS (SELECT {key}i, j, r, exp(coalesce(r, 1) / 0.05e0) / sum(exp(coalesce(r, 1) / 0.05e0)) OVER (PARTITION BY {key}i) AS p FROM cr)"
_TP = _CORR.format(key="", cross="", change="change", on="", group="1, 2")
_P = f"{V.with_views('cells', 'expr', 'lr')}, {knn(K)}, {_CHANGE}, {_TP}"


def _change(e, lr):
    j = e.join(F.broadcast(lr), F.col("gene") == F.col("ligand"))  # a row a gene
    return j.select("cell_id", "gene", (F.col("value") * ((F.col("cell_id") + F.col("ord")) % 5 - 2) / 10).alias("value"))


def _near(spark, d, k=K):
    c = V.cells(spark, d)
    return P.nearest(c, c, k).select("i", "j"), c


def _p(spark, d):
    """Transitions (i, j, r, p), written, as several steps of a query read them, and the cells."""
    near, c = _near(spark, d)
    e = cut(V.expr(spark, d))
    r = P.change_correlation(near, e, _change(e, V.lr(spark, d)), e.select("gene").distinct().count())
    return cut(P.transition_probabilities(r, F.col("r")).select("i", "j", "r", "p")), c


@query(f"{_P}\nSELECT i, j, round(p, 5) AS p FROM tp")
def m19_transition_probabilities(spark, d):
    return rounded(_p(spark, d)[0].select("i", "j", "p"), "p", digits=5)


@query()
def m19_random_neighbours(spark, d):
    c = V.cells(spark, d)
    return P.random_neighbours(c, 4).withColumn("even", F.lit(False)).union(P.even_neighbours(c, 2).withColumn("even", F.lit(True)))


@query(f"{V.with_views('cells')}, {knn(1)}, m AS (SELECT quantile_cont(sqrt(d2), 0.5) AS m FROM knn)\nSELECT cell_id, round(x * (15 / m), 6) AS x, round(y * (15 / m), 6) AS y FROM cells CROSS JOIN m")
def w8_median_scale(spark, d):
    return rounded(N.median_scale(V.cells(spark, d)).select("cell_id", "x", "y"), "x", "y")


@query(f"{V.with_views('cells', 'expr')}, {knn(K, True)}\nSELECT i AS cell_id, gene, round(sum(value) / {K}, 6) AS value FROM knn JOIN expr ON expr.cell_id = j GROUP BY 1, 2")
def m23_smoothed(spark, d):
    return rounded(N.smooth(V.expr(spark, d), V.cells(spark, d), K), "value")


@query(f"{V.with_views('cells')}, {knn(K, True)}, c AS (SELECT i, cell_type, count(*) AS n FROM knn JOIN cells ON cell_id = j GROUP BY 1, 2)\nSELECT i AS cell_id, cell_type FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, cell_type) AS r FROM c) q WHERE r = 1")
def m23_smoothed_labels(spark, d):
    return N.smooth_labels(V.cells(spark, d), K)


@query(f"{V.with_views('cells', 'expr')}, {knn(K, True)}, e AS (SELECT i, j, 1 / (1 + sqrt(d2)) AS w FROM knn JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j WHERE a.cell_type = b.cell_type), n AS (SELECT i, sum(w) AS n FROM e GROUP BY 1)\nSELECT e.i AS cell_id, gene, round(sum(w * value) / max(n), 6) AS value FROM e JOIN n ON n.i = e.i JOIN expr ON expr.cell_id = j GROUP BY 1, 2")
def m24_imputed(spark, d):
    c = V.cells(spark, d)
    near = P.nearest(c, c, K, with_self=True).select("i", "j", (1 / (1 + F.sqrt("d2"))).alias("w"))
    return rounded(N.impute(V.expr(spark, d), near, c, "cell_type"), "value")


@query(f"{V.with_views('cells', 'expr')}, {knn(K, True)}, p AS (SELECT i, j, 1.0e0 / {K} AS w FROM knn), one AS (SELECT i AS cell_id, gene, sum(w * value) AS value FROM p JOIN expr ON expr.cell_id = j GROUP BY 1, 2)\nSELECT i AS cell_id, gene, round(sum(w * value), 6) AS value FROM p JOIN one ON one.cell_id = j GROUP BY 1, 2")
def m24_diffused(spark, d):
    c = V.cells(spark, d)
    return rounded(N.diffuse(V.expr(spark, d), P.nearest(c, c, K, with_self=True).select("i", "j", F.lit(1.0).alias("w")), 2), "value")


@query()
def m24_smoothed_by_doubling(spark, d):
    return rounded(smooth_by_doubling(V.expr(spark, d), V.cells(spark, d), 12, 6), "value")


@query(f"{_P}\nSELECT i AS cell_id, round(sum(p * (b.x - a.x)), 4) AS dx, round(sum(p * (b.y - a.y)), 4) AS dy FROM tp JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j GROUP BY 1")
def m21_projected(spark, d):
    p, c = _p(spark, d)
    return rounded(N.project(p, c), "dx", "dy", digits=4)


@query(f"{_P}, n AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1)\nSELECT a.cell_type AS zone1, b.cell_type AS zone2, round(sum(p) / (max(n1.n) * max(n2.n)), 8) AS p FROM tp JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j JOIN n n1 ON n1.cell_type = a.cell_type JOIN n n2 ON n2.cell_type = b.cell_type GROUP BY 1, 2")
def a37_zone_means(spark, d):
    p, c = _p(spark, d)
    return rounded(N.zone_means(p, c), "p", digits=8)


@query(f"{_P}, m AS (SELECT i, cell_type AS fate, sum(p) AS mass FROM tp JOIN cells ON cell_id = j GROUP BY 1, 2)\nSELECT i AS cell_id, fate, round(mass, 5) AS mass FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(mass, 9) DESC, fate) AS r FROM m) q WHERE r = 1")
def w6_fates(spark, d):
    p, c = _p(spark, d)
    return rounded(N.fates(p, c), "mass", digits=5)


@query(f"{_P}, m AS (SELECT a.cell_type AS start, b.cell_type AS fate, avg(p) AS m FROM tp JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j GROUP BY 1, 2)\nSELECT fate, round(min(m), 6) AS least, round(avg(m), 6) AS mean, round(max(m), 6) AS most FROM m GROUP BY 1")
def a36_transition_summary(spark, d):
    p, c = _p(spark, d)
    return rounded(N.transition_summary(p, c), "least", "mean", "most")


@query(f"{_P}\nSELECT i, j, round(p - 1.0e0 / count(*) OVER (PARTITION BY i), 5) AS d FROM tp")
def m20_minus_null(spark, d):
    p, _ = _p(spark, d)
    return rounded(N.minus_null(p.select("i", "j", "p"), N.null_probabilities(p)), "d", digits=5)


@query(f"{_P}, q AS (SELECT i, j, p - 1.0e0 / count(*) OVER (PARTITION BY i) AS d FROM tp), l AS (SELECT least(min(d), 0) AS lo, greatest(max(d), 0) AS hi FROM q), v AS (SELECT i, j, (d - lo) / (hi - lo) AS v, -lo / (hi - lo) AS b FROM q CROSS JOIN l), s AS (SELECT i, sum(v) + ((SELECT count(*) FROM cells) - count(*)) * max(b) AS s FROM v GROUP BY 1)\nSELECT v.i AS i, j, round(v / s, 8) AS p, round(b / s, 8) AS rest FROM v JOIN s ON s.i = v.i")
def m20_rescaled(spark, d):
    p, c = _p(spark, d)
    return rounded(N.rescaled(N.minus_null(p.select("i", "j", "p"), N.null_probabilities(p)), c.count()), "p", "rest", digits=8)


_MASS = "t AS (SELECT cell_type AS fate, count(*) AS n FROM cells GROUP BY 1), ms AS (SELECT {key}i, cell_type AS fate, sum(p) AS s FROM tp JOIN cells ON cell_id = j WHERE coalesce(r, 1) > 0 GROUP BY ALL), ev AS (SELECT {keyc}c.cell_id AS i, c.cell_type AS start, t.fate AS fate, coalesce(s, 0) / n AS m FROM cells c CROSS JOIN t {cross}LEFT JOIN ms ON ms.i = c.cell_id AND ms.fate = t.fate{on}), own AS (SELECT {key}i, start, m AS own FROM ev WHERE start = fate), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}i ORDER BY round(m, 12) DESC, fate) AS k FROM ev) q WHERE k = 1), fl AS (SELECT {key}start, min(own) AS least FROM own GROUP BY ALL), an AS (SELECT {keyb}best.i AS cell_id, best.start AS start, CASE WHEN m > own AND m > 0.0002e0 AND m > least THEN fate WHEN own < 0.0002e0 THEN 'null' ELSE best.start END AS transition FROM best JOIN own USING ({key}i) JOIN fl ON fl.start = best.start{onf})"
_ANNOTATED = _MASS.format(key="", keyc="", keyb="", cross="", on="", onf="")


@query(f"{_P}, {_ANNOTATED}\nSELECT * FROM an")
def m36_annotated(spark, d):
    p, c = _p(spark, d)
    return N.annotate_transitions(p.where(F.coalesce("r", F.lit(1.0)) > 0), c)


@query(f"{_P}, {_ANNOTATED}\nSELECT start, transition, count(*) AS n FROM an GROUP BY 1, 2")
def m36_counts(spark, d):
    return N.transition_counts(m36_annotated(spark, d))


_PERMUTED = f"{V.with_views('cells', 'expr', 'lr')}, {knn(K)}, {_CHANGE}, {_perm()}, pch AS (SELECT m, perm.cell_id AS cell_id, gene, d FROM perm JOIN change ON src = change.cell_id), ms AS (SELECT DISTINCT m FROM plan), " + _CORR.format(key="m, ", cross="CROSS JOIN ms ", change="pch", on=" AND c.m = ms.m", group="1, 2, 3").replace("SELECT i, j, m, CASE", "SELECT i, j, ms.m AS m, CASE")


@query(f"{_PERMUTED}, {_TP.replace('g AS (SELECT DISTINCT gene FROM expr), cr AS', 'cr0 AS').replace('FROM cr)', 'FROM cr0)').replace('tp AS', 'tp0 AS')}, n AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1), o AS (SELECT a.cell_type AS zone1, b.cell_type AS zone2, sum(p) / (max(n1.n) * max(n2.n)) AS v FROM tp0 JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j JOIN n n1 ON n1.cell_type = a.cell_type JOIN n n2 ON n2.cell_type = b.cell_type GROUP BY 1, 2), z AS (SELECT m, a.cell_type AS zone1, b.cell_type AS zone2, sum(p) / (max(n1.n) * max(n2.n)) AS v FROM tp JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j JOIN n n1 ON n1.cell_type = a.cell_type JOIN n n2 ON n2.cell_type = b.cell_type GROUP BY 1, 2, 3), s AS (SELECT zone1, zone2, avg(v) AS mu, stddev_pop(v) AS sd FROM z GROUP BY 1, 2)\nSELECT o.zone1 AS zone1, o.zone2 AS zone2, round((max(o.v) - max(mu)) / max(CASE WHEN sd = 0 THEN 1 ELSE sd END), 3) AS z, round(count(*) FILTER (abs(z.v - mu) > abs(o.v - mu) + 1e-12) / {len(PLAN)}.0e0, 6) AS p FROM o JOIN s USING (zone1, zone2) JOIN z ON z.zone1 = o.zone1 AND z.zone2 = o.zone2 GROUP BY 1, 2")
def m36_zone_significance(spark, d):
    p, c = _p(spark, d)
    near = p.select("i", "j")
    e, n = cut(V.expr(spark, d)), len(PLAN)
    genes = e.select("gene").distinct().count()
    moved = cut(M.permuted_rows(_change(e, V.lr(spark, d)), M.permutations(c, PLAN)))
    out = None
    for m in range(n):
        r = P.change_correlation(near, e, moved.where(F.col("m") == m).drop("m"), genes)
        z = N.zone_means(P.transition_probabilities(r, F.col("r")).select("i", "j", "p"), c).withColumn("m", F.lit(m))
        out = z if out is None else out.unionByName(z)
    observed = N.zone_means(p, c).withColumnRenamed("p", "v")
    s = M.replicate_stats(observed, out.withColumnRenamed("p", "v"), ["zone1", "zone2"], n, strict=True)
    return rounded(rounded(s.select("zone1", "zone2", "z", "p"), "z", digits=3), "p")


@query(f"{V.with_views('cells')}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells), g AS (SELECT CAST(k // 4 AS INTEGER) AS gx, CAST(k % 4 AS INTEGER) AS gy FROM range(16) t(k)), d AS (SELECT cell_id, gx, gy, sqrt(pow(x - (x0 + (gx + 0.5e0) * (x1 - x0) / 4), 2) + pow(y - (y0 + (gy + 0.5e0) * (y1 - y0) / 4), 2)) AS d FROM cells CROSS JOIN b CROSS JOIN g)\nSELECT cell_id, gx, gy, round((d - min(d) OVER w) / greatest(max(d) OVER w - min(d) OVER w, 1e-15), 6) AS d FROM d WINDOW w AS (PARTITION BY cell_id)")
def m28_spatial_map(spark, d):
    return rounded(N.spatial_map(V.cells(spark, d), 4, 4), "d")


@query(f"{V.with_views('cells')}, {knn(4, True)}, a AS (SELECT DISTINCT j FROM knn WHERE i % 50 = 0 AND j % 50 <> 0), b AS (SELECT DISTINCT j FROM knn WHERE i % 50 = 1 AND j % 50 <> 0 AND j NOT IN (SELECT j FROM a))\nSELECT j AS cell_id, 'perturbed' AS niche FROM a WHERE j % 50 <> 2 UNION ALL SELECT j, 'control' FROM b WHERE j % 50 <> 2")
def j6_niche_groups(spark, d):
    c = V.cells(spark, d)
    return N.niche_groups(c, c.where("cell_id % 50 = 0"), c.where("cell_id % 50 = 1"), 4, c.where("cell_id % 50 = 2"))


@query(f"{V.with_views('cells')}, near AS (SELECT a.cell_id AS i, b.cell_id AS j FROM cells a JOIN cells b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900)\nSELECT c.cell_id AS cell_id, t.cell_type AS nbr_type, count(n.cell_id) AS n FROM cells c CROSS JOIN (SELECT DISTINCT cell_type FROM cells) t LEFT JOIN (SELECT i, j, cell_id, cell_type FROM near JOIN cells ON cell_id = j) n ON n.i = c.cell_id AND n.cell_type = t.cell_type GROUP BY 1, 2")
def a42_demographics(spark, d):
    return P.demographics(V.cells(spark, d), 30.0)


@query(f"""{V.with_views('cells').replace('WITH', 'WITH RECURSIVE', 1)}, {knn(12)}, spot AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS n FROM cells), named AS (SELECT j AS i, count(*) AS l FROM knn GROUP BY 1),
turn AS MATERIALIZED (SELECT i, list(n ORDER BY d2, j) AS js, row_number() OVER (ORDER BY coalesce(max(l), 0) DESC, i DESC) AS step FROM knn JOIN spot ON j = cell_id LEFT JOIN named USING (i) GROUP BY i),
walk AS (SELECT CAST(0 AS BIGINT) AS step, list_transform(range((SELECT count(*) FROM cells)), lambda x: CAST(0 AS BIGINT)) AS held, CAST([] AS BIGINT[]) AS took
  UNION ALL SELECT step, list_transform(held, lambda v, n: v + CASE WHEN list_contains(new, n) THEN 1 ELSE 0 END), new FROM (SELECT t.step AS step, held, list_slice(list_filter(js, lambda j: held[j] < 6), 1, 5) AS new FROM walk JOIN turn t ON t.step = walk.step + 1) q),
chosen AS (SELECT i, unnest(took) AS n FROM walk JOIN turn USING (step))
SELECT c.i AS i, cell_id AS j, round(d2, 6) AS d2 FROM chosen c JOIN spot USING (n) JOIN knn ON knn.i = c.i AND knn.j = cell_id""")
def w4_balanced_neighbours(spark, d):
    c = V.cells(spark, d)
    return rounded(N.balanced_neighbours(cut(P.nearest(c, c, 12)), 5, 6), "d2")


def _grid(m: int, pad: float = 0.0) -> str:
    b = f"bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells), lo AS (SELECT x0 - {pad} * (x1 - x0) AS x0, x1, y0 - {pad} * (y1 - y0) AS y0, y1 FROM bx), box AS (SELECT x0, x1 + {pad} * (x1 - x0) AS x1, y0, y1 + {pad} * (y1 - y0) AS y1 FROM lo)"
    return f"{b}, grid AS (SELECT k AS id, k // {m} AS gx, k % {m} AS gy, x0 + (k // {m}) * ((x1 - x0) / {m - 1}) AS x, y0 + (k % {m}) * ((y1 - y0) / {m - 1}) AS y FROM range({m * m}) t(k) CROSS JOIN box), gn AS (SELECT * FROM (SELECT g.id AS id, c.cell_id AS j, (g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y) AS d2, row_number() OVER (PARTITION BY g.id ORDER BY (g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y), c.cell_id) AS r FROM grid g CROSS JOIN cells c) q)"


_REG = f"{V.with_views('cells')}, {_grid(7)}, v AS (SELECT id, avg(j % 10) AS v FROM gn WHERE r <= 10 GROUP BY 1)"


@query(f"{_REG}, w AS (SELECT gx, gy, v FROM v JOIN grid USING (id)), d AS (SELECT gx, gy, CASE WHEN lag(v) OVER a IS NULL THEN lead(v) OVER a - v WHEN lead(v) OVER a IS NULL THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS dx, CASE WHEN lag(v) OVER b IS NULL THEN lead(v) OVER b - v WHEN lead(v) OVER b IS NULL THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS dy FROM w WINDOW a AS (PARTITION BY gy ORDER BY gx), b AS (PARTITION BY gx ORDER BY gy))\nSELECT gx, gy, round(dx / CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE sqrt(sqrt(dx * dx + dy * dy)) END, 6) AS dx, round(dy / CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE sqrt(sqrt(dx * dx + dy * dy)) END, 6) AS dy FROM d")
def m22_gradient(spark, d):
    c = V.cells(spark, d).withColumn("v", (F.col("cell_id") % 10).cast("double"))
    g = N.grid(c, 7, 7)
    v = N.knn_regression(c, g, "v", 10).join(g.select("cell_id", "gx", "gy"), "cell_id").select("gx", "gy", "value")
    return rounded(N.root_normalised(N.gradient(v)), "dx", "dy")


@query(f"{_REG}, cs AS (SELECT id, (x * v + y) / (sqrt(x * x + y * y) * sqrt(v * v + 1) + 1e-8) AS cos FROM v JOIN grid USING (id)), home AS (SELECT c.cell_id, cell_type, arg_min(g.id, ROW((g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y), g.id)) AS id FROM cells c CROSS JOIN grid g GROUP BY 1, 2)\nSELECT cell_type, round(avg(cos), 6) AS alignment FROM home JOIN cs USING (id) GROUP BY 1")
def a40_type_alignment(spark, d):
    c = V.cells(spark, d).withColumn("v", (F.col("cell_id") % 10).cast("double"))
    g = N.grid(c, 7, 7)
    v = N.knn_regression(c, g, "v", 10)
    one = g.select("cell_id", F.col("x").alias("dx"), F.col("y").alias("dy"))
    two = v.select("cell_id", F.col("value").alias("dx"), F.lit(1.0).alias("dy"))
    cos = g.join(N.alignment(one, two, ["cell_id"]), "cell_id")
    return rounded(N.type_alignment(c, cos, "cosine"), "alignment")


_WIDTH = 40.0
_PDF = f"exp(-d2 / {2 * _WIDTH * _WIDTH}e0) / ({_WIDTH} * sqrt(2 * pi()))"


@query(f"{V.with_views('cells')}, {_grid(6, 0.025)}, m AS (SELECT id, sum({_PDF}) AS mass, sum({_PDF} * (j % 7 - 3)) AS sx, sum({_PDF} * (j % 5 - 2)) AS sy FROM gn WHERE r <= 20 GROUP BY 1), f AS (SELECT id, sx / greatest(1, mass) AS dx, sy / greatest(1, mass) AS dy, mass FROM m), q AS (SELECT quantile_cont(sqrt(dx * dx + dy * dy), 0.995) AS q FROM f)\nSELECT id AS cell_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dx / q, 5) AS nx, round(dy / q, 5) AS ny, round(mass, 6) AS mass FROM f CROSS JOIN q")
def m42_grid_flow(spark, d):
    c = V.cells(spark, d)
    moves = c.select("cell_id", (F.col("cell_id") % 7 - 3).cast("double").alias("dx"), (F.col("cell_id") % 5 - 2).cast("double").alias("dy"))
    return rounded(rounded(N.flow_on_grid(N.grid(c, 6, 6, 0.025), c, moves, 20, _WIDTH), "dx", "dy", "mass"), "nx", "ny", digits=5)


_TR = f"{_P}, {knn(K + 1, True, 'nself')}, dm AS (SELECT tp.i AS i, tp.j AS j, p * exp(-d2 / 5000.0e0) AS v FROM tp JOIN knn ON knn.i = tp.i AND knn.j = tp.j), da AS (SELECT i, j, v FROM dm UNION ALL SELECT i, i, max(v) FROM dm GROUP BY i), a AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS a FROM da), b AS (SELECT i, j, exp(-d2 / 1250.0e0) / sum(exp(-d2 / 1250.0e0)) OVER (PARTITION BY i) AS b FROM nself), mx AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, 0.8e0 * coalesce(a, 0) + 0.2e0 * coalesce(b, 0) AS v FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j), tr AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS p FROM mx)"


def _tr(spark, d):
    p, c = _p(spark, d)
    return N.walk_matrix(p.select("i", "j", "p"), P.nearest(c, c, K + 1, with_self=True).select("i", "j", "d2"), 50.0, 25.0), c


@query(f"{_TR}\nSELECT i, j, round(p, 5) AS p FROM tr")
def m18_walk_matrix(spark, d):
    return rounded(_tr(spark, d)[0], "p", digits=5)


def _hop(before: str, after: str, step: int) -> str:
    return f"{after} AS (SELECT start, copy, j AS cell FROM (SELECT start, copy, cell, {uniform('0', 'start', 'copy', str(step))} AS u FROM {before}) q JOIN hops ON i = cell AND u >= lo AND (u < hi OR k = n))"


#: A plain graph for walks, whose probabilities need no rounding: the neighbours by rank, weighted 1 to 5.
_HOPS = f"{V.with_views('cells')}, {knn(K)}, tr AS (SELECT i, j, (6 - rank) / 15.0e0 AS p FROM knn), hops AS (SELECT i, j, sum(p) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING) - p AS lo, sum(p) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING) AS hi, row_number() OVER (PARTITION BY i ORDER BY j) AS k, count(*) OVER (PARTITION BY i) AS n FROM tr), s0 AS (SELECT cell_id AS start, c AS copy, cell_id AS cell FROM cells CROSS JOIN range(2) t(c)), {_hop('s0', 's1', 1)}, {_hop('s1', 's2', 2)}"


def _walks(spark, d):
    c = V.cells(spark, d)
    p = P.nearest(c, c, K).select("i", "j", ((6 - F.col("rank")) / F.lit(15.0)).alias("p"))
    return N.walk(p, c, 2, copies=2), c


@query(f"{_HOPS}\nSELECT start, CAST(copy AS INTEGER) AS copy, 0 AS step, cell FROM s0 UNION ALL SELECT start, CAST(copy AS INTEGER), 1, cell FROM s1 UNION ALL SELECT start, CAST(copy AS INTEGER), 2, cell FROM s2")
def m18_walks(spark, d):
    return _walks(spark, d)[0]


@query(f"{_HOPS}\nSELECT a.cell_type AS start_type, b.cell_type AS end_type, count(*) AS n FROM s2 JOIN cells a ON a.cell_id = start JOIN cells b ON b.cell_id = cell GROUP BY 1, 2")
def a46_walk_table(spark, d):
    w, c = _walks(spark, d)
    return N.walk_table(w, c, 2)


_POINTS = "pts AS (SELECT cell_id, x - y AS score, x AS pseudotime, CAST(cell_id % 3 AS VARCHAR) AS misc FROM cells), lim AS (SELECT min(pseudotime) AS lo, max(pseudotime) AS hi FROM pts)"


def _points(spark, d):
    return V.cells(spark, d).select("cell_id", (F.col("x") - F.col("y")).alias("score"), F.col("x").alias("pseudotime"), (F.col("cell_id") % 3).cast("string").alias("misc"))


def _bins(n: int, inner: bool) -> str:
    width = f"((hi - lo) / {n if inner else n - 1})"
    return " + ".join(f"CASE WHEN pseudotime >= lo + {k} * {width} THEN 1 ELSE 0 END" for k in range(1, n))


@query(f"{V.with_views('cells')}, {_POINTS}, b AS (SELECT score, {_bins(10, True)} AS a, {_bins(10, False)} AS b FROM pts CROSS JOIN lim)\nSELECT true AS inner_bins, true AS positive, CAST(a AS BIGINT) AS bin, round(sum(score), 4) AS score FROM b WHERE score > 0 GROUP BY 3 UNION ALL SELECT false, false, CAST(b AS BIGINT), round(sum(score), 4) FROM b WHERE score < 0 GROUP BY 3")
def a47_score_sums(spark, d):
    p = _points(spark, d)
    one = N.score_sums(N.digitised(p, 10), True).select(F.lit(True).alias("inner_bins"), F.lit(True).alias("positive"), "bin", "score")
    two = N.score_sums(N.digitised(p, 10, inner=False), False).select(F.lit(False), F.lit(False), "bin", "score")
    return rounded(one.union(two), "score", digits=4)


@query(f"{V.with_views('cells', 'expr')}, {_POINTS}, b AS (SELECT cell_id, score, misc, {_bins(10, True)} AS bin FROM pts CROSS JOIN lim), s AS (SELECT gene, sum(score) AS score FROM b JOIN expr USING (cell_id) WHERE score < 0 AND misc = '1' AND bin IN (0, 1, 2, 3) GROUP BY 1)\nSELECT gene, round(score, 3) AS score, row_number() OVER (ORDER BY round(score, 9), gene) AS rank FROM s")
def m43_ranked_knockouts(spark, d):
    p = N.digitised(_points(spark, d), 10).join(V.expr(spark, d).select("cell_id", "gene"), "cell_id")
    return longs(rounded(N.rank_knockouts(N.score_sums(p, False, ["gene", "misc"]), [0, 1, 2, 3], "1"), "score", digits=3), "rank")


@query(f"{V.with_views('cells')}, v AS (SELECT cell_id, 'l' || CAST(cell_id % 2 AS VARCHAR) AS lineage, x AS t FROM cells UNION ALL SELECT cell_id, 'l2', CASE WHEN cell_id % 3 <> 0 THEN y END FROM cells)\nSELECT cell_id, round(avg(t), 6) AS pseudotime FROM v WHERE t IS NOT NULL GROUP BY 1")
def m41_lineage_pseudotime(spark, d):
    c = V.cells(spark, d)
    v = c.select("cell_id", F.concat(F.lit("l"), (F.col("cell_id") % 2).cast("string")).alias("lineage"), F.col("x").alias("pseudotime"))
    return rounded(N.lineage_pseudotime(v.union(c.select("cell_id", F.lit("l2"), F.when(F.col("cell_id") % 3 != 0, F.col("y"))))), "pseudotime")


@query()
def m41_pseudotime(spark, d):
    """Pseudotime over expression from the first cell of a type, and where ways end: the last cell of each other type."""
    c = V.cells(spark, d)
    pcs, _, _ = components(V.expr(spark, d), c, 8)
    graph = cut(kernel(neighbours(pcs.select("cell_id", F.col("pcs").alias("v")), 12), 4))
    root = c.where("cell_type = 'BUILDING'").agg(F.min("cell_id")).first()[0]
    value, psi = diffusion_map(graph, 5)
    time = cut(pseudotime(value, psi, root))
    last = F.max_by("cell_id", F.struct(F.round("pseudotime", 6), "cell_id")).alias("cell_id")
    ends = time.where("pseudotime is not null").join(c.where("cell_type <> 'BUILDING'"), "cell_id").groupBy(F.col("cell_type").alias("state")).agg(last)
    return time.join(end_probabilities(graph, time, ends), "cell_id", "left")


@query()
def m37_niches(spark, d):
    from tessella.operators.clusters import niches

    c = V.cells(spark, d)
    return niches(c.select("cell_id", "cell_type", F.array("x", "y").alias("features")))


@query(f"{V.with_views('cells', 'expr')}, {knn(4, True)}, a AS (SELECT DISTINCT j FROM knn WHERE i % 20 = 0 AND j % 20 <> 0), b AS (SELECT DISTINCT j FROM knn WHERE i % 20 = 1 AND j % 20 <> 0 AND j NOT IN (SELECT j FROM a)), c AS (SELECT j AS cell_id, true AS one FROM a UNION ALL SELECT j, false FROM b), dense AS (SELECT c.cell_id, one, g.gene, coalesce(e.value, 0) AS x FROM c CROSS JOIN (SELECT DISTINCT gene FROM expr JOIN c ON c.cell_id = expr.cell_id) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene), r AS (SELECT gene, one, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0e0 AS rank FROM dense), s AS (SELECT gene, sum(rank) FILTER (one) AS r1, CAST(count(*) FILTER (one) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT one) AS DOUBLE) AS n2 FROM r GROUP BY 1)\nSELECT gene, round((r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS score FROM s")
def j6_niche_degs(spark, d):
    c = V.cells(spark, d)
    n = N.niche_groups(c, c.where("cell_id % 20 = 0"), c.where("cell_id % 20 = 1"), 4)
    e = V.expr(spark, d).join(n.select("cell_id"), "cell_id", "left_semi")
    return rounded(Q.rank_sum_degs(e, n, F.col("niche") == "perturbed").select("gene", "score"), "score")
