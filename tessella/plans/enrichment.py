"""Queries of gene sets, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import enrichment as E
from tessella.plans.registry import query, rounded
from tessella.sources import views as V

_C = "(lgamma({a} + 1e0) - lgamma({b} + 1e0) - lgamma({a} - {b} + 1e0))"
_ONE = f"exp({_C.format(a='n_set', b='x')} + {_C.format(a='(n_all - n_set)', b='(n_list - x)')} - {_C.format(a='n_all', b='n_list')})"


@query(f"""{V.with_views('links', 'lr')},
u AS (SELECT DISTINCT source AS gene FROM links UNION SELECT target FROM links),
a AS (SELECT DISTINCT l.cluster AS query, l.target AS gene FROM links l JOIN lr ON l.source = ligand WHERE ord % 2 = 0 AND coef_mean > -0.25),
b AS (SELECT DISTINCT source AS name, target AS gene FROM links WHERE p < 0.5),
sa AS (SELECT query, count(*) AS n_list FROM a GROUP BY 1), sb AS (SELECT name, count(*) AS n_set FROM b GROUP BY 1),
m AS (SELECT query, name, count(*) AS n_both FROM a JOIN b USING (gene) GROUP BY 1, 2),
j AS (SELECT *, (SELECT count(*) FROM u) AS n_all, (SELECT count(*) FROM sb) AS tests FROM m JOIN sa USING (query) JOIN sb USING (name)),
t AS (SELECT j.*, x, {_ONE} AS d FROM j, range(0, 1000) r(x) WHERE x BETWEEN greatest(0, n_list + n_set - n_all) AND least(n_list, n_set)),
s AS (SELECT query, name, max(d) FILTER (x = n_both) AS seen FROM t GROUP BY 1, 2),
p AS (SELECT query, name, n_both, n_list, n_set, n_all, tests, least(1, sum(d) FILTER (x >= n_both)) AS p, least(1, coalesce(sum(d) FILTER (d <= seen * (1 + 1e-7)), 0)) AS p_two FROM t JOIN s USING (query, name) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(p, 10), name) AS r1, row_number() OVER (PARTITION BY query ORDER BY round(p_two, 10), name) AS r2 FROM p)
SELECT query, name, n_both, n_list, n_set, n_all, n_both * n_all < n_list * n_set AS depleted, round(p, 7) AS p, round(p_two, 7) AS p_two, round(least(1, min(p * tests / r1) OVER (PARTITION BY query ORDER BY r1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted, round(least(1, min(p_two * tests / r2) OVER (PARTITION BY query ORDER BY r2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_two_adjusted FROM r""")
def m45_enrichment(spark, d):
    k, lr = V.links(spark, d), V.lr(spark, d)
    universe = k.select(F.col("source").alias("gene")).union(k.select("target"))
    lists = k.join(lr.where("ord % 2 = 0"), F.col("source") == F.col("ligand")).where("coef_mean > -0.25").select(F.col("cluster").alias("query"), F.col("target").alias("gene"))
    sets = k.where("p < 0.5").select(F.col("source").alias("name"), F.col("target").alias("gene"))
    out = E.enrichment(lists, sets, universe)
    return rounded(rounded(out, "p", "p_two", digits=7), "p_adjusted", "p_two_adjusted")
