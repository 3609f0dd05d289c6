"""Enrichment of gene sets against exact fractions."""

from fractions import Fraction
from math import comb, lgamma

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import enrichment as E

rng = np.random.default_rng(8)


def test_log_factorials(spark):
    n = [0, 1, 2, 7, 30, 1_000, 60_000, 10**9]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    for r in df.select("n", E.log_factorial(F.col("n")).alias("f")).collect():
        assert abs(r.f - lgamma(r.n + 1)) <= 1e-11 * max(1.0, lgamma(r.n + 1))


def test_p_values_equal_exact_fractions(spark):
    genes = [f"g{i}" for i in range(60)]
    sets = {f"s{k}": set(rng.choice(genes, rng.integers(1, 40), replace=False)) for k in range(12)} | {"all": set(genes), "apart": {"x1", "x2"}, "lone": {"g59"}}
    lists = {f"q{k}": set(rng.choice(genes[:50], rng.integers(1, 30), replace=False)) | {"x9"} for k in range(4)}
    a = spark.createDataFrame([(q, g) for q, v in lists.items() for g in v] + [("q0", None), ("q0", sorted(lists["q0"])[0])], "query string, gene string").repartition(3)
    b = spark.createDataFrame([(s, g) for s, v in sets.items() for g in v] + [("all", "g0")], "name string, gene string").repartition(3)
    u = spark.createDataFrame([(g,) for g in genes] + [("g0",), (None,)], "gene string")
    got = {(r["query"], r["name"]): r for r in E.enrichment(a, b, u).collect()}
    total, tests = len(genes), 14  # "apart" has no gene of the universe
    want = {}
    for q, x in lists.items():
        x = x & set(genes)
        for s, y in sets.items():
            y = y & set(genes)
            k, n, m = len(x & y), len(x), len(y)
            if k:
                p = {i: Fraction(comb(m, i) * comb(total - m, n - i), comb(total, n)) for i in range(max(0, n + m - total), min(n, m) + 1)}
                want[q, s] = (k, n, m, float(sum(v for i, v in p.items() if i >= k)), float(sum(v for v in p.values() if v <= p[k])), k * total < n * m)
    assert set(got) == set(want)
    for key, (k, n, m, p, two, depleted) in want.items():
        r = got[key]
        assert (r.n_both, r.n_list, r.n_set, r.n_all, r.depleted) == (k, n, m, total, depleted)
        assert abs(r.p - min(1, p)) < 1e-10 and abs(r.p_two - min(1, two)) < 1e-10
    for q in lists:
        ps = sorted((r.p, r["name"]) for (x, _), r in got.items() if x == q)
        best = 1.0
        for rank in range(len(ps), 0, -1):
            best = min(best, ps[rank - 1][0] * tests / rank)
            assert abs(got[q, ps[rank - 1][1]].p_adjusted - best) < 1e-10


def test_empty_tables(spark):
    a = spark.createDataFrame([], "query string, gene string")
    b = spark.createDataFrame([], "name string, gene string")
    assert E.enrichment(a, b, a.select("gene")).count() == 0
