"""Scores of replicates by places against rows of permuted cells, and how many replicates queries ask for."""

import numpy as np

from tessella.operators import permutation as M
from tessella.operators.replicates import Moves
from tessella.plans.queries import oracle_sql
from tessella.plans.registry import PAIR_PLAN, PLAN

R = 8.0


def test_moves_are_the_bijections_of_the_keys():
    plan = M.replicates(7, seed=5)
    for n in (1, 2, 3, 7, 100, 1501):
        place = np.arange(n)
        want = np.stack([M.moved_places(place, n, keys, np.zeros(n, np.int64)) for keys in plan])
        assert (Moves(n, plan).to(place, 0, 7) == want).all() and (Moves(n, plan).to(place, 2, 5) == want[2:5]).all()


def test_pair_queries_make_as_many_replicates_as_the_reference():
    assert len(PAIR_PLAN) == 1000 and PAIR_PLAN[: len(PLAN)] == PLAN
    for name in ("m35_pair_significance", "m35_label_significance"):
        assert "1001.0e0" in oracle_sql()[name] and f"(999, {PAIR_PLAN[999]})" in oracle_sql()[name]


def _tables(spark):
    rng = np.random.default_rng(11)
    cells = [(i, None if i % 17 == 3 else "abc"[i % 3], None if i == 4 else float(rng.uniform(0, 40)), float(rng.uniform(0, 40))) for i in range(90)]
    expr = [(i, f"g{g}", None if i == 8 else float(rng.integers(0, 9))) for i in range(90) for g in range(4) if (i * 7 + g) % 3]
    pairs = [("g0", "g1"), ("g0", "g0"), ("g2", "g1"), ("g3", "g3"), ("g1", "g0")]
    return spark.createDataFrame(cells, "cell_id long, cell_type string, x double, y double"), spark.createDataFrame(expr, "cell_id long, gene string, value double"), spark.createDataFrame(pairs, "g1 string, g2 string")


def test_planned_significance_is_that_of_permuted_rows(spark):
    cells, expr, pairs = _tables(spark)
    plan = M.replicates(19, seed=2)
    perm = M.permutations(cells, plan)
    rows = lambda df: sorted((tuple(str(v) for v in r[:-2]), round(r.c, 9), round(r.p, 9)) for r in df.collect())
    got = rows(M.planned_pair_significance(cells, expr, pairs, plan, R))
    assert got == rows(M.near_pair_significance(cells, expr, pairs, perm, 19, R)) and len({p for *_, p in got}) > 2
    got = rows(M.planned_label_significance(cells, expr, pairs, plan, R))
    assert got == rows(M.near_label_significance(cells, expr, pairs, perm, 19, R)) and len({p for *_, p in got}) > 3
