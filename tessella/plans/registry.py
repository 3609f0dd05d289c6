"""Registry of queries and their SQL, and what several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import spatial as P
from tessella.operators.permutation import PRIME, WALKS, replicates
from tessella.sources import views as V

RADIUS = 30.0
QUERIES: dict = {}
SQL: dict[str, str] = {}
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
NEAR = f"near AS (SELECT a.cell_id AS i, b.cell_id AS j, {D2} AS d2 FROM cells a JOIN cells b ON {D2} <= {RADIUS * RADIUS}e0)"
KERNEL = f"exp(-d2 / {2 * S.sigma(RADIUS) ** 2!r}e0)"
EDGES = NEAR + f",\nedges AS (SELECT i, j, {KERNEL} AS w FROM near WHERE i <> j)"
FOLDED = "folded AS (SELECT least(i, j) AS i, greatest(i, j) AS j, sum(w) AS w FROM edges GROUP BY 1, 2), twice AS (SELECT i, j, w FROM folded UNION ALL SELECT j, i, w FROM folded)"
PAIRS = "pairs AS (SELECT ligand AS g1, receptor AS g2 FROM lr UNION ALL SELECT ligand, ligand FROM lr)"
#: Keys of the permutations that queries and SQL share.
PLAN = replicates(3, seed=5)
#: Keys of as many as the reference makes for scores of pairs, and for zones (those of PLAN are the first).
PAIR_PLAN, ZONE_PLAN = replicates(1000, seed=5), replicates(100, seed=5)


def knn(k: int, with_self: bool = False, name: str = "knn") -> str:
    """The k nearest cells of each cell, as a common table expression (i, j, d2, rank)."""
    on = "ON true" if with_self else "ON a.cell_id <> b.cell_id"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM (SELECT a.cell_id AS i, b.cell_id AS j, {D2} AS d2 FROM cells a JOIN cells b {on}) q) r WHERE rank <= {k})"


def normal_sf(z: str) -> str:
    """The upper tail of the normal in SQL, by the approximation of ``scalars.normal_sf``."""
    x, c = f"(abs({z}) / sqrt(2.0e0))", S.ERFC
    t = f"(1 / (1 + 0.5e0 * {x}))"
    p = f"({c[-1]!r}e0)"
    for k in reversed(c[:-1]):
        p = f"({p} * {t} + ({k!r}e0))"
    tail = f"({t} * exp(-{x} * {x} + {p}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def bh(table: str, keys: str, tie: str, by: str = "", p: str = "p") -> str:
    """Benjamini-Hochberg in SQL: ``table`` (keys, p) as rows (keys, p, fdr)."""
    part = f"PARTITION BY {by}" if by else ""
    return f"(SELECT {keys}, {p}, least(1, min({p} * m / r) OVER ({part} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM (SELECT *, count(*) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY {p}, {tie}) AS r FROM {table}) q)"


def moved_place(place: str, n: str, turn: str = "0") -> str:
    """``permutation.moved_place`` in SQL, of a list ``keys``."""
    high = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    low = f"CAST(ceil({n} / {high}) AS BIGINT)"

    def made(half: str) -> str:
        y = f"(({half} + k // 2 + {turn}) % {PRIME})"
        return f"(({y} * {y} % {PRIME} * {y} + k // 2) % {PRIME})"

    one = f"CASE WHEN k % 2 = 0 THEN (x // {low} + {made(f'(x % {low})')}) % {high} * {low} + x % {low} ELSE x // {low} * {low} + (x % {low} + {made(f'(x // {low})')}) % {low} END"
    whole = lambda x: f"list_reduce(list_prepend({x}, keys), lambda x, k: {one})"
    return f"list_reduce(list_prepend({whole(f'CAST({place} AS BIGINT)')}, range(least({high} * {low} - {n} + 1, {WALKS}))), lambda q, _: CASE WHEN q < {n} THEN q ELSE {whole('q')} END)"


def uniform(*parts: str) -> str:
    """``neighbourhoods.uniform`` in SQL."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    c = V.cells(spark, d)
    return P.range_join(c, c, RADIUS).where("i <> j").select("i", "j", S.gaussian(F.col("d2"), RADIUS).alias("w"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    lr = V.lr(spark, d)
    return lr.select(F.col("ligand").alias("g1"), F.col("receptor").alias("g2")).union(lr.select("ligand", "ligand"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})
