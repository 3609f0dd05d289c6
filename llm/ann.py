"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Adding one coordinate that gives all vectors the same norm turns the largest inner product into the smallest Euclidean distance, where
the triangle inequality holds.  Sampled pivots deal the vectors to cells of the nearest pivot; a cell is one shard or, where it is
crowded, several by a hash of the id, and each shard becomes a vantage-point tree.  A query first searches the cell of its own
nearest pivot.  Its k-th distance there then decides which other cells it is sent to, and how deep it goes in their trees: a cell or a
subtree is skipped when ``factor`` times its lower bound exceeds that distance.  Factor 1 is exact, larger factors skip more.

Defined cases: rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do
rows with a null id; of several rows with one id the one with the least vector counts; vectors meet only vectors of their own
length; equal scores go to the smaller id, however many tie; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import checkpointed

#: Vectors of a shard, by number and by bytes.
SHARD_ROWS = 16_384
SHARD_BYTES = 32 << 20
#: Pivots, by number and by bytes, as they are broadcast.
MOST_PIVOTS = 4096
PIVOT_BYTES = 16 << 20
BLOCK_QUERIES = 2048
LEAF = 128
FACTOR = 1.1


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, vectors in double precision) of a list column without nulls, a thousand vectors at a time."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        same = np.flatnonzero(size == d)
        for at in np.split(same, range(1024, len(same), 1024)):
            yield d, at, np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), d)


def sample_pivots(vectors: DataFrame, key: str, per_pivot: int) -> dict[int, np.ndarray]:
    """Distinct vectors by dimension, about one for ``per_pivot`` rows; they decide only how the work is cut."""
    sizes = {r["d"]: r["n"] for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    want = min(MOST_PIVOTS, PIVOT_BYTES // (8 * max(sizes, default=1)), sum(sizes.values()) // per_pivot)
    if want < 2:
        return {}
    out: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64(F.lit(3), key)).limit(want).select("embedding").collect():
        out.setdefault(len(r[0]), []).append(np.array(r[0], np.float64))
    return {d: np.unique(np.stack(v), axis=0) for d, v in out.items()}


class VPTree:
    """Distinct points in leaves of ``order``; inner nodes hold a vantage point and the distance range of each half."""

    def __init__(self, points: np.ndarray, least: np.ndarray, leaf: int = LEAF) -> None:
        self.norm2 = float((points**2).sum(1).max()) if len(points) else 0.0
        self.points, self.least = points, least
        self.lift = np.sqrt(np.maximum(self.norm2 - (points**2).sum(1), 0))
        order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self._build(order, 0, len(points), leaf)
        self.order = order

    def _distances(self, i: int, to: np.ndarray) -> np.ndarray:
        inner = self.points[to] @ self.points[i] + self.lift[to] * self.lift[i]
        return np.sqrt(np.maximum(2 * self.norm2 - 2 * inner, 0))

    def _build(self, order: np.ndarray, a: int, b: int, leaf: int) -> int:
        at = len(self.nodes)
        if b - a <= leaf:
            self.nodes.append((a, b))
            return at
        self.nodes.append(())
        # the point farthest from the first one sees the others from the side
        far = int(order[a:b][self._distances(int(order[a]), order[a:b]).argmax()])
        d = self._distances(far, order[a:b])
        by = np.argsort(d, kind="stable")
        order[a:b], d = order[a:b][by], d[by]
        mid = (b - a) // 2  # by rank, so equal distances split too
        inner = self._build(order, a, a + mid, leaf)
        outer = self._build(order, a + mid, b, leaf)
        self.nodes[at] = (far, (float(d[0]), float(d[mid - 1]), inner), (float(d[mid]), float(d[-1]), outer))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and points (-1: none) of up to k per query, by score and then least member; ``bound`` are scores already reached."""
        m = len(queries)
        best, which = np.full((m, k), -np.inf), np.full((m, k), -1, np.int64)
        floor = np.full(m, -np.inf) if bound is None else bound.astype(float)
        size2 = (queries**2).sum(1)
        base = size2 + self.norm2
        # what rounding may move a product or a distance by
        slip = 1e-12 * (np.sqrt(size2 * self.norm2) + 1e-300)
        far_slip = 1e-7 * np.maximum(1.0, np.sqrt(base))
        flat, least = self.points[self.order], self.least[self.order]

        def visit(node: int, q: np.ndarray) -> None:
            entry = self.nodes[node]
            if len(entry) == 2:
                a, b = entry
                row, col = np.nonzero(queries[q] @ flat[a:b].T >= (np.maximum(floor[q], best[q, -1]) - slip[q])[:, None])
                if not len(row):
                    return
                score = (flat[a + col] * queries[q[row]]).sum(1)  # summed alike wherever the vector stands
                rows = np.unique(row)
                old_r, old_c = np.nonzero(which[q[rows]] >= 0)
                r = np.r_[row, rows[old_r]]
                s = np.r_[score, best[q[rows]][old_r, old_c]]
                p = np.r_[self.order[a + col], which[q[rows]][old_r, old_c]]
                o = np.lexsort((self.least[p], -s, r))
                r, s, p = r[o], s[o], p[o]
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
                kept = place < k
                best[q[r[kept]], place[kept]] = s[kept]
                which[q[r[kept]], place[kept]] = p[kept]
                return
            far, inner, outer = entry
            d = np.sqrt(np.maximum(base[q] - 2 * (queries[q] @ self.points[far]), 0))
            near = d <= (inner[1] + outer[0]) / 2
            for some, halves in ((near, (inner, outer)), (~near, (outer, inner))):
                if not some.any():
                    continue
                for lo, hi, child in halves:
                    lower = np.maximum(np.maximum(d[some] - hi, lo - d[some]), 0)
                    mine = q[some]
                    reach = np.sqrt(np.maximum(base[mine] - 2 * np.maximum(floor[mine], best[mine, -1]), 0))
                    go = lower * factor <= reach + far_slip[mine]
                    if go.any():
                        visit(child, mine[go])

        if len(self.points) and m:
            visit(0, np.arange(m))
        return best, which


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def _norms(batches):
    for b in batches:
        for d, at, x in by_dimension(b.column("embedding")):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([float((x**2).sum(1).max())])], ["dim", "norm2"])


def _homes(shared):
    """Each vector with its dimension, its cell and its lifted distance to the cell's pivot."""

    def run(batches):
        pivots, norm2 = shared.value
        for b in batches:
            for d, at, x in by_dimension(b.column("embedding")):
                cell, dist = np.zeros(len(at), np.int32), np.zeros(len(at))
                if d in pivots:
                    p, r2 = pivots[d], norm2[d]
                    lift = lambda v: np.sqrt(np.maximum(r2 - (v**2).sum(1), 0))
                    inner = x @ p.T + np.outer(lift(x), lift(p))
                    cell = inner.argmax(1).astype(np.int32)
                    dist = np.sqrt(np.maximum(2 * r2 - 2 * inner[np.arange(len(at)), cell], 0))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), b.column("embedding").take(pa.array(at)), pa.array([d] * len(at), pa.int32()), pa.array(cell), pa.array(dist)], ["vec_id", "embedding", "dim", "cell", "dist"])

    return run


def _build(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stack(pdf["embedding"]), pdf["vec_id"].to_numpy()
        points, owner = np.unique(x, axis=0, return_inverse=True)
        owner = owner.ravel()
        by = np.lexsort((ids, owner))
        cut = np.flatnonzero(np.r_[True, owner[by][1:] != owner[by][:-1]])
        members = [m[: k + 1] for m in np.split(ids[by], cut[1:])]  # the smallest ids of each distinct vector
        tree = VPTree(points, ids[by][cut])
        return pd.DataFrame({c: [pdf[c].iat[0]] for c in ("dim", "cell", "sub")} | {"tree": [pickle.dumps((tree, members))]})

    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({c: [pdf[c].iat[0]] for c in ("dim", "cell", "block")} | {"queries": [pickle.dumps((pdf["vec_id"].to_numpy(), _stack(pdf["embedding"]), pdf["bound"].to_numpy(float)))]})


def _search(k: int, factor: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tree, queries in zip(f["tree"], f["queries"]):
                (tree, members), (qid, q, bound) = pickle.loads(tree), pickle.loads(queries)
                best, which = tree.search(q, k + 1, factor, bound)  # one more, as one may be the query's own
                out = []
                for i, own in enumerate(qid.tolist()):
                    found = [(-s, int(m)) for s, p in zip(best[i].tolist(), which[i].tolist()) if p >= 0 for m in members[p] if m != own]
                    found.sort()
                    out += [(own, m, -s) for s, m in found[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _targets(shared, factor: float, first: bool):
    """Rows (vec_id, embedding, bound) once for each cell they are sent to: the nearest first, or all others in reach."""

    def run(batches):
        pivots, norm2, cells = shared.value
        for b in batches:
            bound = b.column("bound").to_numpy(zero_copy_only=False)
            for d, at, x in by_dimension(b.column("embedding")):
                if d not in norm2:
                    continue  # no vector of this length
                if d not in pivots:
                    row, cell = (np.arange(len(at)), np.zeros(len(at), np.int64)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                else:
                    base = (x**2).sum(1) + norm2[d]
                    dist = np.sqrt(np.maximum(base[:, None] - 2 * (x @ pivots[d].T), 0))
                    held = np.zeros(len(pivots[d]), bool)
                    lo, hi = np.zeros(len(held)), np.zeros(len(held))
                    for c, (_, low, high) in cells[d].items():
                        held[c], lo[c], hi[c] = True, low, high
                    home = np.where(held, dist, np.inf).argmin(1)
                    if first:
                        row, cell = np.arange(len(at)), home
                    else:
                        reach = np.sqrt(np.maximum(base - 2 * bound[at], 0)) + 1e-7 * np.maximum(1.0, np.sqrt(base))
                        lower = np.maximum(np.maximum(dist - hi, lo - dist), 0)
                        row, cell = np.nonzero(held & (lower * factor <= reach[:, None]) & (np.arange(len(held)) != home[:, None]))
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("embedding").take(take), b.column("bound").take(take), pa.array([d] * len(row), pa.int32()), pa.array(cell.astype(np.int32))], ["vec_id", "embedding", "bound", "dim", "cell"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``vectors`` of largest inner product, without the query's own id."""
    sc = vectors.sparkSession.sparkContext
    kind = vectors.schema[vector_col].dataType.simpleString()

    def pick(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
        return checkpointed(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))

    points, asked = pick(vectors), pick(queries)
    norm2 = {r["dim"]: r["m"] for r in points.mapInArrow(_norms, "dim int, norm2 double").groupBy("dim").agg(F.max("norm2").alias("m")).collect()}
    most = max(256, min(SHARD_ROWS, SHARD_BYTES // (8 * max(norm2, default=1))))
    pivots = sample_pivots(points, "vec_id", most)
    cols = f"vec_id bigint, embedding {kind}"
    homes = checkpointed(points.mapInArrow(_homes(sc.broadcast((pivots, norm2))), f"{cols}, dim int, cell int, dist double"))
    # one row a cell: (shards, least and most distance to the pivot)
    cells: dict[int, dict] = {}
    for r in homes.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect():
        cells.setdefault(r["dim"], {})[r["cell"]] = (-(-r["n"] // most), r["lo"], r["hi"])
    shards = vectors.sparkSession.createDataFrame([(d, c, s) for d, m in cells.items() for c, (s, _, _) in m.items()], "dim int, cell int, shards int")
    dealt = homes.join(F.broadcast(shards), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    trees = checkpointed(dealt.groupBy("dim", "cell", "sub").applyInPandas(_build(k), "dim int, cell int, sub int, tree binary"))
    shared = sc.broadcast((pivots, norm2, cells))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def search(rows: DataFrame, first: bool) -> DataFrame:
        sent = rows.mapInArrow(_targets(shared, factor, first), f"{cols}, bound double, dim int, cell int")
        sent = sent.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int"))
        packed = sent.groupBy("dim", "cell", "block").applyInPandas(_pack, "dim int, cell int, block int, queries binary")
        packed = packed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return trees.join(packed, ["dim", "cell", "sub"]).select("tree", "queries").mapInPandas(_search(k, factor), "query_id bigint, vec_id bigint, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = search(asked.withColumn("bound", F.lit(float("-inf"))), True)
    if any(len(m) > 1 for m in cells.values()):
        found = checkpointed(top(found)).drop("rank")
        reached = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
        found = found.unionByName(search(asked.join(reached, "vec_id", "left").fillna(float("-inf"), ["bound"]), False))
    return top(found).select("query_id", "rank", "vec_id", "score")
