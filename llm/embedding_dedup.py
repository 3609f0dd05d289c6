"""Embedding near-duplicates by an exact metric range join on unit vectors.

Equal vectors are one node from the start.  Sampled pivots partition the unit vectors into cells of the nearest pivot.  A vector
is also sent to a lower-numbered cell if it may lie within the radius of a vector there: by the triangle inequality
its distance to that pivot then is at most that to its own plus twice the radius, and its distance to the bisector of the two at
most the radius.  Each pair so meets in exactly one cell.  Cells join independently.  A cell of more rows than a chunk is a grid of
chunk pairs: a row goes to the pairs of its own chunk alone.  A chunk pair gives link counts and a spanning forest of its links, never
the pairs.  Vectors travel in the type of their column and are made unit vectors where they are compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; rows with the same id are rows of their own (and link if their vectors do); a null id takes part
but names no component, and its row is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.ann import by_dimension, sample_pivots, usable
from llm.common import Forest, checkpointed, connected_components

#: Rows of a cell that the number of pivots aims at, and rows of a chunk by number and by bytes.
CELL_ROWS = 8192
CHUNK_ROWS = 16_384
CHUNK_BYTES = 32 << 20
#: Rows and columns compared at once.
TILE = (1024, 8192)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _places(x: np.ndarray, pivots: np.ndarray | None, radius: float):
    """Home cell of each vector, and (row, cell) of the cells it is sent to as a guest."""
    if pivots is None:
        return np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    d2 = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = d2.argmin(1)
    own2 = d2[np.arange(len(x)), home][:, None]
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    eps = 1e-9
    send = (np.sqrt(d2) <= np.sqrt(own2) + 2 * radius + eps) & (d2 - own2 <= 2 * radius * between + eps) & (np.arange(len(pivots)) < home[:, None])
    row, cell = np.nonzero(send)
    return home, row, cell


def _counts(shared, radius):
    def run(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            for d, _, x in by_dimension(b.column("embedding")):
                home, _, cell = _places(_unit(x), shared.value.get(d), radius)
                for guest, c in ((0, home), (1, cell)):
                    for k, n in zip(*np.unique(c, return_counts=True)):
                        seen[d, int(k), guest] = seen.get((d, int(k), guest), 0) + int(n)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], ["dim", "cell", "guest", "n"])

    return run


def _deal(shared, radius, kind):
    """Each row goes to the chunk pairs of its cells: (dim, cell, home chunk, other chunk), other chunks of guests from 0 below: -1, -2, ..."""

    def run(batches):
        pivots, chunks = shared.value
        for b in batches:
            out: list[tuple] = []
            nodes, weights = b.column("node").to_numpy(), b.column("weight").to_numpy()
            for d, at, x in by_dimension(b.column("embedding")):
                node, weight = nodes[at], weights[at]
                home, row, cell = _places(_unit(x), pivots.get(d), radius)
                salt = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                for guest, rows, cells in ((0, np.arange(len(x)), home), (1, row, cell)):
                    for c in np.unique(cells).tolist():
                        mine = rows[cells == c]
                        homes, guests = chunks.get((d, c, 0), 0), chunks.get((d, c, 1), 0)
                        if not homes:
                            continue  # nobody lives there
                        part = salt[mine] % (guests if guest else homes)
                        for p in np.unique(part).tolist():
                            some = mine[part == p]
                            data = (node[some].tobytes(), weight[some].tobytes(), x[some].astype(kind).tobytes())
                            if guest:
                                units = [(i, -1 - p, 1) for i in range(homes)]
                            else:
                                units = [(min(i, p), max(i, p), int(i < p)) for i in range(homes)] + [(p, -1 - g, 0) for g in range(guests)]
                            out += [(d, c, *u, *data) for u in units]
            kinds = [pa.int32()] * 5 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["dim", "cell", "one", "two", "side", "nodes", "weights", "vectors"])

    return run


def _components(mask: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """The links of a tile as a spanning forest, breadth first by whole rows and columns."""
    rows = np.flatnonzero(mask.any(1))
    cols = np.flatnonzero(mask.any(0))
    mask = mask[np.ix_(rows, cols)]
    left, right = left[rows], right[cols]
    todo = np.ones(len(rows), bool)
    while todo.any():
        r = np.zeros(len(rows), bool)
        c = np.zeros(len(cols), bool)
        front = np.array([int(todo.argmax())])
        while len(front):
            r[front] = True
            fresh = np.flatnonzero(mask[front].any(0) & ~c)
            c[fresh] = True
            front = np.flatnonzero(mask[:, fresh].any(1) & ~r) if len(fresh) else fresh
        todo &= ~r
        member = np.unique(np.r_[left[r], right[c]]).tolist()
        for m in member[1:]:
            forest.union(member[0], m)


def _join(limit: float, kind):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, same = int(pdf["dim"].iat[0]), pdf["one"].iat[0] == pdf["two"].iat[0]

        def side(k):
            p = pdf[pdf["side"] == k]
            x = np.frombuffer(b"".join(p["vectors"]), kind).astype(np.float64).reshape(-1, d)
            return np.frombuffer(b"".join(p["nodes"]), np.int64), np.frombuffer(b"".join(p["weights"]), np.int64), _unit(x) if len(x) else x

        a, wa, x = side(0)
        b, wb, y = (a, wa, x) if same else side(1)
        one, two, forest = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), Forest()
        for i in range(0, len(a), TILE[0]):
            for j in range(0, len(b), TILE[1]):
                mask = x[i : i + TILE[0]] @ y[j : j + TILE[1]].T >= limit
                if same:
                    k = np.arange(max(i, j), min(i + TILE[0], j + TILE[1], len(a)))
                    mask[k - i, k - j] = False
                if mask.any():
                    one[i : i + TILE[0]] += mask @ wb[j : j + TILE[1]]
                    two[j : j + TILE[1]] += wa[i : i + TILE[0]] @ mask
                    _components(mask, a[i : i + TILE[0]], b[j : j + TILE[1]], forest)
        nodes = list(forest.up)
        links = [(a[one > 0], one[one > 0])] + ([] if same else [(b[two > 0], two[two > 0])])
        n = [len(nodes)] + [len(v) for v, _ in links]
        return pd.DataFrame({
            "node": np.concatenate([np.array(nodes, np.int64), *(v for v, _ in links)]),
            "root": pd.array([forest.find(v) for v in nodes] + [None] * (sum(n) - n[0]), "Int64"),
            "links": np.concatenate([np.zeros(n[0], np.int64), *(w for _, w in links)]),
        })

    return run


def embedding_dedup(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    sc = vectors.sparkSession.sparkContext
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("node", F.when(usable(), F.xxhash64("embedding")))
    base = rows.select("vec_id", "node")
    nodes = checkpointed(rows.where("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least")))
    held = nodes.select("node", "weight", "embedding")
    cells = {d: _unit(p) for d, p in sample_pivots(held, "node", CELL_ROWS).items()}
    radius = float(np.sqrt(2 - 2 * least))
    counts = held.mapInArrow(_counts(sc.broadcast(cells), radius), "dim int, cell int, guest int, n bigint").groupBy("dim", "cell", "guest").agg(F.sum("n").alias("n")).collect()
    chunks = {(r["dim"], r["cell"], r["guest"]): -(-r["n"] // max(256, min(CHUNK_ROWS, CHUNK_BYTES // (8 * r["dim"])))) for r in counts}
    dealt = held.mapInArrow(_deal(sc.broadcast((cells, chunks)), radius, kind), "dim int, cell int, one int, two int, side int, nodes binary, weights binary, vectors binary")
    found = checkpointed(dealt.groupBy("dim", "cell", "one", "two").applyInPandas(_join(least, kind), "node bigint, root bigint, links bigint"))
    links = found.where("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("root is not null").select("node", "root"))
    named = nodes.select("node", "weight", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = checkpointed(named.join(links, "node", "left"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = base.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
