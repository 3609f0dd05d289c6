"""Correlations of a cell's change with differences to its neighbours, from sparse vectors in arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cell's own vectors: numbers of genes and values, of expression and of change.
OWN = ["xg", "xv", "dg", "dv"]


def _entries(b: pa.RecordBatch, rows: np.ndarray, gene: str, value: str):
    """(place among ``rows``, gene, value) of the entries of two columns of arrays; a null value is not a number."""
    g, v = (b.column(c).take(pa.array(rows)) for c in (gene, value))
    at = np.repeat(np.arange(len(rows)), pc.list_value_length(g).fill_null(0).to_numpy(zero_copy_only=False))
    return at, g.flatten().to_numpy(zero_copy_only=False).astype(np.int64), v.flatten().to_numpy(zero_copy_only=False).astype(float)


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key asked for out of sorted ``keys``; 0 where it is absent or not a number."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, np.nan_to_num(values[at], nan=0.0, posinf=np.inf, neginf=-np.inf), 0.0)


class _Vectors:
    """Sparse vectors of some cells, sorted by cell and gene, and their sums; a null has no part in sums."""

    def __init__(self, at: np.ndarray, gene: np.ndarray, value: np.ndarray, rows: int, width: int):
        keys = at * width + gene
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.value, self.width = keys[order], at[order], value[order], width
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("a cell lists a gene twice")
        known = np.nan_to_num(self.value, nan=0.0, posinf=np.inf, neginf=-np.inf)
        self.one, self.two = (np.bincount(self.at, v, rows) for v in (known, known * known))

    def last(self, row: int):
        a, b = np.searchsorted(self.at, [row, row + 1])
        return self.keys[a:b] - row * self.width, self.value[a:b]


def correlated(columns: list[str], width: int, n_genes: int):
    """A function of batches sorted by i, a cell's own row (_side 0) before its edges (_side 1): the edges with r."""

    def run(batches):
        held = None  # the last cell of the batch before: its id and vectors
        for b in batches:
            ids, side = b.column("i").to_numpy(zero_copy_only=False), b.column("_side").to_numpy()
            mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            own_ids, own = ids[mine], {}
            for g, v in (("xg", "xv"), ("dg", "dv")):
                at, gene, value = _entries(b, mine, g, v)
                if held is not None:
                    before = held[1][g]
                    at, gene, value = np.r_[np.zeros(len(before[0]), np.int64), at + 1], np.r_[before[0], gene], np.r_[before[1], value]
                own[g] = _Vectors(at, gene, value, len(mine) + (held is not None), width)
            if held is not None:
                own_ids = np.r_[held[0], own_ids]
            if len(theirs):
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(theirs)) for c in columns], _r(b, ids, side, theirs, own_ids, own, held is not None, width, n_genes)], [*columns, "r"])
            if len(own_ids):
                held = own_ids[-1:], {g: v.last(len(own_ids) - 1) for g, v in own.items()}

    return run


def _r(b: pa.RecordBatch, ids, side, theirs, own_ids, own, before: bool, width: int, n: int) -> pa.Array:
    who = np.cumsum(side == 0)[theirs] - 1 + before
    found = who >= 0
    found[found] = own_ids[who[found]] == ids[theirs[found]]
    who = np.where(found, who, 0)
    x, d = own["xg"], own["dg"]
    of = lambda sums: np.where(found, sums[who], 0.0) if len(sums) else np.zeros(len(who))
    at, gene, y = _entries(b, theirs, "xg", "xv")
    known = ~np.isnan(y)
    at, gene, y = at[known], gene[known], y[known]
    asked = np.where(found[at], who[at] * width + gene, -1)
    total = lambda v: np.bincount(at, v, len(theirs))
    y1, y2, xy, dy = total(y), total(y * y), total(y * _looked_up(x.keys, x.value, asked)), total(y * _looked_up(d.keys, d.value, asked))
    x1, x2, d1, d2 = of(x.one), of(x.two), of(d.one), of(d.two)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        xd = of(np.bincount(d.at, d.value * _looked_up(x.keys, x.value, d.keys), len(own_ids)))
        odd = of(sum(np.bincount(v.at, np.isnan(v.value), len(own_ids)) for v in (x, d))) > 0  # a null of the cell's own leaves no correlation
        a1, a2, ab = y1 - x1, y2 + x2 - 2 * xy, dy - xd
        var = (n * a2 - a1 * a1) * (n * d2 - d1 * d1)
        r = (n * ab - a1 * d1) / np.sqrt(var)
    return pa.array(r, mask=odd | ~(var > 1e-9))
