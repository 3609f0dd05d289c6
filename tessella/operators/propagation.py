"""Changes that spread through a network inside each cell, in blocks of cells by genes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of a block of cells by genes.
BLOCK = 1 << 20


def _flat(b: pa.RecordBatch, gene: str, value: str):
    g, v = b.column(gene), b.column(value)
    at = np.repeat(np.arange(len(g)), pc.list_value_length(g).to_numpy(zero_copy_only=False))
    return at, g.flatten(), v.flatten().to_numpy(zero_copy_only=False).astype(float)


def _block(rows: int, width: int, at, gene, value):
    """Values dense, null as 0, and where a row and a known value are."""
    flat = at * width + gene
    seen, known, dense = np.zeros(rows * width, bool), np.zeros(rows * width, bool), np.zeros(rows * width)
    seen[flat], known[flat], dense[flat] = True, ~np.isnan(value), np.nan_to_num(value, nan=0.0, posinf=np.inf, neginf=-np.inf)
    return (a.reshape(rows, width) for a in (dense, seen, known))


def propagated(network, steps: int):
    """A function of batches (cell_id, hg, hv, bg, bv), given changes and expression: rows (cell_id, gene, d) after ``steps``."""

    def run(batches):
        net = network.value
        coef = net.column("coef").to_numpy(zero_copy_only=False).astype(float)
        ends = [net.column(c).to_pylist() for c in ("source", "target")]
        for b in batches:
            (ha, hg, hv), (ba, bg, bv) = _flat(b, "hg", "hv"), _flat(b, "bg", "bv")
            given = pc.unique(hg).to_pylist()
            names = list(dict.fromkeys([*given, *ends[1]]))  # all that can have a change
            number = {g: n for n, g in enumerate(names)}
            width = len(names)
            code = lambda g: (lambda d: np.array([number.get(n, -1) for n in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy(zero_copy_only=False)] if len(g) else np.zeros(0, np.int64))(g.dictionary_encode(null_encoding="encode"))
            hc, bc = code(hg), code(bg)
            ba, bc, bv = (x[bc >= 0] for x in (ba, bc, bv))
            used = [k for k, s in enumerate(ends[0]) if s in number]
            s, t, c = np.array([number[ends[0][k]] for k in used], np.int64), np.array([number[ends[1][k]] for k in used], np.int64), coef[used]
            order = np.argsort(t, kind="stable")
            s, t, c = s[order], t[order], c[order]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(t)]
            step = max(1, BLOCK // max(width, 1))
            for r in range(0, b.num_rows, step):
                n = min(step, b.num_rows - r)
                cutout = lambda a, *x: tuple(v[slice(*np.searchsorted(a, [r, r + n]))] - (r if k == 0 else 0) for k, v in enumerate((a, *x)))
                held, is_held, held_known = _block(n, width, *cutout(ha, hc, hv))
                base, _, _ = _block(n, width, *cutout(ba, bc, bv))
                now, seen, known = held, is_held, held_known
                for _ in range(steps):
                    moved, met, full = np.zeros((n, width)), np.zeros((n, width), bool), np.zeros((n, width), bool)
                    for a, e in zip(first.tolist(), last.tolist()):
                        src, good = s[a:e], ~np.isnan(c[a:e])
                        moved[:, t[a]] = np.where(known[:, src], now[:, src], 0.0) @ np.where(good, c[a:e], 0.0)
                        met[:, t[a]], full[:, t[a]] = seen[:, src].any(1), (known[:, src] & good).any(1)
                    d = np.where(held_known, held, moved)
                    seen = known = met | is_held
                    now = np.where(seen, np.where(held_known | full, np.maximum(d, -base), -base), 0.0)
                i, g = np.nonzero(seen)
                yield pa.RecordBatch.from_arrays([b.column("cell_id").take(pa.array(i + r)), pa.array(names, pa.string()).take(pa.array(g)), pa.array(now[i, g])], ["cell_id", "gene", "d"])

    return run
