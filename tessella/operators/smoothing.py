"""Smoothing of counts over neighbours that are found again with more of them.

A cell is one row with the positions and values of its genes, from the first step to the last: a neighbour sends one row, and sums are made
where a cell's neighbours have met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import cut, if_small, numbered
from tessella.operators.components import packed_rows, row_components
from tessella.operators.metric import neighbours
from tessella.operators.neighbourhoods import uniform

#: Numbers of a table of cells by genes in which sums are made, at most (one cell's beyond it).
HELD = 1_000_000


def median(rows: DataFrame, value: str, key: str) -> float | None:
    """The exact median of a column, nulls left out; rows are dealt by ranges, two of them come to the driver."""
    v = rows.where(F.col(value).isNotNull())
    n = v.count()
    if not n:
        return None
    mid = numbered(v.select(value, key), [value, key], "at").where(F.col("at").isin((n - 1) // 2, n // 2)).agg(F.avg(value)).first()[0]
    return float(mid)


def freeman_tukey(rows: DataFrame, middle: float) -> DataFrame:
    """sqrt(x) + sqrt(x + 1) - 1 of packed counts scaled to the total ``middle``; absent counts stay absent, as they give 0.

    A cell without counts has none, before and after.
    """
    scaled = F.transform("x", lambda x: x * F.lit(middle) / F.col("total"))
    kept = rows.withColumn("total", _total()).withColumn("x", F.transform(scaled, lambda x: F.sqrt(x) + F.sqrt(x + 1) - 1))
    some = lambda c: F.when(F.col("total") > 0, F.col(c)).otherwise(F.array().cast(dict(kept.dtypes)[c])).alias(c)
    return kept.select("cell_id", some("at"), some("x"))


def _total():
    return F.aggregate("x", F.lit(0.0), lambda a, b: a + b)


def _sums(p: int):
    """Rows (cell_id, at, x) with the sums of the packed rows of one ``i``; rows come in the order of ``i``, and each i's end is awaited."""

    def add(b: pa.RecordBatch):
        i = b.column("i").to_numpy()
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        ends, last = b.column("at").offsets.to_numpy().astype(np.int64), np.r_[first[1:], len(i)]
        at, x = b.column("at").values.to_numpy(), b.column("x").values.to_numpy()
        shift = b.column("x").offsets.to_numpy()[0] - ends[0]
        step = max(1, HELD // p)
        for k in range(0, len(first), step):
            a, z = first[k], last[min(k + step, len(first)) - 1]
            own = np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
            own = (np.searchsorted(first[k : k + step], np.arange(a, z), "right") - 1)[own]
            n = len(first[k : k + step])
            code = own * p + at[ends[a] : ends[z]]
            found = np.flatnonzero(np.bincount(code, minlength=n * p))
            sums = np.bincount(code, x[shift + ends[a] : shift + ends[z]], n * p)[found]
            cut_at = pa.array(np.r_[0, np.cumsum(np.bincount(found // p, minlength=n))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut_at, v) for v in (pa.array((found % p).astype(np.int32)), pa.array(sums))]
            yield pa.RecordBatch.from_arrays([pa.array(i[first[k : k + step]]), *lists], ["cell_id", "at", "x"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            i = b.column("i").to_numpy()
            begin = int(np.searchsorted(i, i[-1]))
            rest = b.slice(begin)
            if begin:
                yield from add(b.slice(0, begin))
        if rest is not None:
            yield from add(rest)

    return run


def dithered(pcs: DataFrame, d: int, share: float, *seed: int) -> DataFrame:
    """(cell_id, v): coordinates moved by up to half a share of each one's range, by a hash of seed, coordinate and cell."""
    span = pcs.agg(*[(F.max(F.col("pcs")[c]) - F.min(F.col("pcs")[c])).alias(str(c)) for c in range(d)]).first()
    moved = [F.col("pcs")[c] + (uniform(*map(F.lit, (*seed, c)), "cell_id") - 0.5) * (span[c] * share) for c in range(d)]
    return pcs.select("cell_id", F.array(*moved).alias("v"))


def smooth_by_doubling(values: DataFrame, cells: DataFrame, k: int = 32, d: int = 10, dither: float = 0.03, seed: int = 0) -> DataFrame:
    """(cell_id, gene, value): sums of raw counts over the k nearest cells, itself included.

    Neighbours are sought in ``d`` components of what is smoothed so far, first two of them, then twice as many until there are k.  Null
    counts are absent; of cells with equal id one counts; fewer than k cells are all summed; k of 1 changes nothing.
    """
    raw = cut(values.where("value is not null").groupBy("cell_id", "gene").agg(F.sum("value").cast("double").alias("value")))
    own, genes, p = packed_rows(raw, cells)
    now, have, step = None, 1, 0

    def counts() -> DataFrame:
        if now is None:
            return raw
        rows = now.select("cell_id", F.explode(F.arrays_zip("at", "x")).alias("e")).select("cell_id", "e.at", F.col("e.x").alias("value"))
        return rows.join(if_small(genes), "at").select("cell_id", "gene", "value")

    while have < k:
        have, step = min(2 * have, k), step + 1
        total = raw.groupBy("cell_id").agg(F.sum("value").alias("total")) if now is None else now.select("cell_id", _total().alias("total"))
        middle = median(cut(total.where("total > 0")), "total", "cell_id")
        if middle is None:
            return counts()
        pcs, _, share = row_components(cut(freeman_tukey(own if now is None else now, middle)), p, d)
        n = len(share)
        if not n:
            return counts()  # cells that are all alike have no nearest ones
        pcs = cut(pcs)
        v = dithered(pcs, n, dither, seed, step) if dither else pcs.select("cell_id", F.col("pcs").alias("v"))
        near = neighbours(v, have, with_self=True).select("i", F.col("j").alias("cell_id"))
        met = near.join(own, "cell_id").select("i", "at", "x").repartition("i").sortWithinPartitions("i")
        now = cut(met.mapInArrow(_sums(p), "cell_id bigint, at array<int>, x array<double>"))
    return counts()
