"""Nearest points on the plane, searched square by square in blocks of numpy.

Some squares by some squares are a tile.  A tile's places that ask come first, dealt into parts of ``HELD``; the points of the tile and of the squares
around it follow as a sorted stream, of which ``POINTS`` are looked at together with the nearest found so far.  So a task holds a part
and a few thousand points, however crowded a tile is, and what is shuffled is a row a place and little more than a row a point and part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of a part, points looked at together, pairs of both at once, and about so many points of a tile.
HELD, POINTS, PAIRS, TILE = 4096, 8192, 1 << 20, 4096


class _Asked:
    """Places of a part of a tile, and the nearest points of each as far as seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, side: float, need: int):
        self.x, self.y, self.side, self.need = x, y, side, need
        self.squares, back = np.unique(np.stack([np.floor(x / side), np.floor(y / side)], 1), axis=0, return_inverse=True)
        self.back = back.ravel()
        self.who, self.d2, self.j = np.zeros(0, np.int64), np.zeros(0), None
        self.worst = np.full(len(x), math.inf)

    def _keep(self, new: list):
        """Of what was found and of ``new``, (place, d2, j), the nearest of each place; then where the last of them lies."""
        who, d2, j = (np.concatenate(c) for c in zip(*([(self.who, self.d2, self.j)] if self.j is not None else []), *new))
        order = np.lexsort((j, d2, who))
        who, d2, j = who[order], d2[order], j[order]
        count = np.bincount(who, minlength=len(self.x))
        begin = np.cumsum(count) - count
        keep = np.arange(len(who)) - begin[who] < self.need
        full = np.flatnonzero(count >= self.need)
        self.worst[full] = d2[begin[full] + self.need - 1]
        self.who, self.d2, self.j = who[keep], d2[keep], j[keep]

    def add(self, x: np.ndarray, y: np.ndarray, j: np.ndarray):
        """Meets points with the places of the 3 x 3 squares around theirs, those of the same square first: they leave few others to be near enough."""
        gx, gy = np.floor(x / self.side), np.floor(y / self.side)
        order = np.lexsort((gy, gx))
        x, y, j, gx, gy = x[order], y[order], j[order], gx[order], gy[order]
        begin = np.flatnonzero(np.r_[True, (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1])])
        size = np.diff(np.r_[begin, len(x)])
        number = {s: n for n, s in enumerate(zip(gx[begin].tolist(), gy[begin].tolist()))}
        new, pairs = [], 0
        for ax, ay in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)):
            at = np.array([number.get((a + ax, b + ay), -1) for a, b in self.squares.tolist()], np.int64)[self.back]
            asks = np.flatnonzero(at >= 0)
            stop, a = np.cumsum(size[at[asks]]), 0
            while a < len(asks):  # some places at a time
                b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + PAIRS, "right")))
                some = asks[a:b]
                n = size[at[some]]
                p = np.repeat(begin[at[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q = np.repeat(some, n)
                d2, dy = self.x[q] - x[p], self.y[q] - y[p]
                d2 = d2 * d2 + dy * dy
                near = d2 <= self.worst[q]
                new.append((q[near], d2[near], j[p[near]]))
                pairs, a = pairs + len(new[-1][0]), b
                if pairs > PAIRS:
                    self._keep(new)
                    new, pairs = [], 0
            if new and ax == ay == 0:
                self._keep(new)
                new, pairs = [], 0
        if new:
            self._keep(new)

    def out(self, last: bool, kind: pa.DataType) -> pa.RecordBatch:
        """Each place with its nearest, or with null where something nearer can lie beyond the squares."""
        count = np.bincount(self.who, minlength=len(self.x))
        sure = np.full(len(self.x), True) if last else self.worst < self.side * self.side
        keep = sure[self.who]
        j = pa.array([], kind) if self.j is None else pa.array(self.j[keep], kind)
        entries = pa.StructArray.from_arrays([pa.array(self.d2[keep]), j], ["d2", "j"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(sure, count, 0))], pa.int32()), entries, mask=pa.array(~sure))
        return pa.RecordBatch.from_arrays([pa.array(self.x), pa.array(self.y), lists], ["x", "y", "near"])


def _searched(side: float, need: int, last: bool):
    def run(batches):
        key, part, mine, held, kind = None, None, [], [], None

        def met():
            nonlocal held
            if held and part is not None:
                part.add(*(np.concatenate(c) for c in zip(*held)))
            held = []

        def started():
            x, y = (np.concatenate(c) for c in zip(*mine))
            return _Asked(x, y, side, need)

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("tx", "ty", "part", "side")], 1)
            kind = b.schema.field("j").type
            x, y, j = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "j"))
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, e in zip(ends, ends[1:]):
                if a == e:
                    continue
                here = tuple(keys[a, :3].tolist())
                if here != key:
                    if mine:
                        part = part or started()
                        met()
                        yield part.out(last, kind)
                    key, part, mine, held = here, None, [], []
                if keys[a, 3] == 0:
                    mine.append((x[a:e], y[a:e]))
                elif mine:
                    part = part or started()
                    held.append((x[a:e], y[a:e], j[a:e]))
                    if sum(len(h[0]) for h in held) >= POINTS:
                        met()
        if mine:
            part = part or started()
            met()
            yield part.out(last, kind)

    return run


def square_search(asked: DataFrame, points: DataFrame, side: float, need: int, last: bool) -> DataFrame:
    """(x, y, near): for each place (x, y) of ``asked`` its ``need`` nearest points (x, y, j) as an array of (d2, j) in that order, out of the 3 x 3
    squares around its own; null where that is not certain to hold them, unless ``last``."""
    spark, kind = asked.sparkSession, points.schema["j"].dataType
    wide = max(1, math.isqrt(TILE // (2 * need)))
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    tile = lambda c: F.floor(c / wide).cast("long")
    a = asked.select("x", "y", tile(square("x")).alias("tx"), tile(square("y")).alias("ty"))
    parts = a.groupBy("tx", "ty").agg(F.ceil(F.count("*") / HELD).cast("int").alias("_parts"))
    a = a.join(parts, ["tx", "ty"]).select("tx", "ty", F.pmod(F.xxhash64("x", "y"), F.col("_parts")).cast("int").alias("part"), F.lit(0).alias("side"), "x", "y", F.lit(0).cast(kind).alias("j"))
    around = lambda c: F.explode(F.array_distinct(F.array(*[tile(square(c) + s) for s in (-1, 0, 1)])))
    b = points.select("x", "y", "j", around("x").alias("tx")).withColumn("ty", around("y"))
    b = b.join(parts, ["tx", "ty"]).select("tx", "ty", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(1).alias("side"), "x", "y", "j")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = a.unionByName(b).repartition(tasks, "tx", "ty", "part").sortWithinPartitions("tx", "ty", "part", "side")
    near = T.ArrayType(T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("j", kind)]))
    return both.mapInArrow(_searched(side, need, last), T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("near", near)]))
