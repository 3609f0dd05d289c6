"""Helpers shared by the operators: tables, checkpoints, bitmaps and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the bitmaps that are sent to all executors, as powers of two: a few kB to 16 MB, by the number of things in them.
LEAST_BITS, MOST_BITS = 16, 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  A local session, whose executors share
    the machine's disk, gets a folder of its own where none is named; a cluster without one is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def hashed_id(name: str = "doc_id"):
    """crc32 of the id as text, as a non-negative number; a null id counts as 'null'."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null")).cast("binary"))


def trim() -> None:
    """Give memory that an earlier task of this worker freed back to the system, before a large structure is built."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its allocator decides


def _frugal() -> None:
    """Large freed arrays and Arrow buffers of this process go back to the system, not to pools that keep them for later."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # blocks from 8 MB on are mapped one by one
        libc.mallopt(-1, 32 << 20)  # of the heap's free end, so much stays
        libc.mallopt(-8, 1)  # one arena
    except (OSError, AttributeError):
        pass  # another C library: its allocator decides


_frugal()  # in every worker, as each imports this module


#: What operators keep in a worker between the tasks of a query.
KEPT: list[dict] = []


def release() -> None:
    """Drop what other operators left in this worker, before a stage that needs the memory."""
    for kept in KEPT:
        kept.clear()
    trim()


# ---------------------------------------------------------------- bitmaps


def bits_for(things: int) -> int:
    """Bits (a power of two) of a bitmap of so many things: 16 or more for each, within the bounds; a fuller map only finds too much."""
    return min(MOST_BITS, max(LEAST_BITS, int(16 * things).bit_length()))


def bit_rows(hashes: np.ndarray, power: int) -> pa.RecordBatch:
    """Rows (word, bits) that together set the bit of every hash."""
    at = np.unique(hashes >> np.uint64(64 - power))
    word = (at >> np.uint64(6)).astype(np.int64)
    bits = np.uint64(1) << (at & np.uint64(63))
    if len(word):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        word, bits = word[first], np.bitwise_or.reduceat(bits, first)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits.view(np.int64), pa.int64())], ["word", "bits"])


def bitmaps(rows: DataFrame, power: int, levels: int = 1) -> list[np.ndarray]:
    """The bitmaps that rows (level, word, bits) make: at most one row a 64 bits and level comes to the driver."""
    t = rows.groupBy("level", "word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = [np.zeros(max(1, (1 << power) // 64), np.uint64) for _ in range(levels)]
    level, word, bits = t["level"].to_numpy(), t["word"].to_numpy(), t["bits"].to_numpy().view(np.uint64)
    for k, m in enumerate(out):
        m[word[level == k]] = bits[level == k]
    return out


def bitmap_of(hashes: DataFrame, power: int) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes."""

    def run(batches):
        for b in batches:
            yield bit_rows(b.column(0).to_numpy().view(np.uint64), power)

    return bitmaps(hashes.mapInArrow(run, "word bigint, bits bigint").withColumn("level", F.lit(0)), power)[0]


def filled(bits: np.ndarray) -> float:
    """The share of bits that are set."""
    return float(np.bitwise_count(bits).sum()) / (64 * len(bits))


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(64 * len(bits)).bit_length() + 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


# ---------------------------------------------------------------- connected components


class Forest:
    """Union-find over any integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        self.up.setdefault(x, x)
        return True


#: Nodes of a forest that a task holds before it passes the forest on.
FOREST_NODES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def out():
        nodes = [x for x in forest.up if forest.find(x) != x]
        edges = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["u", "v"])
        forest.up.clear()
        return edges

    for b in batches:
        for at in range(0, b.num_rows, 50_000):
            some = b.slice(at, 50_000)
            for x, y in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                forest.union(x, y)
            if len(forest.up) > FOREST_NODES:
                yield out()
    yield out()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two bigint columns); root is its component's smallest node.

    Each partition first shrinks its own edges to a forest; then alternating large-star and small-star steps
    (each a shuffled minimum and a join, no neighbour list is ever gathered) run until nothing changes.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_contract, "u bigint, v bigint").distinct()
    e = checkpointed(e)
    state = _state(e)
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e2 = large.join(small, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = checkpointed(e2.union(small.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.expr("bit_xor(xxhash64(u, v))")).first())
