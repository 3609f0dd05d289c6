"""Product codes of vectors: every part of a vector becomes the number of its nearest entry in that part's codebook.

Components become whole numbers, vectors are cut into equal parts.  Equal parts of a position are one row with a weight, so a
round's work is over distinct parts: tasks assign them to a codebook of a fixed size, which is sent to them, and return a
weighted sum an entry.  All arithmetic is in integers (or in doubles where every value is exact), so the order of tasks changes
nothing.  Codes and errors then go back to the vectors by a join on the part.  A part, or a label, that more than a thousandth of
the vectors share would be one task's work in that join: there are at most a thousand of these a position, and they are broadcast.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are vectors whose length is not
that of the smallest id's vector among those with a positive multiple of the number of parts; components beyond 2**24 after scaling
count as that bound; the first codebook goes by id, null ids last, then by vector, and is shorter where fewer vectors are kept; entries
that nothing is nearest to stay, ties go to the lower entry; repeated rows count as often as they come and each is a row of the
result; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest scaled component.
HELD = 1 << 24
#: Parts, and labels, of more than this share of the vectors are joined by broadcast; there are at most so many a position.
HEAVY = 1000
#: Distances computed at once.
BLOCK = 1 << 20


def whole_numbers(vectors: DataFrame, vector_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, ``v`` in whole numbers, written once; and the length of a vector."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    held = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(float(-HELD))), F.lit(float(HELD)))
    # (a null array fails the first condition; one without components fails the second)
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)).where(finite)
    rows = checkpointed(rows.select("vec_id", "label", F.transform(v, lambda x: F.floor(held(x)).cast("int")).alias("v")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    length = len(first[0].v) if first else 0
    return rows.where(F.size("v") == length), length


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``book`` for each row of ``v``, the lower of equal ones, and the squared distance; exact."""
    most = int(max(np.abs(v).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * v.shape[1] * most * most < 1 << 53 else np.int64
    b = book.astype(kind)
    squares, out, far, step = (b * b).sum(1), [], [], max(1, BLOCK // len(book))
    for k in range(0, len(v), step):
        a = v[k : k + step].astype(kind)
        d = squares - 2 * (a @ b.T)
        at = d.argmin(1)
        out.append(at)
        far.append(d[np.arange(len(at)), at] + (a * a).sum(1))
    return np.concatenate(out), np.concatenate(far).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _by_position(batch: pa.RecordBatch, width: int):
    position, v = batch.column("part").to_numpy(), _matrix(batch.column("v"), width)
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p)
        yield p, at, v[at]


def _sums(books, width: int):
    """Per task, position and entry: the weighted sum of the parts nearest to it, and their weight."""

    def run(batches):
        total = {p: np.zeros((len(b), width + 1), np.int64) for p, b in enumerate(books.value)}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, at, v in _by_position(batch, width):
                code, _ = nearest(v, books.value[p])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                rows = np.c_[v, np.ones(len(v), np.int64)][order] * weight[at][order, None]
                total[p][code[order][first]] += np.add.reduceat(rows, first)
        for p, t in total.items():
            used = np.flatnonzero(t[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(list(t[used, :-1]), pa.list_(pa.int64())), pa.array(t[used, -1])], ["part", "entry", "sums", "n"])

    return run


def _codes(books, width: int):
    def run(batches):
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, at, v in _by_position(batch, width):
                code[at], error[at] = nearest(v, books.value[p])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("v"), pa.array(code, pa.int32()), pa.array(error)], ["part", "v", "code", "error"])

    return run


def lloyd(weighted: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds over (part, v, weight); an entry becomes the floored mean of its parts.

    What comes to the driver in a round is one row an entry.
    """
    width = books[0].shape[1]
    for _ in range(rounds):
        shared = weighted.sparkSession.sparkContext.broadcast(books)
        sums = weighted.mapInArrow(_sums(shared, width), "part int, entry int, sums array<bigint>, n bigint")
        found = sums.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("n").alias("n")).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
        shared.unpersist()
    return books


def joined(rows: DataFrame, table: DataFrame, heavy: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of rows joined with ``table`` (a row a key, nulls equal); the rows of ``heavy``, at most some thousand, are sent round instead."""
    key = lambda t: [F.col(f"r.{k}").eqNullSafe(F.col(f"{t}.{k}")) for k in on]
    marked = rows.alias("r").join(F.broadcast(heavy.withColumn("_found", F.lit(True))).alias("t"), key("t"), "left")
    done = marked.where("_found").select(*columns)
    rest = marked.where("_found is null").select("r.*").alias("r")
    return done.union(rest.join(table.alias("t"), key("t")).select(*columns))


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each vector kept; at most 256 entries."""
    kept, length = whole_numbers(vectors, vector_col, parts, scale)
    if not length:
        return vectors.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = length // parts
    start = np.array([r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    books = [np.ascontiguousarray(start[:, p * width : (p + 1) * width]) for p in range(parts)]

    # rows are numbered where they were written, so that a part finds its row again
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.slice("v", p * width + 1, width).alias("v"))))
    placed = kept.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", cut.alias("p")).select("row", "vec_id", "label", "p.part", "p.v")
    weighted = checkpointed(placed.groupBy("part", "v").agg(F.count("*").alias("weight")))
    books = lloyd(weighted, books, rounds)

    shared = kept.sparkSession.sparkContext.broadcast(books)
    code = lambda rows: rows.mapInArrow(_codes(shared, width), "part int, v array<int>, code int, error bigint")
    n = weighted.where("part = 0").agg(F.sum("weight")).first()[0]
    many = F.col("weight") > max(1, n // HEAVY)
    met = joined(placed, code(weighted.where(~many)), code(weighted.where(many)), ["part", "v"], ["row", "vec_id", "label", "r.part", "code", "t.error"])
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("code"))))), 2, "0") for p in range(parts)]
    rows = checkpointed(met.groupBy("row", "vec_id", "label").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error")))
    totals = checkpointed(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    many = F.col("n") > max(1, n // HEAVY)
    out = joined(rows, totals.where(~many), totals.where(many), ["label"], ["vec_id", "code", "error", "label_error"])
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows by SQL, a pair of tables a round."""
    ctes = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, (c - 1) // (len(v) // {parts}) AS part, (c - 1) % (len(v) // {parts}) AS i, v[c] AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS c FROM k) q)",
        f"b0 AS MATERIALIZED (SELECT part, entry, i, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) s USING (r))",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'entry': entry}}) AS m FROM (SELECT r, p.part, entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d FROM p JOIN b{k} b ON p.part = b.part AND p.i = b.i GROUP BY 1, 2, 3) q GROUP BY 1, 2)")
        if k < rounds:
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, i, coalesce(mean, x) AS x FROM b{k} LEFT JOIN (SELECT part, m.entry AS entry, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM p JOIN a{k} USING (r, part) GROUP BY 1, 2, 3) n USING (part, entry, i))")
    ctes.append(f"e AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN e USING (r)"


SQL = sql()
