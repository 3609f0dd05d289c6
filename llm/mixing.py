"""Mixing sources to target weights.

A document's size is its number of words.  Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share a
multiple of all words by weight; no target exceeds ``most`` times its source, and the excess goes to the others by weight until
none is above.  Each document is emitted floor(rate) times plus one more with the probability of the fraction, decided by
a hash of seed and id, so reruns agree.

Defined cases: null text has size 0; a null source is a source of its own; a source without words has target 0; rows with
the same id get the same decision; a row with a null id is decided by its text; an empty table gives an empty result; other columns
pass through ``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import checkpointed, fresh

WEIGHTS = (5, 2, 1)
#: A table of so many sources at most is broadcast (some MB); a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def uniform(seed: str, id_col: str, text_col: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and id, or of the text where the id is null."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def numbered(rows: DataFrame, by: Column, out: str) -> DataFrame:
    """``rows`` with their places from 0 in the order of ``by``, a column of distinct values, without gathering them in one task.

    Rows are dealt by ranges; each range numbers its own, and the ranges' sizes, one number a task, shift them.
    """
    dealt = checkpointed(rows.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    at, shift = 0, {}
    for r in sorted(dealt.groupBy("_range").count().collect()):
        shift[r["_range"]] = at
        at += r["count"]
    shifts = rows.sparkSession.createDataFrame(list(shift.items()), "_range int, _shift long")
    order = Window.partitionBy("_range").orderBy(by)
    return dealt.join(F.broadcast(shifts), "_range").withColumn(out, F.row_number().over(order) - 1 + F.col("_shift")).drop("_range", "_shift")


def source_targets(sizes: DataFrame, source_col: str = "source", share: float = 1.5, most: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target.  ``sizes`` has the source and ``size``.

    The excess is reshared round by round: a round sums the caps that bind and the weights of the others over the sources, in any
    number, and the next level is what is left for a unit of weight.  Levels only rise, so the rounds end.
    """
    by = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    by = numbered(by, F.col("source").asc_nulls_last(), "k")
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    by = checkpointed(by.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight")))
    total, weight = by.agg(F.sum("source_size"), F.sum("weight")).first()
    level, bound = -1.0, None
    if total:
        now = total * share / weight
        while now > level:
            level = now
            binds = F.col("ratio") <= F.lit(level)
            caps, rest = by.agg(F.sum(F.when(binds, F.col("cap")).otherwise(0)), F.sum(F.when(binds, 0).otherwise(F.col("weight")))).first()
            if not rest:
                break
            bound, now = level, (total * share - caps) / rest
    target = F.col("cap").cast("double")
    if bound is not None and rest:
        target = F.when(F.col("ratio") <= F.lit(now), target).otherwise(F.lit(now) * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"))


def plan_copies(docs: DataFrame, names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies"), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``docs`` with four columns more, named by ``names``: size, source_size, target and copies (how often each row is emitted)."""
    size, source_size, target, copies = names
    key, rate = fresh(docs.select(*docs.columns, *[F.lit(0).alias(n) for n in names]), "_source", "_rate")
    targets = checkpointed(source_targets(docs.select(F.col(source_col), n_words(text_col).alias("size")), source_col, **kw))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    t = targets.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    out = docs.join(t, F.col(source_col).eqNullSafe(F.col(key))).drop(key)
    out = out.withColumn(size, n_words(text_col)).withColumn(rate, F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0)))
    extra = (uniform(seed, id_col, text_col) < F.col(rate) - F.floor(rate)).cast("long")
    return out.withColumn(copies, F.floor(rate) + extra).drop(rate)


def mix(docs: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each row as often as its plan says."""
    *names, one = fresh(docs, "_size", "_source_size", "_target", "_copies", "_copy")
    planned = plan_copies(docs, tuple(names), seed, **kw).where(F.col(names[3]) > 0)
    return planned.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*docs.columns)


def mixed_sizes(docs: DataFrame, **kw) -> DataFrame:
    """What the mix takes of each document."""
    p = plan_copies(docs.select("doc_id", "text", "source"), **kw)
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, text, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM k),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 1.5
       - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
       / CAST(sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
f AS (SELECT min_by(level, ratio) AS found FROM (SELECT level, ratio FROM l WHERE ratio > level ORDER BY ratio, k LIMIT 1) x),
t AS (SELECT source, source_size, CASE WHEN found IS NULL OR ratio <= found THEN CAST(cap AS DOUBLE) ELSE found * weight END AS target FROM l CROSS JOIN f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
       CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
     FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
