"""Resampling of documents towards a target's distribution of hashed words.

Runs of words fall into buckets; a bucket's gain is the log ratio of its smoothed shares in the target and in the corpus.  Scoring
explodes nothing: higher-order functions make a document's array of buckets and add up its elements of the gain array, a
literal of one number a bucket.  Counting sends one row a bucket and task through the shuffle.  A document's weight is its mean
gain, its score adds Gumbel noise from a hash of seed and id, and the highest scores are a draw without replacement with
probabilities by weight.

Scores are whole numbers within a fixed range (gains of 64-bit counts and the noise of a 32-bit hash: fewer than 300,000 values), so
one count a score finds the lowest score drawn; only documents from there up are sorted, dealt by ranges over all tasks.

Defined cases: a null or empty text has no features and weight 0; a null id is hashed as 'null' and comes last among ties; rows with the same
id have the same noise, and ties of id go to fewer features; rows that are alike in all that are any of them; an empty target
favours rare buckets; an empty table gives an empty result; other columns are ignored by ``ranked`` and pass through
``resample`` unchanged whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import checkpointed, fresh
from llm.mixing import numbered
from llm.words import WORDS_SQL, words

BUCKETS = 10_000
SEED = "2024"


def buckets_of(text: Column, runs: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``runs`` words, repeats included, as an array."""
    if runs > 1:
        lengths = lambda w: F.sequence(F.lit(1), F.least(F.lit(runs), F.size(w)))
        starts = lambda w, k: F.sequence(F.lit(1), F.size(w) - k + 1)
        grams = lambda w: F.flatten(F.transform(lengths(w), lambda k: F.transform(starts(w, k), lambda i: F.concat_ws(" ", F.slice(w, i, k)))))
        # the words are an element of an array, so that they are taken from the text once and not for every run
        found = F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, grams(w)).otherwise(w))[0]
    else:
        found = words(text)
    return F.transform(found, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def gains(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths, from the features of all rows of both tables; both have ``text``."""
    count = lambda df, s, t: df.select(F.explode(buckets_of(F.col("text"), runs, buckets)).alias("b")).select("b", F.lit(s).alias("s"), F.lit(t).alias("t"))
    rows = count(docs, 1, 0).union(count(target, 0, 1)).groupBy("b").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = {r.b: (r.s, r.t) for r in rows.collect()}  # a row a bucket
    all_s, all_t = (sum(x[i] for x in found.values()) for i in (0, 1))
    out = []
    for b in range(buckets):
        s, t = found.get(b, (0, 0))
        out.append(math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets)))))
    return out


def gumbel(id_col: Column, seed: str = SEED) -> Column:
    """Noise of an id in thousandths, from 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: list[int], names: tuple[str, str, str, str], runs: int = 1, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with four columns more, named by ``names``: words, features, weight and score."""
    n_words, n, weight, score = names
    (at,) = fresh(docs.select(*docs.columns, *[F.lit(0).alias(c) for c in names]), "_buckets")
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal when the plan is made
    total = F.aggregate(F.col(at), F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    out = docs.withColumn(at, buckets_of(F.col(text_col), runs, len(gain))).withColumn(n, F.size(at).cast("long"))
    out = out.withColumn(n_words, F.col(n) if runs == 1 else F.size(words(F.col(text_col))).cast("long"))
    out = out.withColumn(weight, total).withColumn(weight, F.when(F.col(n) > 0, F.expr(f"(`{weight}` - pmod(`{weight}`, `{n}`)) div `{n}`")).otherwise(F.lit(0).cast("long")))
    return out.withColumn(score, F.col(weight) + gumbel(F.col(id_col), seed)).drop(at)


def lowest_drawn(scores: DataFrame, score: str, part: int, whole: int) -> tuple[int, int, int]:
    """How many rows are drawn (part / whole, rounded down), the lowest score among them, and how many rows have a higher one."""
    counts = sorted(((r[0], r[1]) for r in scores.groupBy(score).count().collect()), reverse=True)
    draw = sum(c for _, c in counts) * part // whole
    above = 0
    for s, c in counts:
        if above + c >= draw:
            return draw, s, above
        above += c
    return 0, 0, 0


def _order(score: str, id_col: str, n: str, row: str) -> Column:
    return F.struct(-F.col(score), F.col(id_col).isNull(), F.col(id_col), F.col(n), F.col(row))


def ranked(docs: DataFrame, target: DataFrame, runs: int = 1, part: int = 10, whole: int = 100, least_words: int = 20, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and the rank of those drawn.

    Drawn are the highest scores of the rows with ``least_words`` words or more, ``part`` of ``whole`` of their number.
    """
    names = ("n_words", "n_features", "weight", "score")
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gains(docs, target, runs, buckets), names, runs, seed)
    rows = checkpointed(rows.select("doc_id", *names))
    may = F.col("n_words") >= least_words
    draw, lowest, _ = lowest_drawn(rows.where(may), "score", part, whole)
    out = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    top = may & (F.col("score") >= lowest)
    best = numbered(rows.where(top).withColumn("_row", F.monotonically_increasing_id()), _order("score", "doc_id", "n_features", "_row"), "_at")
    rank = F.when(F.col("_at") < draw, F.col("_at") + 1).cast("long").alias("rank")
    return best.select(*out, rank).union(rows.where(~top).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, part: int = 10, whole: int = 100, least_words: int = 20, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """The drawn rows, with the columns of ``docs``.

    Rows above the lowest score drawn pass by a filter; only those at it are sorted by id, as some of them are left.
    """
    *names, row, at = fresh(docs, "_words", "_features", "_weight", "_score", "_row", "_at")
    rows = scored(docs, gains(docs, target, runs, buckets), tuple(names), runs, seed).where(F.col(names[0]) >= least_words)
    draw, lowest, above = lowest_drawn(rows, names[3], part, whole)
    if not draw:
        return docs.limit(0)
    ties = checkpointed(rows.where(F.col(names[3]) == lowest)).withColumn(row, F.monotonically_increasing_id())
    ties = numbered(ties, _order(names[3], "doc_id", names[1], row), at).where(F.col(at) < draw - above)
    return rows.where(F.col(names[3]) > lowest).select(*docs.columns).union(ties.select(*docs.columns))


SQL = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS words FROM documents),
b AS (SELECT {WORDS_SQL} AS words FROM benchmark),
w AS (SELECT r, 0 AS kind, unnest(words) AS word FROM d UNION ALL SELECT NULL, 1, unnest(words) FROM b),
h AS (SELECT word, hex(encode(word)) AS hex FROM (SELECT DISTINCT word FROM w) q),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM h, tab),
f AS (SELECT r, kind, bucket FROM w JOIN k USING (word)),
n AS (SELECT count(*) FILTER (kind = 0) AS s_all, count(*) FILTER (kind = 1) AS t_all FROM f),
c AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM c, n),
m AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY 1),
x AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM x),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, place AS rank FROM y LEFT JOIN o ON y.doc_id = o.doc_id AND place <= n * 10 // 100
"""
