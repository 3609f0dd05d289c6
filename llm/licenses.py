"""License scan by votes of diagonals.

Every run of ``WIDTH`` words of a text is hashed and joined with the places of such runs in the templates, a table of some hundred
rows that all tasks hold (the words themselves must be equal too).  A hit votes for its diagonal, place in the text minus place in the
template, so words in a row fall on one diagonal.  Diagonals with too few votes go; neighbours of one template, which words put in or
left out have moved apart, are merged into a span; a span counts if it covers enough of its template and is not too thin.  Phrases
and notices must stand word by word: one diagonal with all votes.

A document's hits are dealt out by a number of its row, once, with one more row a document, which matches an empty template; votes, spans and
the result a document are then each task's own, whatever many texts share.  The number is that of the row in its scan; a task that runs
again reads the same rows, and Spark computes anew what depends on an input that does not repeat.

Defined cases: a null or empty text has no words and no licenses; rows with the same id or text are rows of their own; places of a phrase
may overlap and all count; a text of any length is one row of words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.license_texts import NOTICES, PHRASES, TEXTS
from llm.words import WORD, WORDS_SQL, words

WIDTH = 3
#: Of a text: votes that a diagonal needs, diagonals (words put in or left out) that may lie between two of a span, the part of the
#: template that must be covered, and of the span.
LEAST_VOTES, SLACK, COVERED, DENSE = 2, 12, 0.6, 0.4


def templates() -> list[tuple]:
    """(number, label, whether a base phrase, places, votes needed, slack, part to cover, words) of each template."""
    out = []
    for kind, rows in (("base", PHRASES), ("notice", NOTICES), ("text", TEXTS)):
        for text, label in rows:
            w = re.findall(WORD.replace(r"\x{10FFFF}", "\U0010ffff"), text.lower())
            n = len(w) - WIDTH + 1
            out.append((len(out), label, kind == "base", n, *((LEAST_VOTES, SLACK, COVERED) if kind == "text" else (n, 0, 1.0)), w))
    return out


def _places() -> list[tuple]:
    """(template, places, votes needed, slack, part, place, run of words) of every run, and the empty one."""
    rows = [(k, n, need, slack, part, i, " ".join(w[i : i + WIDTH])) for k, _, _, n, need, slack, part, w in templates() for i in range(n)]
    return [*rows, (-1, 1, 1, 0, 1.0, 0, "")]


def _hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a match of a run with a template's place, and one a document; all rows of a document are in one partition."""
    spark = docs.sparkSession
    table = spark.createDataFrame(_places(), "template int, places int, need int, slack int, part double, at int, run string").withColumn("h", F.xxhash64("run"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    starts = F.slice("w", 1, F.greatest(F.col("n_words") - (WIDTH - 1), F.lit(0)))
    runs = F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(F.col("w"), i + k) for k in range(1, WIDTH)]))
    rolled = rows.select("row", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit("")), runs)).alias("place", "words"))
    found = rolled.withColumn("h", F.xxhash64("words")).join(F.broadcast(table), "h").where("words = run")
    return found.select("row", "doc_id", "n_words", "template", "places", "need", "slack", "part", "at", (F.col("place") - 1).alias("place")).repartition("row")


def _spans(hits: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, start, stop, covered, verified): merged diagonals with the part of the template that they cover."""
    own = ["row", "doc_id", "n_words", "template", "places", "need", "slack", "part"]
    votes = hits.groupBy(*own, (F.col("place") - F.col("at")).alias("d")).agg(F.count("*").alias("votes"), F.collect_list("at").alias("at"))
    votes = votes.where(F.col("votes") >= F.col("need"))
    line = Window.partitionBy("row", "template").orderBy("d")
    far = F.coalesce(F.col("d") - F.lag("d").over(line) > F.col("slack"), F.lit(False)).cast("int")
    spans = votes.withColumn("far", far).withColumn("span", F.sum("far").over(line))
    spans = spans.groupBy(*own, "span").agg(
        F.min(F.col("d") + F.array_min("at")).alias("start"),
        (F.max(F.col("d") + F.array_max("at")) + WIDTH).alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("met"),
    )
    dense = F.col("met") >= DENSE * (F.col("stop") - F.col("start") - WIDTH + 1)
    return spans.select("row", "doc_id", "n_words", "template", "start", "stop", (F.col("met") / F.col("places")).alias("covered"), ((F.col("met") >= F.col("part") * F.col("places")) & dense).alias("verified"))


def _label(template: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t[1]) for t in templates()]), template + 1)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, start and stop (in words, from 0; stop is the first one after) and covered of every license found."""
    s = _spans(_hits(docs, id_col, text_col)).where("template >= 0 and verified")
    return s.select("doc_id", _label(F.col("template")).alias("label"), "start", "stop", "covered")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, places of base phrases with the first and last, base labels, all labels, and a score.

    The score is the largest part of a template that a span covers, 1 where a phrase or notice stands, 0 without any.
    """
    base, real = F.col("template").between(0, len(PHRASES) - 1), F.col("template") >= 0
    label = _label(F.greatest("template", F.lit(0)))
    listed = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, label))), ",")
    out = _spans(_hits(docs, id_col, text_col)).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(real & F.col("verified")).alias("labels"), F.coalesce(F.max(F.when(real, F.col("covered"))), F.lit(0.0)).alias("score"),
    )
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def sql() -> str:
    text = lambda x: str(x) if not isinstance(x, (str, float)) else f"'{x}'" if isinstance(x, str) else f"{x!r}e0"
    rows = ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in _places()[:-1])
    labels = ", ".join(f"({t[0]}, '{t[1]}', {t[2]})" for t in templates())
    run = " || ' ' || ".join(f"w[i + {k + 1}]" for k in range(WIDTH))
    return f"""
WITH t(template, places, need, slack, part, at_t, run) AS (VALUES {rows}),
l(template, label, base) AS (VALUES {labels}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
g AS (SELECT r, i, {run} AS run FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {WIDTH - 1}, 0))) AS i FROM d) q),
v AS (SELECT r, template, places, need, slack, part, i - at_t AS d, count(*) AS votes, list(at_t) AS met FROM g JOIN t USING (run) GROUP BY ALL HAVING count(*) >= need),
f AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) > slack THEN 1 ELSE 0 END AS far FROM v),
n AS (SELECT *, sum(far) OVER (PARTITION BY r, template ORDER BY d) AS span FROM f),
s AS (SELECT r, template, places, part, span, min(d + list_min(met)) AS start, max(d + list_max(met)) + {WIDTH} AS stop, len(list_distinct(flatten(list(met)))) AS met FROM n GROUP BY ALL),
c AS (SELECT r, start, label, base, CAST(met AS DOUBLE) / places AS covered, met >= part * places AND met >= {DENSE}e0 * (stop - start - {WIDTH - 1}) AS verified FROM s JOIN l USING (template)),
o AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(covered) AS score FROM c GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN o USING (r)"""


SQL = sql()
