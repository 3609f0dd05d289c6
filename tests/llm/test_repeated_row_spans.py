"""Repeated rows in several partitions are one text."""

from collections import Counter

import numpy as np

from llm import substring

rng = np.random.default_rng(23)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(rng.choice(WORDS, n))


def test_repeated_rows_keep_their_spans(spark):
    passage = text(70)
    twin = f"{text(60)} {passage} {text(60)}"
    own = text(70)
    again = f"{text(60)} {own} {text(60)} {own} {text(60)}"
    parts = [[(1, f"{passage} {text(60)}"), (7, twin), (8, again)], [(7, twin), (8, again)], [(7, twin)]]
    df = spark.sparkContext.parallelize(parts, 3).flatMap(lambda p: p).toDF("doc_id long, text string")
    found = substring.repeated_spans(df).where("not kept").collect()
    assert Counter(r.doc_id for r in found) == {7: 1, 8: 1} and all(r.n_words >= 40 for r in found)
    spread = {r.doc_id: len(r.text) for r in substring.drop_repeats(df).collect()}
    assert spread[7] < len(twin) - 200 and spread[8] < len(again) - 200
