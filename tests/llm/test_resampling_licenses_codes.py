"""Importance resampling, license scan and vector codes against plain versions, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import importance, licenses, vector_codes
from llm.license_texts import PHRASES, TEXTS

rng = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(300)] + ["Straße", "été", "ÄRA", "日本語"]
DOCS = "doc_id long, text string, n_words int, row string, rank int, score double"


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[i], t, 7, "clash", 1, 0.5) for i, t in enumerate(texts)]


# ---------------------------------------------------------------- resampling


def runs_of(text, runs):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def plain_scores(texts, ids, target, runs, buckets):
    place = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(place(x) for text in some for x in runs_of(text, runs)) for some in (texts, target))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, text in zip(ids, texts):
        f = [gain[place(x)] for x in runs_of(text, runs)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text))))
    return out


@pytest.mark.parametrize("runs", [1, 3])
def test_scores_and_ranks_equal_a_plain_version(spark, runs):
    texts = [" ".join(rng.choice(WORDS, n)) for n in rng.integers(1, 90, 150)]
    texts += [None, "", " - ", "Émile ÉTÉ A_b\x00c\x7fd", "the " * 5_000, " ".join(rng.choice(WORDS, 30_000)), texts[0], texts[0]]
    ids = [*range(len(texts) - 3), None, 5, 5]
    target = [" ".join(rng.choice(WORDS[:40], 50)) for _ in range(5)] + [None]
    df = spark.createDataFrame(rows_of(texts, ids), DOCS).repartition(5)
    bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    want = plain_scores(texts, ids, target, runs, 500)
    got = importance.ranked(df, bench, runs=runs, buckets=500).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in want)
    order = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(order) // 10 + 1))
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in drawn] == [x[:4] for x in order[: len(drawn)]]
    kept = importance.resample(df, bench, runs=runs, buckets=500)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in drawn)


def test_a_draw_among_ties_goes_by_id(spark):
    df = spark.createDataFrame([(None, "same words " * 20)] * 45 + [(3, "a " * 30)] * 5, "doc_id long, text string").repartition(4)
    bench = df.limit(0).select("text")
    got = [r["rank"] for r in importance.ranked(df, bench, part=50).collect()]
    assert sorted(x for x in got if x) == list(range(1, 26))
    assert importance.resample(df, bench, part=50).count() == 25
    assert importance.ranked(df.limit(0), bench).count() == 0 and importance.resample(df.limit(0), bench).count() == 0
    assert {r["rank"] for r in importance.ranked(df.limit(3), bench).collect()} == {None}


def test_the_draw_moves_towards_the_target(spark):
    texts = [" ".join(rng.choice(WORDS[:50] if i % 5 == 0 else WORDS[50:300], 60)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(" ".join(rng.choice(WORDS[:50], 80)),) for _ in range(20)], "text string")
    drawn = [r.doc_id for r in importance.resample(df, bench).collect()]
    assert len(drawn) == 40 and sum(i % 5 == 0 for i in drawn) >= 24  # 8 without the weights


# ---------------------------------------------------------------- licenses


def plain_places(text):
    w, out = plain_words(text), []
    for phrase, label in PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return out


MIT = TEXTS[0][0]


def edited(text, every, word="inserted"):
    w = text.split()
    return " ".join(x for i, y in enumerate(w) for x in ([y, word] if i % every == every - 1 else [y]))


def test_base_places_equal_a_plain_search(spark):
    filler = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [None, "", "mit", "cc by", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc cc-by-nc by nc", "under the mit under the mit license"]
    texts += [f"{filler(5)} Apache License, Version 2.0. {filler(9)} under THE mit license {filler(3)}", "Apache License\nVersion 3", filler(40_000) + " cc by nc " + filler(10) + " under the mit license"]
    texts += ["cc by nc " * 2_000, *(filler(30) for _ in range(20))]
    df = spark.createDataFrame(rows_of([*texts, texts[4], texts[4]], [*range(len(texts)), None, 4]), DOCS).repartition(4)
    got = licenses.license_labels(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[4 if r.doc_id is None else r.doc_id]
        at = plain_places(text)
        labels = ",".join(sorted({x for _, x in at}))
        assert (r.n_words, r.n_base) == (len(plain_words(text)), len(at)) and (r.base_labels, r.labels) == (labels, labels)
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.score == (1.0 if at else 0.0)
    assert licenses.license_labels(df.limit(0)).count() == 0


def test_edited_license_texts_are_found_and_others_left(spark):
    half = " ".join(MIT.split()[:30])
    scattered = " ".join(f"{' '.join(MIT.split()[i : i + 4])} {' '.join(rng.choice(WORDS, 40))}" for i in range(0, 80, 4))
    texts = [MIT, edited(MIT, 9), " ".join(x for i, x in enumerate(MIT.split()) if i % 11), f"{MIT} and {MIT}", half, scattered, "The software is provided to any person. Permission was granted."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_labels(df).collect()}
    assert [got[i].labels for i in range(7)] == ["mit"] * 4 + [""] * 3
    assert got[0].score == 1 and all(0 < got[i].score < 1 for i in (1, 2, 4)) and not any(r.n_base for r in got.values())
    spans = licenses.license_spans(df).where("doc_id in (0, 3)").collect()
    n = len(plain_words(MIT))
    assert Counter((r.doc_id, r.label, r.start, r.stop) for r in spans) == Counter([(0, "mit", 0, n), (3, "mit", 0, n), (3, "mit", n + 1, 2 * n + 1)])


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(row, code, error) of the kept rows and the digest, one part after the other in plain integers."""
    kept = [(i, r[0], r[2], [max(-(2**24), min(2**24, math.floor(1024 * x))) for x in r[1]]) for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == 8]
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0, r[3]))
    width, books, codes, error = 8 // parts, [], [""] * len(kept), [0] * len(kept)
    for p in range(parts):
        v = [r[3][p * width : (p + 1) * width] for r in kept]
        book = v[:entries]
        near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b))
        for k in range(rounds + 1):
            found = [near(x, book) for x in v]
            if k < rounds:
                of = [[x for x, (_, c) in zip(v, found) if c == e] for e in range(len(book))]
                book = [[sum(c) // len(some) for c in zip(*some)] if some else old for some, old in zip(of, book)]
        books.append(book)
        for i, (d, c) in enumerate(found):
            codes[i] += f"{c:02x}"
            error[i] += d
    text = ",".join(str(x) for b in books for e in b for x in e)
    by = Counter()
    for r, e in zip(kept, error):
        by[r[2]] += e
    return Counter((r[1], c, e, by[r[2]]) for r, c, e in zip(kept, codes, error)), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_codes_equal_a_plain_version(spark, scale):
    x = np.round(rng.normal(size=(420, 8)), 1) * scale
    x[100:260] = x[100]
    x[300:330, :4] = x[300, :4]
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3), "clash") for i, v in enumerate(x)]
    rows += [(None, x[5].tolist(), 1, ""), (3, x[3].tolist(), 1, ""), (3, x[9].tolist(), 1, ""), (1000, None, 0, ""), (1001, [float("nan")] * 8, 0, ""), (1002, [None] * 8, 0, ""), (1003, [1.0], 0, ""), (1004, [], 0, ""), (1005, [float("inf")] + [0.0] * 7, 0, ""), (-1, [1.0] * 6, 0, ""), (1006, [1e30] * 8, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = vector_codes.vector_codes(df).collect()
    want, digest = plain_codes(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = vector_codes.vector_codes(spark.createDataFrame([(9, [0.5, -0.5, 0.25, 0.1], None)], schema)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(9, "00000000", 0, 0)]
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0


def test_distances_are_exact_beyond_doubles():
    v, book = np.array([[1 << 24, -(1 << 24)], [3, 4]]), np.array([[-(1 << 24), (1 << 24) - 1], [3, 5], [3, 3]])
    code, error = vector_codes.nearest(v, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in v]
    assert [(int(e), int(c)) for c, e in zip(code, error)] == want
