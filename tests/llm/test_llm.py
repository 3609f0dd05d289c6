"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from llm import ann, bpe, embedding_dedup, langid, mixing, ngram_join, secrets, substring, token_counts, toxicity
from llm.common import Forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string"
rng = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(rng.choice(WORDS, 300))
TEXTS = [None, "", " \n ", "one two", "one two", LONG, LONG.replace("w7 ", "q "), LONG + " tail words here", LONG.upper(), "x" * 50_000, "A  b  c <|endoftext|> it's  \n", "the " * 500, *(" ".join(rng.choice(WORDS, rng.integers(1, 80))) for _ in range(40))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t or ""), "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, LONG, "en", "a", 1, "clash")], DOCS)


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("weight", [2_000_000, 300])
def test_ngram_join(docs, weight):
    got = ngram_join.ngram_join(docs, 4, 85, task_shingles=weight).collect()
    assert len(got) == docs.count()
    s, f = [sets(t, 4) for t in TEXTS], Forest()
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                f.union(i, j)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(s[r.doc_id]), f.find(r.doc_id))
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_bpe_and_counts(docs):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("doc_id is not null").collect():
        t = TEXTS[r.doc_id] or ""
        ids = np.array(own.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).where("doc_id is not null").collect():
        t = TEXTS[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    enc = bpe.decode(bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in enc.collect())
    assert base64.b64encode(b"x")


def vectors(spark):
    x = rng.normal(size=(300, 8))
    x[200:240] = x[200] + rng.normal(size=(40, 8)) * 0.15
    x[250:260] = x[250]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (1004, [1.0], 0), (1020, [], 0)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")


def test_nearest_at_factor_one(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20, factor=1.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [found[k] for k in range(1, 21)] == want
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [8192, 40])
def test_embedding_dedup(spark, cells, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cells)
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    f = Forest()
    for i, j in np.argwhere(near).tolist():
        f.union(i, j)
    rows = embedding_dedup.embedding_dedup(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = (int(near[r.vec_id].sum()), f.find(r.vec_id)) if r.vec_id < 300 else (0, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (*want, want[1] == r.vec_id)


def test_mixing(docs):
    rows = mixing.mixed_sizes(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r.source_size: r.target for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s + 1e-9 for s, t in targets.items())
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len((r.text or "").split()) for r in mixed.collect() if r.text and " " not in r.text) > 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_language_and_toxicity(spark, docs):
    got = {r.doc_id: r for r in langid.language_id(docs).collect() if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2))
    assert langid.keep_identified(docs).columns == docs.columns
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(len(TEXTS))], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_counterfactual_lowers_the_effect_of_group_terms():
    texts = ["the muslims idiot went", "muslims moron home", "muslims idiot", "idiot muslims here"] * 10 + ["a quiet day", "people at home", "the garden", "women at home"] * 10
    y = np.array([1.0] * 40 + [0.0] * 40)
    pick = lambda swap: [np.asarray(toxicity.features([t], swap)[0]) for t in texts]
    effect = []
    for weight in (0.0, 10.0):
        w, _ = toxicity.fit(y, pick(False), pick(True), counterfactual=weight)
        effect.append(abs(w[toxicity.features(["muslims"])[0]].sum()))
    assert effect[1] < effect[0]


def test_repeated_passages_are_found_and_cut(spark):
    passage = " ".join(rng.choice(WORDS, 70))
    texts = [" ".join(rng.choice(WORDS, 100)) for _ in range(6)]
    texts[1] += " " + passage + " " + texts[0][:50][::-1]
    texts[4] = "Start. " + passage + " end of it " + texts[4]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    found = substring.repeated_spans(df).collect()
    assert {(r.doc_id, r.kept) for r in found} == {(1, True), (4, False)} and all(r.n_words >= 40 for r in found)
    cut = {r.doc_id: r.text for r in substring.drop_repeats(df).collect()}
    assert cut[0] == texts[0] and cut[1] == texts[1] and len(cut[4]) < len(texts[4]) - 150 and cut[6] is None


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    text = f'see commit {hashlib.sha1(b"c").hexdigest()} and token = "{key}" here'
    df = spark.createDataFrame([(1, text, len(text)), (2, None, None), (3, "", 0), (1, text, len(text))], "doc_id long, text string, n_chars long")
    model = secrets.train(secrets.labelled_findings(spark))
    rows = [r for r in secrets.scan(df, model).collect() if r.is_secret]
    assert Counter(text[r.start - 1 : r.start - 1 + r.n_chars] for r in rows) == {key: 2}
    out = secrets.redact(df, model).collect()
    assert len(out) == 4 and all(key not in (r.text or "") for r in out) and {r.n_chars for r in out} == {len(text) - len(key) + len(secrets.MARK), None, 0}
