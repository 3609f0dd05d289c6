"""Ties, repeated rows, clashing names and types, empty tables, very long texts and many groups, against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import ann, bpe, embedding_dedup, langid, mixing, ngram_join, secrets, substring, token_counts, toxicity
from llm.common import Forest, bits_for, bit_rows, fresh, in_bitmap

rng = np.random.default_rng(41)
WORDS = [f"w{i}" for i in range(400)]
RANKS = P.path("byte_bpe_50k.tiktoken")
VECTORS = "vec_id long, embedding array<float>"


def text(n):
    return " ".join(rng.choice(WORDS, n))


def exact(x, q, ids, own, k):
    s = (x * q).sum(1)
    return sorted((i for i in range(len(x)) if ids[i] != own), key=lambda i: (-s[i], ids[i]))[:k]


# ---------------------------------------------------------------- op1


@pytest.mark.parametrize("rows", [16_384, 256])
def test_hundreds_of_ties_go_to_the_smaller_ids(spark, monkeypatch, rows):
    """Distinct vectors with equal inner products, in one shard and in several cells, meet the order of their ids."""
    monkeypatch.setattr(ann, "SHARD_ROWS", rows)
    n = 2000
    x = np.zeros((n, 4), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.arange(n) % 997
    x[:, 2] = np.arange(n) // 997
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 0.0, 0.0, 0.0])], VECTORS).repartition(5)
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 5000"), 20, factor=1.0).collect())
    assert got == [(k + 1, k, 1.0) for k in range(20)]


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (1.1, 0.9)])
def test_recall_by_factor_over_cells(spark, monkeypatch, factor, least):
    monkeypatch.setattr(ann, "SHARD_ROWS", 256)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # a quarter is one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    found = defaultdict(dict)
    for r in ann.nearest(df, df.where("vec_id % 60 = 0"), 20, factor=factor).collect():
        found[r.query_id][r["rank"]] = r.vec_id
    double, ids = x.astype(float), np.arange(3000)
    hits = 0
    for q in range(0, 3000, 60):
        want = exact(double, double[q], ids, q, 20)
        hits += len(set(want) & set(found[q].values()))
        if factor == 1.0:
            assert [found[q][k] for k in range(1, 21)] == want
    assert hits / (50 * 20) >= least


def test_nearest_takes_one_vector_of_a_repeated_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0]), (4, [1.0]), (None, [9.0, 9.0])], VECTORS)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id in (1, 4)"), 5, factor=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0)]


# ---------------------------------------------------------------- op4


@pytest.mark.parametrize("chunk, tile", [(16_384, (1024, 8192)), (256, (37, 50))])
def test_links_in_chunks_and_tiles(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 100)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    centres = rng.normal(size=(30, 8))
    x = (centres[rng.integers(0, 30, 700)] + 0.12 * rng.normal(size=(700, 8))).astype(np.float32)
    x[:300] = x[0] + 0.05 * rng.normal(size=(300, 8))
    x[300:340] = x[300]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    f = Forest()
    for i, j in np.argwhere(near).tolist():
        f.union(i, j)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    for r in embedding_dedup.embedding_dedup(df).collect():
        assert (r.n_links, r.component_id) == (int(near[r.vec_id].sum()), f.find(r.vec_id))
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op5


def plain_chunks(data: bytes):
    """Byte by byte: (start, end) of each chunk."""
    out, at, h = [], 0, 0
    window = bytes(16) + data
    for i in range(len(data)):
        h = sum(int(substring._GEAR[window[i + 16 - k]]) << k for k in range(16)) & 0xFFFFFFFF
        if h >> 28 == 0 and i + 1 - at >= 16 or i + 1 - at == 256:
            out.append((at, i + 1))
            at = i + 1
    return out + ([(at, len(data))] if at < len(data) else [])


def plain_runs(rows):
    """Runs of chunks whose bytes stand earlier, in the order of id, text key and place; a repeated row counts once."""
    texts = sorted({(d, t) for d, t in rows if d is not None and t})
    seen, out = {}, []
    chunks = [(d, t, s, e) for d, t in texts for s, e in plain_chunks(t.encode())]
    count = Counter(t.encode()[s:e] for d, t, s, e in chunks)
    for d, t, s, e in chunks:
        b = t.encode()[s:e]
        kept = seen.setdefault(b, (d, t, s)) == (d, t, s)
        if count[b] < 2:
            continue
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()[:e])) - len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()[:s]))
        if out and out[-1][:2] == (d, t) and out[-1][3] == s and out[-1][4] == kept:
            out[-1] = (d, t, out[-1][2], e, kept, out[-1][5] + words)
        else:
            out.append((d, t, s, e, kept, words))
    return Counter((d, s, e, kept, w) for d, t, s, e, kept, w in out if w >= substring.LEAST_WORDS or e - s >= substring.LEAST_BYTES)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_runs_are_those_of_a_plain_chunker_however_rows_are_dealt(spark, partitions):
    passage, own = text(90), text(80)
    rows = [(1, f"{text(30)} {passage} {text(9)}"), (2, None), (3, ""), (4, f"{passage} {text(50)}"), (7, f"{text(40)} {own} {text(20)} {own}"), (9, text(60)), (9, f"x {passage}"), (None, passage)]
    rows += [rows[4], rows[4], rows[0], (11, "長い文章が続く。" * 3 + "漢字仮名交じり文の例として同じ一節がここにも現れる" * 12), (12, "別の前書き。" + "漢字仮名交じり文の例として同じ一節がここにも現れる" * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = Counter((r.doc_id, r.start_byte, r.end_byte, r.kept, r.n_words) for r in substring.repeated_spans(df).collect())
    want = plain_runs(rows)
    if 9 in {d for d, *_ in want}:  # which of two texts of one id comes first goes by their keys
        want, got = (Counter({k: v for k, v in c.items() if k[0] != 9}) for c in (want, got))
    assert got == want and {4, 7, 12} <= {k[0] for k in got}
    assert substring.repeated_spans(df.limit(0)).count() == 0


def test_cutting_keeps_clashing_columns(spark):
    passage = text(70)
    df = spark.createDataFrame([(1, passage, 5, "a", 7, {"x": 1}), (2, f"{text(30)} {passage}", 6, "b", 8, None)], "doc_id long, text string, _key int, _spans string, _doc int, _k map<string,int>")
    out = {r.doc_id: r for r in substring.drop_repeats(df).collect()}
    assert (out[1]._key, out[2]._spans, out[1]._k) == (5, "b", {"x": 1}) and len(out[2].text) < 300


# ---------------------------------------------------------------- op2, op9


def test_scores_are_the_sums_of_their_words(spark):
    bad, good = ["vile", "scum", "rotten", "filthy"], ["garden", "river", "paper", "window"]
    rows = [(i, " ".join([*rng.choice(bad if i % 3 == 0 else good, 4), *rng.choice(WORDS, 5), "Women" if i % 2 else "men"]), "c") for i in range(300)]
    rows += [(300, None, "c"), (301, "", "c"), (0, "another text of the first id", "c"), (5, rows[5][1], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 1), (9999, 1), (None, 0), (4, None)], "doc_id long, toxic int")
    w, b = toxicity.train(docs, labels)
    assert 0 < np.count_nonzero(w) <= toxicity.MOST_FEATURES
    scores = defaultdict(list)
    for r in toxicity.toxicity(docs, labels).collect():
        scores[r.doc_id].append(r.score)
    model = toxicity.train(docs, labels.where(toxicity.hashed_id() % 3 != 1))
    for d, t, _ in rows:
        bins = set()
        for word in re.findall(r"[0-9a-z'\x80-\U0010ffff]+", (t or "").lower()):
            raw = word.encode()
            for form in [raw] + [raw[:n] for n in toxicity.PREFIXES if len(raw) > n]:
                bins.add(form if form == raw else (len(form), form))
        # one text of one word at a time gives that word's bins
        z = model[1] + sum(model[0][x] for x in {y for word in re.findall(r"[0-9a-z'\x80-\U0010ffff]+", (t or "").lower()) for y in toxicity.features([word])[0].tolist()})
        assert any(abs(s - 1 / (1 + np.exp(-z))) < 1e-6 for s in scores[d])
    wrong = sum((s[0] >= 0.7) != (d % 3 == 0) for d, s in scores.items() if 10 < d < 300)
    assert wrong <= 6
    for only in (0, 1):
        assert {r.score for r in toxicity.toxicity(docs, labels.where(f"toxic = {only}")).collect()} == {float(only)}
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def plain_languages(train, texts):
    counts, n = defaultdict(Counter), Counter()
    bins = lambda t: np.concatenate(langid.gram_bins([t])[0]).tolist()
    for t, lang in train:
        counts[lang].update(bins(t))
        n[lang] += 1
    total = {g: sum(c.values()) + 0.5 * langid.BINS for g, c in counts.items()}
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        s = {g: np.log(n[g] / n.total()) + sum(np.log((counts[g][x] + 0.5) / total[g]) for x in bins(t)) for g in counts}
        best = min(s, key=lambda g: (-s[g], g))
        out.append((best, 1 / sum(np.exp(v - s[best]) for v in s.values())))
    return out


@pytest.mark.parametrize("block, segment", [(128, 200_000), (3, 50)])
def test_languages_are_those_of_a_plain_model_in_any_blocks(spark, monkeypatch, block, segment):
    monkeypatch.setattr(langid, "BLOCK_LANGS", block)
    monkeypatch.setattr(langid, "SEGMENT", segment)
    kinds = [["der", "die", "und", "straße"], ["the", "and", "house", "there"], ["el", "la", "niño", "casa"], ["le", "les", "été", "maison"], ["ja", "nein"], ["ano", "není"], ["tak", "nie"], ["sim", "não"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 8], rng.integers(2, 30))), f"l{i % 8}" if i % 11 else None, "s") for i in range(120)]
    rows += [(500, None, "l1", "s"), (501, "12 ½ 34", "l1", "s"), (502, "", None, "s"), (503, "the house " * 2000, "l1", "s"), (7, "die straße", "l0", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    teach = {r.doc_id: r.hid for r in docs.select("doc_id", (langid.hashed_id() % 5).alias("hid")).collect()}
    want = plain_languages([(t, g) for d, t, g, _ in rows if t is not None and g is not None and teach[d]], [r[1] for r in rows])
    got = defaultdict(list)
    for r in langid.language_id(docs).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    for (d, *_), (lang, score) in zip(rows, want):
        assert any(g == lang and abs(s - score) < 1e-9 for g, s in got[d])
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.5 for _, s in want)
    assert langid.language_id(docs.limit(0)).count() == 0 and langid.keep_identified(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- op6, op7


def test_other_patterns_are_not_cut_at_spaces(spark):
    import tiktoken

    pattern = r"\S+ ?|\s+"  # a space belongs to the word before it
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={})
    texts = ["one two  three", "a b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df, RANKS, pattern).collect():
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id])


@pytest.mark.parametrize("words", [0, 3, 65_536])
def test_encoding_is_the_librarys_whatever_the_table(spark, words):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={})
    texts = [f"zqxv{i % 7}wobble Überschwänglichkeit{i % 5} {'y' * 400} it's\n\n  end" for i in range(40)] + [None, "", " ", "x" * 300_000, "ab " * 50_000]
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string").repartition(4)
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN, table_words=words), RANKS, P.PATTERN, ids_col="ids_")
    assert out.columns == ["doc_id", "text", "ids", "decoded", "ids_", "decoded_"]
    for r in out.collect():
        t = texts[r.doc_id] or ""
        assert list(r.ids_) == own.encode_ordinary(t) and bytes(r.decoded_).decode() == t and (r.ids, r.decoded) == (3, "k")
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0 and bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    assert bpe.corpus_table(df, open(RANKS, "rb").read(), P.PATTERN) != {}


def test_hash_table_holds_what_was_put_in():
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    h[:40] = np.arange(40, dtype=np.uint64) << np.uint64(40)  # all in one slot, one of them 0
    h = np.unique(h)
    table = token_counts.HashTable(h, (np.arange(len(h)) % 60_000).astype(np.uint16))
    assert table.find(h).tolist() == [i % 60_000 for i in range(len(h))]
    assert (table.find(np.setdiff1d(rng.integers(0, 1 << 63, 5000).astype(np.uint64), h)) == -1).all()
    assert token_counts.HashTable(h[:0], np.zeros(0, np.uint16)).find(h[:3]).tolist() == [-1, -1, -1]


def test_counts_of_long_pieces_and_merged_summaries(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "FAN", 2)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["z" * 200_000 + "  ", "q" * 500 + " " + "r" * 90, *(text(30) for _ in range(40)), "trailing  ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    for r in token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect():
        assert r.n_tokens == len(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    want = Counter(w for t in texts[2:42] for w in re.findall(r" ?[a-z]+| ?[0-9]+", t))
    top = token_counts.frequent(df, P.PATTERN, 50)
    assert [want[w] for w in top] == sorted(want.values(), reverse=True)[:50]
    assert token_counts.count_tokens(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


# ---------------------------------------------------------------- op3, op8


def plain_targets(size, share=1.5):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, live = {}, set(order)
    while live:
        left = share * sum(size.values()) - sum(target.values())
        over = {s for s in live if left * weight[s] / sum(weight[x] for x in live) > 2 * size[s]}
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        target |= {s: 2 * size[s] for s in over}
        live -= over
    return target


@pytest.mark.parametrize("n", [1, 2, 3, 300])
def test_targets_of_many_sources(spark, n):
    size = {(None if k == 1 else f"s{k:03}"): int(rng.integers(0, 50) ** 2) for k in range(n)}
    df = spark.createDataFrame([(k, s) for k, s in size.items()], "source string, size long").repartition(4)
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets(size)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix_keeps_clashing_columns_and_null_ids_are_decided_by_text(spark):
    rows = [(None, f"a b c {i}", "x", 1, "k", 2.0) for i in range(400)] + [(1, "y " * 4000, "z", 1, "k", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _copy string, _target double")
    out = mixing.mix(df).collect()
    assert {(r._size, r._copy, r._target) for r in out} == {(1, "k", 2.0)}
    sizes = [(r.taken, r.target) for r in mixing.mixed_sizes(df).collect() if r.doc_id is None]
    taken, target = sum(t for t, _ in sizes), sizes[0][1]
    assert abs(taken - target) < 0.15 * 1600 and {t for t, _ in sizes} <= {0, 4, 8}


def test_positions_of_many_secrets_are_exact(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(700)]
    t = "".join(f'line {i} ü token = "{k}" and\n' for i, k in enumerate(keys))
    df = spark.createDataFrame([(1, t, "a", "b"), (2, None, "a", "b")], "doc_id long, text string, _h1 string, _nos string")
    model = secrets.train(secrets.labelled_findings(spark))
    found = sorted((r.start, r.n_chars) for r in secrets.scan(df, model).where("is_secret").collect())
    assert [t[s - 1 : s - 1 + n] for s, n in found] == keys
    out = {r.doc_id: r for r in secrets.redact(df, model).collect()}
    assert out[1].text.count(secrets.MARK) == 700 and (out[1]._h1, out[1]._nos) == ("a", "b") and out[2].text is None
    assert secrets.scan(df.limit(0), model).count() == 0 and secrets.redact(df.limit(0), model).count() == 0


def test_precision_and_recall_by_form(spark):
    """Made-up texts that the model was not trained on: other words, other keys."""
    h = lambda i, n=40: hashlib.sha256(f"held-out {i}".encode()).hexdigest()[:n]
    good = {
        "quoted": lambda i: f'const apiKey = "{h(i)}";', "bare": lambda i: f"export DEPLOY_TOKEN={h(i)}\n", "yaml": lambda i: f"  secret: {h(i, 32)}\n", "url": lambda i: f"https://api.host{i}.io/v1?token={h(i, 32)}&page=2",
        "aws": lambda i: f"creds AKIA{h(i, 16).upper()} were found", "github": lambda i: f"push with ghp_{h(i, 36)} then", "bearer": lambda i: f"Authorization: Bearer {h(i)}",
    }
    bad = {
        "commit": lambda i: f"fixed in commit {h(i)} yesterday", "md5": lambda i: f"md5: {h(i, 32)}  file{i}.iso", "uuid": lambda i: f"request id {h(i, 8)}-{h(i + 1, 4)}-{h(i + 2, 4)}-{h(i + 3, 4)}-{h(i + 4, 12)}",
        "path": lambda i: f"see /usr/share/doc{i}/index/page/v2/readme", "etag": lambda i: f"etag: {h(i, 32)}", "blank": lambda i: "password=your_password_here", "call": lambda i: f"token = make_token({i})",
    }
    rows = [(form, label, f(i)) for label, forms in ((1, good), (0, bad)) for form, f in forms.items() for i in range(30)]
    df = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(df, secrets.train(secrets.labelled_findings(spark))).where("is_secret").collect()}
    share = {form: np.mean([k in hit for k, (g, _, _) in enumerate(rows) if g == form]) for form in [*good, *bad]}
    print(share)
    assert all(share[f] >= 0.9 for f in good) and all(share[f] <= 0.1 for f in bad)


# ---------------------------------------------------------------- op10 and the pipeline


def linked(texts, width, threshold):
    f = Forest()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                f.union(i, j)
    return sets, f


@pytest.mark.parametrize("orders, pairs, levels, weight", [(2, 64, (3, 12), 500_000), (3, 2, (2,), 500_000), (2, 64, (1, 2), 2000), (1, 3, (2, 4), 2000)])
def test_links_are_exact_with_stars_for_common_tokens(spark, monkeypatch, orders, pairs, levels, weight):
    """Boilerplate that most texts share, families of near copies, and short texts of common shingles alone."""
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", pairs)
    stock = [text(25) for _ in range(3)]
    texts = [f"{stock[i % 3]} {text(int(rng.integers(1, 12)))}" for i in range(60)]
    base = text(60)
    texts += [" ".join(w if rng.random() > 0.01 else "zz" for w in base.split()) for _ in range(40)]
    texts += [" ".join(rng.choice(["a", "b", "c"], 6)) for _ in range(60)] + [stock[0], stock[0] + " end", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    sets, f = linked(texts, 4, 85)
    for r in ngram_join.ngram_join(df, 4, 85, orders=orders, task_shingles=weight).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), f.find(r.doc_id))


def test_stages_take_empty_tables_and_odd_columns(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, _h map<string,int>, ids string, n_tokens int, _size int, _node array<int>"
    rows = [(k, t, "en", "s", len(t or ""), {"a": k or 0}, "i", 5, 6, [1]) for k, t in [(1, text(50)), (1, text(40)), (None, text(30)), (None, "two words"), (4, None), (5, "")]]
    rows.append(rows[0])
    full = spark.createDataFrame(rows, cols)
    for name, stage in corpus_pipeline.STAGES:
        for df in (full, full.limit(0)):
            out = stage(spark, df, "")
            assert out.columns[:10] == df.columns, name
            got = out.collect()
            assert len(got) == 0 if df is not full else all((r.ids, r.n_tokens, r._size, list(r._node)) == ("i", 5, 6, [1]) for r in got), name
    kept = corpus_pipeline.drop_near_duplicates(spark, full, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({(r[0], r[1]) for r in rows})
    assert corpus_pipeline.encode_tokens(spark, full, "").columns[10:] == ["ids_", "n_tokens_"]


def test_bitmaps_and_names(spark):
    h = rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)
    for n in (1, 1000, 1 << 40):
        power = bits_for(n)
        bits = np.zeros((1 << power) // 64, np.uint64)
        t = bit_rows(h, power)
        bits[t.column("word").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
        assert in_bitmap(bits, h).all()
    df = spark.range(1).select(F.col("id").alias("A"), F.col("id").alias("a_"))
    assert fresh(df, "a", "b", "b") == ["a__", "b", "b_"]
