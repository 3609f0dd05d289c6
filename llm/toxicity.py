"""Toxicity: a logistic model of word presence with counterfactual regularisation.

Labelled texts that mention a group get a counterfactual in which each group term is swapped for another of the list; the training
loss adds the squared change of the logit between text and counterfactual.  A group term that happens to be frequent in toxic
texts so learns nothing that another group term doesn't, and neutral mentions keep their score.

Training takes at most ``sample`` labelled rows, those of least hash of the id (a documented bound of a classifier's
fit), and of a document that stands in several rows the one text of least hash.  Features are chosen on the executors, by the test of
their rates under the two labels; the driver gets the chosen features alone, a kilobyte a row at most.  Scoring reads every whole
text.  Only the text is an input of a score.

Defined cases: null and empty texts score like a text without words; labels that are null or belong to no document teach nothing;
several different labels of a document each teach; with no labels or only one kind every score is the share of label 1 (0 if none);
rows with the same id are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import checkpointed, hashed_id
from llm.parts import parts
from llm.shingles import mix, word_hashes

BINS = 1 << 20
SAMPLE = 20_000
#: Words whose rates under the two labels differ by fewer standard errors are no features; of the others so many at most are, the strongest.
LEAST_Z = 3.0
MOST_FEATURES = 8192
#: Group terms that are swapped for one another inside a language, with neutral words for people last.
IDENTITY_TERMS = {
    "en": """women men girls boys woman man muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist
        black white asian latino european african american immigrants refugees foreigners immigrant refugee gay lesbian transgender straight
        bisexual disabled deaf blind old young elderly turkish polish russian chinese mexican people persons person""",
    "de": "frauen männer muslime christen juden ausländer flüchtlinge schwarze weiße schwule lesben behinderte leute personen",
    "fr": "femmes hommes musulmans chrétiens juifs étrangers réfugiés noirs blancs gays lesbiennes handicapés personnes gens",
    "es": "mujeres hombres musulmanes cristianos judíos extranjeros refugiados negros blancos homosexuales lesbianas discapacitados personas gente",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


#: Lengths in bytes of the words' beginnings that are features beside the words, for inflected forms.
PREFIXES = (4, 5, 6)


def _hashes(data: bytes, prefixes: tuple[int, ...] = ()):
    return word_hashes(data, _WORD, prefixes)


def _swaps() -> dict[bytes, bytes]:
    """Each term's replacement, a few places on in the list of its language."""
    out: dict[bytes, bytes] = {}
    for terms in IDENTITY_TERMS.values():
        words = [t.encode() for t in terms.split()]
        out |= {w: v for w, v in zip(words, [*words[5:], *words[:5]]) if w not in out}
    return out


_SWAP = _swaps()
_LIST = list(_SWAP)
_TERM = re.compile(rb"(?<![\w\x80-\xff'])(?:" + b"|".join(map(re.escape, _LIST)) + rb")(?![\w\x80-\xff'])")
_END = b"\x00"


def features(texts: list[str | None], swap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of each text, one after another, and the number of bins of each text."""
    raw = [(t or "").lower().replace("\0", " ").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    joined = _END.join(raw) + _END
    if swap:
        joined = _TERM.sub(lambda m: _SWAP[m[0]], joined)
        size = np.fromiter(map(len, joined[:-1].split(_END)), np.int64, len(raw)) + 1
    words, at = _hashes(joined, PREFIXES)
    owner = np.searchsorted(np.cumsum(size), at, "right").astype(np.uint64)
    key = np.unique(owner << np.uint64(20) | mix(words) >> np.uint64(44))
    return (key & np.uint64(BINS - 1)).astype(np.int32), np.bincount((key >> np.uint64(20)).astype(np.int64), minlength=len(raw))


def _featurised(batches):
    for b, texts in parts(batches):
        bins, n = features(texts)
        swapped, m = features(texts, True)
        ends, swapped_ends = np.cumsum(n).tolist(), np.cumsum(m).tolist()
        one = [bins[e - k : e].tobytes() for e, k in zip(ends, n.tolist())]
        two = [swapped[e - k : e].tobytes() for e, k in zip(swapped_ends, m.tolist())]
        two = [None if x == y else y for x, y in zip(one, two)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "key")), pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["doc_id", "toxic", "key", "bins", "swapped"])


def _frequencies(batches):
    """(bin, rows with it, rows of label 1 with it) of a task's rows."""
    df, one = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for b in batches:
        for x, y in zip(b.column("bins").to_pylist(), b.column("toxic").to_pylist()):
            at = np.frombuffer(x, np.int32)
            df[at] += 1
            if y == 1:
                one[at] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at]), pa.array(one[at])], ["bin", "df", "one"])


def chosen(bins: np.ndarray, df: np.ndarray, one: np.ndarray, n: int, n1: int) -> np.ndarray:
    """The bins that are features, ascending: words that tell nothing about the label only let the model learn single rows by heart."""
    p1, p0, p = (one + 0.5) / (n1 + 1), (df - one + 0.5) / (n - n1 + 1), (df + 1) / (n + 2)
    z = np.abs((p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1))))
    ok = (df >= least_rows(n)) & (z >= LEAST_Z)
    bins, z = bins[ok], z[ok]
    return np.sort(bins[np.lexsort((bins, -z))[:MOST_FEATURES]])


def least_rows(n: int) -> int:
    return max(3, n // 500)


def _kept(shared):
    """Each row's features by their places among the chosen ones, as a list of places or a bitmap, whichever is shorter."""

    def pack(x, used):
        if x is None:
            return None
        bins = np.frombuffer(x, np.int32)
        at = np.minimum(np.searchsorted(used, bins), max(len(used) - 1, 0))
        at = at[used[at] == bins].astype(np.uint16) if len(used) else np.zeros(0, np.uint16)
        if 2 * len(at) <= len(used) // 8:
            return b"l" + at.tobytes()
        bits = np.zeros(len(used), bool)
        bits[at] = True
        return b"b" + np.packbits(bits).tobytes()

    def run(batches):
        used = shared.value
        for b in batches:
            cols = [pa.array([pack(x, used) for x in b.column(c).to_pylist()], pa.binary()) for c in ("bins", "swapped")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *cols], ["toxic", "bins", "swapped"])

    return run


def _places(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint16, offset=1).astype(np.int64) if packed[:1] == b"l" else np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))


class _Rows:
    """Presence features of rows, as one vector of columns and row starts."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(c) for c in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], size)


def descend(y: np.ndarray, rows: list[np.ndarray], swapped: list[np.ndarray | None], size: int, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the intercept, by gradient descent with momentum terms on the regularised loss.

    ``rows`` are the features of each text, ``swapped`` those of its counterfactual (None where it is the same).
    """
    share = float(y.mean())
    differ = [i for i, other in enumerate(swapped) if other is not None]
    x, pair, other = _Rows(rows), _Rows([rows[i] for i in differ]), _Rows([swapped[i] for i in differ])
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -40, 40))) - y) / len(y)
        grad = x.back(g, size) + l2 * w
        if differ:
            change = (pair.dot(w) - other.dot(w)) * (2 * counterfactual / len(differ))
            grad += pair.back(change, size) - other.back(change, size)
        grad = np.append(grad, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def constant(share: float) -> tuple[np.ndarray, float]:
    """The model whose every score is ``share``."""
    return np.zeros(BINS), float(np.log(share / (1 - share))) if 0 < share < 1 else np.inf if share else -np.inf


def fit(y: np.ndarray, rows: list[np.ndarray], swapped: list[np.ndarray], **kw) -> tuple[np.ndarray, float]:
    """Weights of all bins and the intercept from the bins of each text and of its counterfactual."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return constant(share)
    flat = np.concatenate(rows)
    df, one = np.bincount(flat, minlength=BINS), np.bincount(flat, np.repeat(y, [len(r) for r in rows]), BINS)
    used = chosen(np.arange(BINS), df, one, len(y), int(y.sum()))
    place = lambda r: np.flatnonzero(np.isin(used, r))
    same = [len(a) == len(b) and (a == b).all() for a, b in zip(rows, swapped)]
    w, b = descend(y, [place(r) for r in rows], [None if s else place(r) for s, r in zip(same, swapped)], len(used), **kw)
    weights = np.zeros(BINS)
    weights[used] = w
    return weights, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from at most ``sample`` labelled rows; only their chosen features come to the driver, never texts."""
    some = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.xxhash64("text").alias("key"), "text")
    rows = checkpointed(rows.mapInArrow(_featurised, "doc_id bigint, toxic int, key bigint, bins binary, swapped binary"))
    # one text of a document teaches: copies of the id do not widen the sample
    first = rows.groupBy("doc_id").agg(F.min("key").alias("key"))
    rows = checkpointed(rows.join(first, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "toxic"]))
    n, n1 = rows.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not 0 < n1 < n:
        return constant(n1 / n if n else 0.0)
    t = rows.select("bins", "toxic").mapInArrow(_frequencies, "bin int, df bigint, one bigint").groupBy("bin").agg(F.sum("df").alias("df"), F.sum("one").alias("one")).where(F.col("df") >= least_rows(n)).toArrow()
    used = chosen(*(t[c].to_numpy() for c in ("bin", "df", "one")), n, n1)
    shared = docs.sparkSession.sparkContext.broadcast(used)
    t = rows.select("toxic", "bins", "swapped").mapInArrow(_kept(shared), "toxic int, bins binary, swapped binary").toArrow()
    one, two = t["bins"].to_pylist(), t["swapped"].to_pylist()
    y = (t["toxic"].to_numpy() == 1).astype(float)
    order = sorted(range(len(y)), key=lambda i: (y[i], one[i], two[i] or b""))  # whatever order the rows come in
    w, b = descend(y[order], [_places(one[i]) for i in order], [None if two[i] is None else _places(two[i]) for i in order], len(used))
    weights = np.zeros(BINS)
    weights[used] = w
    return weights, b


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches):
        weights, b = shared.value
        for piece, texts in parts(batches):
            bins, n = features(texts)
            z = np.bincount(np.repeat(np.arange(len(n)), n), weights[bins].astype(float), len(n)) + b
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; labels of the held-out fold are not read."""
    model = train(docs, labels.where(hashed_id() % folds != held), sample)
    out = score(docs, model)
    return out.select("doc_id", (hashed_id() % folds == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
