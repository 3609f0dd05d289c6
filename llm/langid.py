"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language are summed over all training rows.  Languages are dealt into blocks; a block's matrix of log
probabilities (bins x languages, a fixed number of bins) is broadcast, and texts are scored in sparse batches: the n-grams of many
texts are one index vector, its matrix rows are summed text by text.  A few languages are one block and one pass; more of them are
scored block after block, each pass carrying the best language so far and the sum of all likelihoods, so their number has no limit.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learned;
rows with null language teach nothing; equal posteriors go to the first language in code-point order; rows with the same id are rows
of their own; a null id counts as the text 'null' in the split; a long text is counted in segments; an empty table gives an empty
result; other columns are ignored, or pass through ``keep_identified`` unchanged whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import checkpointed, fresh, hashed_id, release
from llm.parts import parts

BINS = 1 << 15
ORDERS = (1, 2, 3)
SLICES = 16
#: Languages of a block, about (256 KB each), and of a task's counts before they are passed on.
BLOCK_LANGS = 128
PART = 400_000
#: Characters of a long text that are counted at once.
SEGMENT = 200_000
UNKNOWN = "und"

_FACTOR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _windows(code: np.ndarray) -> list[np.ndarray]:
    """Bins of the n-grams of each order that start at each character; zeros follow the last."""
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = code if n == 1 else np.r_[code[n - 1 :], np.zeros(n - 1, np.uint64)][: len(code)]
        h = (h + shifted + np.uint64(n)) * _FACTOR[(n - 1) % 3]
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint64(29))) * _FACTOR[0] >> np.uint64(64 - 15)).astype(np.int32))
    return out


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_bins(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bins of the n-grams of each order, text after text, and where each text starts.

    Every text ends in a zero character, so n-grams that pass its end mark that end; n-grams of the next text are never mixed in.
    """
    lowered = [(t or "").lower() + "\0\0" for t in texts]
    code = _code("".join(lowered))
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    out = _windows(code)
    # at the two zero characters, longer n-grams would reach into the next text
    edge = np.r_[starts[1:], len(code)] if len(texts) else np.zeros(0, np.int64)
    for k, n in enumerate(ORDERS):
        for back in range(1, n):
            out[k][edge - back] = 0
    return out, starts


def long_counts(text: str) -> np.ndarray:
    """Number of n-grams in each bin, of a text of any length."""
    text, total, at = text.lower(), np.zeros(BINS, np.int64), 0
    while len(text) - at > SEGMENT + max(ORDERS):
        for x in _windows(_code(text[at : at + SEGMENT + max(ORDERS) - 1])):
            total += np.bincount(x[:SEGMENT], minlength=BINS)
        at += SEGMENT
    for x in gram_bins([text[at:]])[0]:
        total += np.bincount(x, minlength=BINS)
    return total


# ---------------------------------------------------------------- counts


def _packed(v: np.ndarray) -> bytes:
    at = np.flatnonzero(v)
    return b"s" + at.astype(np.uint16).tobytes() + v[at].tobytes() if 5 * len(at) < 4 * len(v) else b"d" + v.tobytes()


def _unpacked(blob: bytes, into: np.ndarray) -> None:
    if blob[:1] == b"d":
        into += np.frombuffer(blob, np.int64, offset=1)
    else:
        n = (len(blob) - 1) // 10
        into[np.frombuffer(blob, np.uint16, n, 1)] += np.frombuffer(blob[1 + 2 * n :], np.int64)


def _count(batches):
    release()
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def out():
        rows = [(lang, i, docs[lang] if i == 0 else 0, _packed(c)) for lang, v in counts.items() for i, c in enumerate(np.split(v, SLICES))]
        counts.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["lang", "slice", "n", "blob"])

    for b, texts in parts(batches, "text", PART):
        by: dict[str, list[str]] = {}
        for t, lang in zip(texts, b.column("lang").to_pylist()):
            by.setdefault(lang, []).append(t)
        for lang, some in by.items():
            c = counts.setdefault(lang, np.zeros(BINS, np.int64))
            docs[lang] = docs.get(lang, 0) + len(some)
            for t in some:
                if len(t) > SEGMENT:
                    c += long_counts(t)
            for x in gram_bins([t for t in some if len(t) <= SEGMENT])[0]:
                c += np.bincount(x, minlength=BINS)
        if len(counts) > BLOCK_LANGS:
            yield out()
    yield out()


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BINS // SLICES, np.int64)
    for x in pdf["blob"]:
        _unpacked(x, total)
    return pd.DataFrame({c: [pdf[c].iat[0]] for c in pdf.columns if c not in ("n", "blob")} | {"n": [int(pdf["n"].sum())], "blob": [_packed(total)]})


def train(labelled: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (languages, log probabilities (bins x languages), log priors), from all rows (text, lang)."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, slice int, n bigint, blob binary")
    # in two levels, so that no group gathers a vector of every task
    one = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256))).groupBy("lang", "slice", "part").applyInPandas(_add, "lang string, slice int, part int, n bigint, blob binary")
    t = checkpointed(one.drop("part").groupBy("lang", "slice").applyInPandas(_add, "lang string, slice int, n bigint, blob binary"))
    total, docs = t.where("slice = 0").agg(F.count("*"), F.sum("n")).first()
    blocks = -(-total // BLOCK_LANGS)
    made = [_block(t.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k), docs) for k in range(blocks)]
    return [b for b in made if len(b[0])]


def _block(t: DataFrame, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = t.toArrow()
    lang, part, blob, n = (a[c].to_pylist() for c in ("lang", "slice", "blob", "n"))
    langs = sorted(set(lang))
    place = {x: i for i, x in enumerate(langs)}
    counts, size = np.zeros((len(langs), BINS)), np.zeros(len(langs))
    step = BINS // SLICES
    for x, k, v, c in zip(lang, part, blob, n):
        _unpacked(v, counts[place[x], k * step : (k + 1) * step])
        size[place[x]] += c
    smooth = counts + 0.5
    logp = np.log(smooth) - np.log(smooth.sum(1, keepdims=True))
    return np.array(langs, object), np.ascontiguousarray(logp.T), np.log(size / docs)


# ---------------------------------------------------------------- scores


def _totals(texts: list[str | None], logp: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log likelihood and prior of each text (rows) and language."""
    total = np.empty((len(texts), len(prior)))
    long = np.fromiter((t is not None and len(t) > SEGMENT for t in texts), bool, len(texts))
    for i in np.flatnonzero(long).tolist():
        total[i] = prior + long_counts(texts[i]) @ logp
    short = np.flatnonzero(~long)
    if len(short):
        bins, starts = gram_bins([texts[i] for i in short.tolist()])
        total[short] = sum((np.add.reduceat(logp[x], starts, axis=0) for x in bins), prior[None, :])
    return total


def _judge(shared, names: list[str], first: bool):
    """The columns of a batch, with the best language so far, its log value and the log of the sum over all languages so far."""

    def run(batches):
        langs, logp, prior = shared.value
        for b, texts in parts(batches, "text", max(PART * 8 // max(len(prior), 8), 20_000)):
            total = _totals(texts, logp, prior)
            at = total.argmax(1)
            best, lang = total[np.arange(len(at)), at], langs[at]
            whole = best + np.log(np.exp(total - best[:, None]).sum(1))
            cols = list(b.columns)
            if not first:
                old_lang, old_best, old_whole = cols[-3].to_pylist(), cols[-2].to_numpy(), cols[-1].to_numpy()
                keep = np.fromiter((o > n or (o == n and x < y) for o, n, x, y in zip(old_best, best, old_lang, lang)), bool, len(at))
                best, whole = np.where(keep, old_best, best), np.logaddexp(whole, old_whole)
                lang = np.where(keep, np.array(old_lang, object), lang)
                cols = cols[:-3]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang.tolist(), pa.string()), pa.array(best), pa.array(whole)], [*b.schema.names[: len(cols)], *names])

    return run


def judged(docs: DataFrame, blocks: list, lang_col: str, score_col: str) -> DataFrame:
    """``docs`` with the predicted language and its posterior in two new columns."""
    top, whole = fresh(docs.select(*docs.columns, F.lit(0).alias(lang_col), F.lit(0).alias(score_col)), "_top", "_whole")
    schema = T.StructType([*docs.schema, T.StructField(lang_col, T.StringType()), T.StructField(top, T.DoubleType()), T.StructField(whole, T.DoubleType())])
    out = docs
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = (checkpointed(out) if k else out).mapInArrow(_judge(shared, [lang_col, top, whole], k == 0), schema)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not blocks:
        return docs.withColumns({lang_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    return out.withColumns({lang_col: F.when(letters, F.col(lang_col)).otherwise(UNKNOWN), score_col: F.when(letters, F.exp(F.col(top) - F.col(whole))).otherwise(0.0)}).drop(top, whole)


def language_id(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows whose crc32 remainder is ``held`` teach nothing."""
    blocks = train(docs.where(hashed_id() % folds != held))
    out = judged(docs.select("doc_id", "text"), blocks, "lang_pred", "score")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (hashed_id() % folds == held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: no letters, or a best posterior below ``least``.

    The decision is made beside the row, so rows with equal ids are judged one by one and no join is needed.
    """
    lang, score = fresh(docs, "_lang", "_score")
    return judged(docs, train(docs.where(hashed_id() % 5 != 0)), lang, score).where(F.col(score) >= least).select(*docs.columns)
