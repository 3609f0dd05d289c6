"""Substring dedup by content-defined chunks.

A gear hash rolls over the last 16 bytes; a chunk ends where its top bits are zero, so an insertion moves only the chunks
around it.  Chunks are known by a 64-bit digest.  Within a task each later occurrence of a digest is settled on the spot, so one row per
digest and task meets in a bucket, however common the chunk.  Neighbouring repeated chunks are joined to runs, and runs of
at least ``least_words`` words, or of LEAST_BYTES bytes where few spaces divide them, are the result: short coincidences and stock
lines stay.

Defined cases: null and empty texts have no chunks; rows with a null id are left out, as the result could not name them; rows with
equal id and text are one text, with equal id and other text texts of their own (``text_key`` tells them apart); an empty table gives an
empty result; other columns are ignored.  Of equal passages the one in the smallest (doc_id, position) is the one kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import fresh
from llm.parts import parts
from llm.shingles import mix

LEAST, MOST = 16, 256
CUT_BITS = 4
LEAST_WORDS = 20
#: A run of so many bytes counts whatever its words, for text without spaces between words.
LEAST_BYTES = 400
BUCKET_CHUNKS = 1_000_000
#: Chunks that a task settles at once.
HELD = 4_000_000

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(MOST, _FACTOR, np.uint64)])
RECORD = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("end", "<i4"), ("words", "<i4"), ("ref", "<i8"), ("kept", "<i1")])
_WINDOW = 16


def chunk_records(ids: list[int], texts: list[bytes]) -> np.ndarray:
    """Chunks of all texts, in order."""
    data = np.frombuffer(b"".join(bytes(_WINDOW) + t for t in texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(size + _WINDOW) - size
    h = _GEAR[data]
    for k in (1, 2, 4, 8):  # the hash of 2k bytes from two of k bytes
        h[k:] += h[:-k] << np.uint32(k)
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    space = _SPACE[data]
    words = np.cumsum(~space & np.r_[True, space[:-1] | (data[:-1] == 0)])
    first = np.searchsorted(cuts, base)
    last = np.searchsorted(cuts, base + size)
    starts, ends, owner = [], [], []
    cuts = cuts.tolist()
    for i, (b, n, lo, hi) in enumerate(zip(base.tolist(), size.tolist(), first.tolist(), last.tolist())):
        at, before = b, len(ends)
        for c in [*cuts[lo:hi], b + n]:
            while c - at > MOST:
                starts.append(at)
                at += MOST
                ends.append(at)
            if c - at >= LEAST or (c == b + n and c > at):
                starts.append(at)
                ends.append(c)
                at = c
        owner.append(len(ends) - before)
    out = np.zeros(len(starts), RECORD)
    if not len(out):
        return out
    s, e = np.array(starts, np.int64), np.array(ends, np.int64)
    count = np.array(owner, np.int64)
    length = e - s
    inside = np.ones(len(data), bool)
    for b in base.tolist():
        inside[b - _WINDOW : b] = False
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[at]
    out["digest"] = mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    out["doc"] = np.repeat(np.array(ids, np.int64), count)
    shift = np.repeat(base, count)
    out["start"], out["end"] = s - shift, e - shift
    out["words"] = words[e - 1] - np.where(s > 0, words[s - 1], 0)
    # a text's key: its chunks' digests in order
    place = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    mixed = mix(out["digest"] ^ mix(place.astype(np.uint64)))
    some = count > 0
    key = np.zeros(len(count), np.uint64)
    key[some] = np.add.reduceat(mixed, (np.cumsum(count) - count)[some])
    out["key"] = np.repeat(key.view(np.int64), count)
    return out


def _settle(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one record per digest, later occurrences with ``ref`` set), after equal texts of one id became one."""
    r = r[np.lexsort((r["start"], r["key"], r["doc"], r["digest"]))]
    same = np.r_[False, r["digest"][1:] == r["digest"][:-1]] if len(r) else np.zeros(0, bool)
    twice = same & np.r_[False, (r["doc"][1:] == r["doc"][:-1]) & (r["key"][1:] == r["key"][:-1]) & (r["start"][1:] == r["start"][:-1])] if len(r) else same
    r, same = r[~twice], same[~twice]
    group = np.cumsum(~same) - 1
    heads = r[~same]
    later = r[same].copy()
    later["ref"] = heads["doc"][group[same]]
    return heads, later


def _by_bucket(r: np.ndarray, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    o = np.argsort(bucket, kind="stable")
    r, bucket = r[o], bucket[o]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(r)] if len(r) else [0]
    return pa.RecordBatch.from_arrays([pa.array([kind] * (len(cut) - 1), pa.int32()), pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array([r[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["kind", "bucket", "records"])


def _doc_bucket(r: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(r["doc"].astype(np.uint64) + r["key"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _chunks(buckets: int):
    def run(batches):
        held: list[np.ndarray] = []

        def out():
            heads, later = _settle(np.concatenate(held))
            held.clear()
            # a digest that occurs twice here is repeated wherever else it is or is not
            hot = np.isin(heads["digest"], later["digest"])
            heads["words"][hot] |= 1 << 30
            yield _by_bucket(heads, (heads["digest"] % np.uint64(buckets)).astype(np.int64), 0)
            yield _by_bucket(later, _doc_bucket(later, buckets), 1)

        for b, texts in parts(batches):
            ids = b.column("doc_id").to_pylist()
            some = [i for i, (d, t) in enumerate(zip(ids, texts)) if d is not None and t]
            if some:
                held.append(chunk_records([ids[i] for i in some], [texts[i].encode("utf-8", "surrogatepass") for i in some]))
            if sum(map(len, held)) > HELD:
                yield from out()
        if held:
            yield from out()

    return run


def _repeated(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.frombuffer(b"".join(pdf["records"]), RECORD).copy()
        if pdf["kind"].iat[0] == 0:
            hot = r["digest"][r["words"] >> 30 > 0]
            r["words"] &= (1 << 30) - 1
            heads, later = _settle(r)
            heads = heads[np.isin(heads["digest"], hot) | np.isin(heads["digest"], later["digest"])]
            heads["kept"], heads["ref"] = 1, heads["doc"]
            r = np.concatenate([heads, later])
        batch = _by_bucket(r, _doc_bucket(r, buckets), 0)
        return pd.DataFrame({"bucket": batch.column("bucket").to_numpy(), "records": batch.column("records").to_pylist()})

    return run


def _runs(least_words: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.frombuffer(b"".join(pdf["records"]), RECORD)
        r = r[np.lexsort((r["ref"], r["kept"], r["start"], r["key"], r["doc"]))]
        # a repeated row's chunks come once from each task that held it
        r = r[np.r_[True, (r["doc"][1:] != r["doc"][:-1]) | (r["key"][1:] != r["key"][:-1]) | (r["start"][1:] != r["start"][:-1])]]
        new = np.r_[True, (r["doc"][1:] != r["doc"][:-1]) | (r["key"][1:] != r["key"][:-1]) | (r["kept"][1:] != r["kept"][:-1]) | (r["start"][1:] != r["end"][:-1])]
        at = np.flatnonzero(new)
        words = np.add.reduceat(r["words"], at)
        end = r["end"][np.r_[at[1:], len(r)] - 1]
        ok = (words >= least_words) | (end - r["start"][at] >= LEAST_BYTES)
        f = r[at[ok]]
        return pd.DataFrame({"doc_id": f["doc"].astype(np.int64), "start_byte": f["start"].astype(np.int64), "end_byte": end[ok].astype(np.int64), "n_words": words[ok].astype(np.int64), "first_doc_id": f["ref"].astype(np.int64), "kept": f["kept"] == 1, "text_key": f["key"].astype(np.int64)})

    return run


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of repeated chunks: doc_id, start_byte, end_byte (UTF-8), n_words, first_doc_id (a document with an earlier occurrence), kept, text_key."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // (2 << CUT_BITS) // BUCKET_CHUNKS) + 1)
    chunks = source.mapInArrow(_chunks(buckets), "kind int, bucket int, records binary")
    met = chunks.groupBy("kind", "bucket").applyInPandas(_repeated(buckets), "bucket int, records binary")
    return met.groupBy("bucket").applyInPandas(_runs(least_words), "doc_id bigint, start_byte bigint, end_byte bigint, n_words bigint, first_doc_id bigint, kept boolean, text_key bigint")


def drop_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, others) with the repeated runs that are not kept cut out of the text.

    Rows with equal ids and other texts are matched by the text's key, which is computed beside the row; other columns pass
    unchanged, whatever their names.
    """
    key, doc, other, cuts = fresh(docs, "_key", "_doc", "_other", "_spans")
    spans = repeated_spans(docs, least_words).where("not kept").groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(other))
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(cuts))
    schema = docs.schema

    def keyed(batches):
        for b, texts in parts(batches):
            keys = []
            for d, t in zip(b.column("doc_id").to_pylist(), texts):
                r = chunk_records([d or 0], [t.encode("utf-8", "surrogatepass")]) if t else []
                keys.append(int(r["key"][0]) if len(r) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, key])

    rows = docs.mapInArrow(keyed, T.StructType([*schema, T.StructField(key, T.LongType())]))
    joined = rows.join(spans, (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(other)), "left")

    def cut(batches):
        for b, texts in parts(batches):
            out = []
            for t, some in zip(texts, b.column(cuts).to_pylist()):
                if some and t is not None:
                    raw, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
                    for s in some:
                        kept.append(raw[at : s["start_byte"]])
                        at = s["end_byte"]
                    t = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in schema.names], schema.names)

    return joined.drop(doc, other, key).mapInArrow(cut, schema)
