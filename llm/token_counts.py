"""Token counts by a two-tier lookup on the map side.

First tier: a compact hash table (open addressing; 64-bit hashes and 16-bit lengths) of the most frequent pre-tokens of the whole
corpus, broadcast to all workers.  Each task sums up its own most frequent pre-tokens in one bounded row, and these summaries are
merged in a tree; pre-tokens themselves are never shuffled.  Second tier: pre-tokens that the table lacks are encoded by the
tokenizer's library, once per worker cache.  The tables decide only what a count costs; every count is exact.

Defined cases: null text is empty text, with no tokens; strings of special tokens inside a text are one token each, as is the library's
default; rows with the same id are rows of their own; long pieces are counted but not kept, so that caches are bounded in bytes;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import pickle
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import CACHE, LONG, read_file, units
from llm.common import KEPT, checkpointed
from llm.parts import parts

#: Pre-tokens of the broadcast table, those that a task or a merge of tasks names for it, and summaries merged at once.
TABLE = 32_768
PER_TASK = 4_096
PER_MERGE = 65_536
FAN = 16


def _hash(words: list[str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class HashTable:
    """64-bit hashes to 16-bit values in two flat arrays, by open addressing with linear probing."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        h, v = np.where(hashes == 0, np.uint64(1), hashes), values
        at = h & self.mask
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = h[free[first]], v[free[first]]
            rest = np.flatnonzero(self.keys[at] != h)  # an equal hash that stands already is done
            h, v, at = h[rest], v[rest], (at[rest] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        h = np.where(hashes == 0, np.uint64(1), hashes)
        todo, at = np.arange(len(h)), h & self.mask
        while len(todo):
            k = self.keys[at]
            hit = k == h[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (k != 0)
            todo, at = todo[go], (at[go] + np.uint64(1)) & self.mask
        return out


class Lengths:
    """Numbers of tokens of pieces of text, with bounded caches; one per Python worker."""

    def __init__(self, spec: str, pattern: str, table: HashTable) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.pattern = pattern
        self.find = regex.compile(pattern).findall
        self.table = table
        special = sorted((t["content"] for t in json.loads(spec).get("added_tokens") or []), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def of_words(self, words: list[str]) -> dict[str, int]:
        out = {w: n for w, n in zip(words, self.table.find(_hash(words)).tolist()) if n >= 0}
        if len(self.words) > CACHE:
            self.words.clear()
        new = [w for w in words if w not in out and w not in self.words]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.words.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        out.update((w, self.words[w]) for w in words if w not in out)
        for w in new:
            if len(w) > LONG:
                del self.words[w]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        extra = [0] * len(texts)
        pieces: list[list[str]] = []
        for i, t in enumerate(texts):
            if self.special and self.special.search(t):
                between = self.special.split(t)
                extra[i] = len(between) - 1
                pieces.append(between)
            else:
                pieces.append([t])
        flat = [p for ps in pieces for p in ps]
        split = [[p] if (u := units(p, self.pattern)) is None else u for p in flat]
        long = [(self.first, self._learn({s[0] for s in split}, self.first, ""))]
        later: set[str] = set()
        for s in split:
            later.update(s[1:])
        long.append((self.later, self._learn(later, self.later, " ")))
        get, first = self.later.__getitem__, self.first
        n = iter([first[s[0]] + sum(map(get, s[1:])) for s in split])
        out = [e + sum(next(n) for _ in ps) for e, ps in zip(extra, pieces)]
        for cache, some in long:
            for p in some:
                del cache[p]
        return out

    def _learn(self, wanted: set[str], cache: dict[str, int], lead: str) -> list[str]:
        """Puts what is wanted into the cache; the pieces that are too long to stay there."""
        new = wanted - cache.keys()
        if len(cache) + len(new) > 2 * CACHE:
            cache.clear()
            new = wanted
        new = list(new)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            split = [self.find(lead + p) for p in part]
            n = self.of_words(list({w for s in split for w in s}))
            for p, s in zip(part, split):
                cache[p] = sum(map(n.__getitem__, s))
        return [p for p in new if len(p) > LONG]


def _frequent(pattern: str):
    def run(batches):
        find = regex.compile(pattern).findall
        starts: Counter = Counter()
        later: Counter = Counter()
        words: Counter = Counter()

        def fold():
            for pieces, lead in ((starts, ""), (later, " ")):
                for p, c in pieces.items():
                    for w in find(lead + p):
                        if len(w) <= LONG:
                            words[w] += c
                pieces.clear()

        for _, texts in parts(batches):
            for t in filter(None, texts):
                u = units(t, pattern)
                if u is None:
                    words.update(w for w in find(t) if len(w) <= LONG)
                else:
                    starts[u[0]] += 1
                    later.update(u[1:])
            if len(starts) + len(later) > CACHE:
                fold()
            if len(words) > 2 * CACHE:  # the rare ones go: they would not come into the summary
                kept = dict(words.most_common(CACHE))
                words.clear()
                words.update(kept)
        fold()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(words.most_common(PER_TASK))], pa.binary())], ["summary"])

    return run


def _merged(summaries) -> list[tuple[str, int]]:
    total: Counter = Counter()
    for s in summaries:
        for w, c in pickle.loads(s):
            total[w] += c
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"no": [int(pdf["no"].iat[0])], "summary": [pickle.dumps(_merged(pdf["summary"])[:PER_MERGE])]})


def frequent(docs: DataFrame, pattern: str, most: int = TABLE) -> list[str]:
    """The most frequent pre-tokens over all texts, by the tasks' bounded summaries: one row a task, merged FAN at a time."""
    rows = checkpointed(docs.select("text").mapInArrow(_frequent(pattern), "summary binary").withColumn("no", F.spark_partition_id().cast("long")))
    left = rows.count()
    while left > FAN * FAN:
        rows = checkpointed(rows.withColumn("no", F.floor(F.col("no") / FAN)).groupBy("no").applyInPandas(_merge, "no bigint, summary binary"))
        left = rows.count()
    if left > FAN:
        rows = rows.withColumn("no", F.floor(F.col("no") / FAN)).groupBy("no").applyInPandas(_merge, "no bigint, summary binary")
    return [w for w, _ in _merged(r[0] for r in rows.select("summary").collect())[:most]]


_lengths: dict = {}
KEPT.append(_lengths)


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    spec = read_file(spark, tokenizer_path).decode("utf-8")
    words = frequent(docs, pattern)
    known = Lengths(spec, pattern, HashTable(np.zeros(0, np.uint64), np.zeros(0, np.uint16))).of_words(words)
    table = HashTable(_hash(words), np.array([known[w] for w in words], np.uint16))  # LONG characters are at most so many tokens
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, spec, pattern, table))

    def run(batches):
        key, *model = shared.value
        if key not in _lengths:  # a worker keeps its caches over the tasks of a query
            _lengths.clear()
            _lengths[key] = Lengths(*model)
        lengths = _lengths[key]
        for b, texts in parts(batches):
            texts = [t or "" for t in texts]
            n = np.array(lengths.counts(texts), np.int64)
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
