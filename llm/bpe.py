"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

The corpus's pre-tokens are counted once: each task names its distinct ones, and those that several tasks hold are, up to a bound
on the table, replayed once for the whole corpus and their ids broadcast.  Words of a single task gain nothing from that, and ids of
all words could only come back to their texts by a shuffle of every text; so a word that the table lacks is replayed by the worker
that meets it, once a cache.  Either replay lays its words out as one vector of symbols with links to their neighbours.  An inverted
index from the rank of a token pair to the positions where it stands applies every merge in rank order over all these words at
once; a merge touches only its two neighbours, whose new pairs enter the index.  Texts are then put together from their words'
ids.  Tables and caches decide what an id costs, never which id it is.  Ranks, pattern and file path are parameters; nothing is trained.

Defined cases: null text is empty text, with no ids; every text round-trips to its UTF-8 bytes; rows with the same id are rows
of their own; an empty table gives an empty result; other columns pass ``encode`` and ``decode`` unchanged, and a new column whose
name is taken gets underscores at its end; ``round_trip`` ignores them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import KEPT, fresh, trim
from llm.parts import PART_BYTES, parts

#: Entries in each of a worker's caches, which are emptied when they are full.
CACHE = 800_000
#: Bytes of words replayed at once (one longer word is replayed alone), and pieces looked up at once.
REPLAY_BYTES = 200_000
LEARN_PIECES = 20_000
#: Characters of a piece that is kept in a cache; longer ones are encoded wherever they occur, so that caches are bounded in bytes.
LONG = 64
#: Words whose ids are broadcast (no longer than LONG characters each), and distinct pieces that a task holds while it looks for words.
TABLE_WORDS = 65_536
HELD_PIECES = 150_000
#: Fixed value: the pattern for which a cut at a space before a character that is no white space is a cut between pre-tokens.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_UNSAFE = re.compile(r" (?:\s|\Z)")


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file (some MB) by any path that Spark or this machine can read."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def units(text: str, pattern: str = SPACED) -> list[str] | None:
    """The pieces of ``text`` between single spaces, or None where such a cut might not be a cut between pre-tokens.

    Under SPACED a space before a character that is no white space always starts a pre-token, which is what lets whole pieces be
    looked up; under another pattern no cut is taken.
    """
    return None if pattern != SPACED or _UNSAFE.search(text) else text.split(" ")


class Replay:
    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE) -> None:
        self.ranks = ranks
        self.cache = cache
        size = max(ranks.values(), default=-1) + 1
        self.vocab = [b""] * size
        for k, v in ranks.items():
            self.vocab[v] = k
        self.pieces = np.empty(size, object)  # the same, to be taken by an array of ids
        self.pieces[:] = self.vocab
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.known: dict[int, int] = {}

    def _rank(self, a: int, b: int) -> int:
        """Rank of the pair, or -1."""
        key = a << 32 | b
        r = self.known.get(key)
        if r is None:
            r = self.known[key] = self.ranks.get(self.vocab[a] + self.vocab[b], -1)
        return r

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is None and w:
                rest.append(i)
            else:
                out[i] = np.array([] if whole is None else [whole], "<u4")
        at = 0
        while at < len(rest):
            to, size = at + 1, len(words[rest[at]])
            while to < len(rest) and size + len(words[rest[to]]) <= REPLAY_BYTES:
                size += len(words[rest[to]])
                to += 1
            for i, ids in zip(rest[at:to], self._replay([words[i] for i in rest[at:to]])):
                out[i] = ids
            at = to
        return out

    def _replay(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.cache:
            self.known.clear()
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        raw = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(raw)
        nxt = np.arange(1, n + 1)
        nxt[end - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[end - size] = -1
        # the index at the start: positions by rank of the pair of bytes that stands there
        pair = raw[:-1] << 32 | raw[1:]
        inner = np.flatnonzero(nxt[:-1] >= 0)
        code, inverse = np.unique(pair[inner], return_inverse=True)
        rank = np.array([self._rank(c >> 32, c & 0xFFFFFFFF) for c in code.tolist()], np.int64)
        mine = rank[inverse] if len(code) else np.zeros(0, np.int64)
        inner, mine = inner[mine >= 0], mine[mine >= 0]
        order = np.argsort(mine, kind="stable")
        inner, mine = inner[order], mine[order]
        cut = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
        places, ends = inner.tolist(), np.r_[cut, len(inner)].tolist()
        index = {r: places[a:b] for r, a, b in zip(mine[cut].tolist(), ends, ends[1:])}
        heap = list(index)
        heapq.heapify(heap)
        sym, nxt, prv = raw.tolist(), nxt.tolist(), prv.tolist()
        odd: list[int] = []
        of, get = self._rank, self.known.get
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            places.sort()
            for p in places:
                a = sym[p]
                if a < 0:
                    continue
                q = nxt[p]
                if q < 0 or get(a << 32 | sym[q]) != r:  # every pair that stands here has been asked for
                    continue
                sym[p] = r
                sym[q] = -1
                after = nxt[p] = nxt[q]
                before = prv[p]
                if after >= 0:
                    prv[after] = p
                    new = get(r << 32 | sym[after])
                    if new is None:
                        new = of(r, sym[after])
                    if new >= 0:
                        if new < r:
                            odd.append(p)
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                if before >= 0:
                    new = get(sym[before] << 32 | r)
                    if new is None:
                        new = of(sym[before], r)
                    if new >= 0:
                        if new < r:
                            odd.append(p)
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heapq.heappush(heap, new)
        flat = np.array(sym, np.int64)
        live = flat >= 0
        count = np.add.reduceat(live.astype(np.int64), end - size)
        every, ends = flat[live].astype("<u4"), np.r_[0, np.cumsum(count)].tolist()
        ids = [every[a:b] for a, b in zip(ends, ends[1:])]
        # a merge that makes a pair of lower rank must be followed by that pair before its own rank goes on
        for i in np.unique(np.searchsorted(end, odd, "right")).tolist():
            ids[i] = self.plain(words[i])
        return ids

    def plain(self, word: bytes) -> np.ndarray:
        """One word, always by the lowest and leftmost pair."""
        ids = [self.ranks[bytes([c])] for c in word]
        while len(ids) > 1:
            r, at = min(((x, i) for i in range(len(ids) - 1) if (x := self._rank(ids[i], ids[i + 1])) >= 0), default=(-1, 0))
            if r < 0:
                break
            ids[at : at + 2] = [r]
        return np.array(ids, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids].tolist())


class Encoder:
    """Texts to ids with a bounded cache of pieces; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE, table: dict[str, bytes] | None = None) -> None:
        self.cache = cache
        self.pattern = pattern
        self.table = table or {}
        self.replay = Replay(ranks, cache)
        self.find = regex.compile(pattern).findall
        self.first: dict[str, bytes] = {}  # ids of pieces at the start of a text
        self.later: dict[str, bytes] = {}  # of pieces after a space
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], into: dict[str, bytes], lead: str) -> None:
        for k in range(0, len(pieces), LEARN_PIECES):
            part = pieces[k : k + LEARN_PIECES]
            split = [self.find(lead + p) for p in part]
            if len(self.words) > self.cache:
                self.words.clear()
            known, table = self.words, self.table
            fresh_words = list({w for s in split for w in s} - known.keys() - table.keys())
            known.update(zip(fresh_words, (x.tobytes() for x in self.replay.words([w.encode("utf-8", "replace") for w in fresh_words]))))
            for p, s in zip(part, split):
                ids = [known[w] if w in known else table[w] for w in s]
                into[p] = ids[0] if len(ids) == 1 else b"".join(ids)
            for w in fresh_words:
                if len(w) > LONG:
                    del known[w]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.later) > self.cache:
            self.later.clear()
        if len(self.first) > self.cache // 4:
            self.first.clear()
        split = [units(t, self.pattern) for t in texts]
        # where no cut is safe, the whole text is one piece
        split = [[t] if s is None else s for s, t in zip(split, texts)]
        new = {s[0] for s in split} - self.first.keys()
        self._learn(list(new), self.first, "")
        later = set()
        for s in split:
            later.update(s[1:])
        later -= self.later.keys()
        self._learn(list(later), self.later, " ")
        get, first = self.later.__getitem__, self.first
        out = [first[s[0]] + b"".join(map(get, s[1:])) for s in split]
        for pieces, cache in ((new, self.first), (later, self.later)):
            for p in pieces:
                if len(p) > LONG:
                    del cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.replay.decode(np.frombuffer(ids, "<u4"))


_encoders: dict = {}
KEPT.append(_encoders)


def _encoder(shared) -> Encoder:
    """This worker's encoder, which outlives a task."""
    data, pattern, cache, table = shared.value
    key = (hashlib.sha256(data).digest(), pattern, cache, hashlib.sha256(repr(sorted(table)[:: max(1, len(table) // 64)]).encode()).digest(), len(table))
    if key not in _encoders:
        _encoders.clear()
        trim()
        _encoders[key] = Encoder(parse_ranks(data), pattern, cache, table)
    return _encoders[key]


def _words(shared, text_col: str, part_bytes: int):
    """The distinct words of a task that are no token themselves, once each for every HELD_PIECES distinct pieces."""

    def run(batches):
        ranks, pattern = shared.value
        ranks, find = parse_ranks(ranks).keys(), regex.compile(pattern).findall
        starts: set[str] = set()
        later: set[str] = set()

        def out():
            words = {w for p in starts for w in find(p)} | {w for p in later for w in find(" " + p)}
            starts.clear()
            later.clear()
            words = [w for w in words if len(w) <= LONG and w.encode("utf-8", "replace") not in ranks]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

        for _, texts in parts(batches, text_col, part_bytes):
            for t in filter(None, texts):
                u = units(t, pattern)
                if u is None:
                    for w in find(t):
                        starts.add(w) if not w.startswith(" ") else later.add(w[1:])
                else:
                    starts.add(u[0])
                    later.update(u[1:])
                if len(starts) + len(later) > HELD_PIECES:
                    yield out()
        yield out()
        trim()

    return run


def _replayed(shared):
    def run(batches):
        replay = Replay(parse_ranks(shared.value[0]))
        for b in batches:
            ids = replay.words([w.encode("utf-8", "replace") for w in b.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array([x.tobytes() for x in ids], pa.binary())], ["word", "ids"])

    return run


def corpus_table(docs: DataFrame, data: bytes, pattern: str, text_col: str = "text", words: int = TABLE_WORDS, part_bytes: int = PART_BYTES) -> dict[str, bytes]:
    """Ids of the words that most tasks hold, each replayed once, ``words`` of them at most."""
    if not words:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast((data, pattern))
    held = docs.select(text_col).mapInArrow(_words(shared, text_col, part_bytes), "word string").groupBy("word").agg(F.count("*").alias("tasks"))
    top = held.where("tasks > 1").orderBy(F.desc("tasks"), "word").limit(words).select("word")
    t = top.repartition(max(1, words // 16_384), "word").mapInArrow(_replayed(shared), "word string, ids binary").toArrow()
    return dict(zip(t["word"].to_pylist(), t["ids"].to_pylist()))


def _shared(docs: DataFrame, ranks_path: str, pattern: str, cache: int, table_words: int, text_col: str = "text", part_bytes: int = PART_BYTES):
    data = read_file(docs.sparkSession, ranks_path)
    return docs.sparkSession.sparkContext.broadcast((data, pattern, cache, corpus_table(docs, data, pattern, text_col, table_words, part_bytes)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", cache: int = CACHE, table_words: int = TABLE_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with a last column (``ids_col``, or a name like it that is free) of the text's token ids, an array of int.

    Where memory is short: ``cache`` and ``table_words`` bound the entries a worker keeps, ``part_bytes`` the text it works on at once.
    """
    shared = _shared(docs, ranks_path, pattern, cache, table_words, text_col, part_bytes)
    (name,) = fresh(docs, ids_col)

    def run(batches):
        e = _encoder(shared)
        for b, texts in parts(batches, text_col, part_bytes):
            ids = [np.frombuffer(x, "<u4") for x in e.encode([t or "" for t in texts])]
            cut = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, col], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with a last column (``decoded_col``, or a name like it that is free) of the bytes of ``ids_col``; null ids give no bytes."""
    shared = _shared(encoded, ranks_path, pattern, CACHE, 0)
    (name,) = fresh(encoded, decoded_col)

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            col = pa.array([e.replay.decode(np.array(x or [], np.int64)) for x in b.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, col], [*b.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField(name, T.BinaryType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids, in one pass."""
    shared = _shared(docs, ranks_path, pattern, CACHE, table_words)

    def run(batches):
        e = _encoder(shared)
        for b, texts in parts(batches):
            ids = e.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
