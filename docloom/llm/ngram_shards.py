"""Word-bigram counts and scores by sharded count joins.

Texts become blocks. A block sends each distinct bigram once, packed with its
count or with the documents that hold it, to the shard of its first word; shards
merge, and send back sums per document, never rows per token. A frequent first
word is spread over several shards by its second one. What is stored are tables
of packed rows, one a shard:

``bigrams``   first word, second word, count, in order of the first
``unigrams``  word, count, number of distinct words before it
``answers``   the unigram figures of each bigram shard's second words
``scores``    bigram key, its first word's sums, its count and its second word's figure
``backoffs``  of each word as a first word: what an unseen follower costs

A document's score is the sum over its tokens of ``unigram(w) + backoff(h)``,
found in the word's shard, and for seen bigrams of ``gain(h, w)``, found in the
bigram's shard: that is the recursive evaluation, regrouped into sums. All sums
are in double precision. What comes back from the shards meets again by a digest
of 128 bits of the block's ids and texts.

With several turns, shards are dealt over them, and every pass is made once a turn
for its shards: texts are read more often, and the shuffle files and spent tables
of one turn go before the next.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .storage import Scratch, bounded_jobs
from .textkit import Tokens, as_bytes, chunks, mix

_U64 = np.uint64
BEGIN = int(mix(np.array([101], _U64))[0])
END = int(mix(np.array([202], _U64))[0])
_BLOCK_BYTES = 12 << 20
_PART = "shard int, payload binary"
LARGEST = 6  # counts of counts that are kept


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def pack(x: np.ndarray) -> bytes:
    """Integers: byte planes, so that high bytes that are all zero vanish."""
    x = np.ascontiguousarray(x)
    return _squeeze(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) if len(x) else b""


def unpack(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(b.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=_U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, _U64), dtype=_U64)


def join_parts(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def split_parts(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at = np.concatenate([[0], np.cumsum(sizes)]) + 8 * (n + 1)
    return [raw[at[i] : at[i + 1]] for i in range(n)]


def bigram_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h + _U64(0x5851F42D4C957F2D)) ^ w)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each token, the one before it, its document, and tokens a document; an end closes each."""
    words, docs, sizes, done = [], [], [], 0
    for a, b in chunks(texts):
        tok = Tokens(texts[a:b])
        n = np.diff(tok.first)
        out = np.full(len(tok.start) + (b - a), END, _U64)
        owner = np.repeat(np.arange(b - a), n)
        out[np.arange(len(owner)) + owner] = tok.hashes()
        words.append(out)
        docs.append(np.repeat(np.arange(done, done + b - a), n + 1))
        sizes.append(n + 1)
        done += b - a
    w, d = np.concatenate(words), np.concatenate(docs)
    h = np.concatenate([np.array([BEGIN], _U64), w[:-1]])
    h[1:][d[1:] != d[:-1]] = BEGIN
    return w, h, d, np.concatenate(sizes)


def _shard_of(h: np.ndarray, w: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at = (mix(h) % _U64(shards)).astype(np.int64)
    words, spread = hot
    if len(words):
        k = np.searchsorted(words, h)
        k[k == len(words)] = 0
        is_hot = words[k] == h
        at[is_hot] = (at[is_hot] + (mix(w[is_hot] + _U64(3)) % spread[k[is_hot]].astype(_U64)).astype(np.int64)) % shards
    return at


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    """By the top bits, so that sorted words are in order of shards."""
    return ((w >> _U64(40)) * _U64(shards) >> _U64(24)).astype(np.int64)


def _runs(sorted_shard: np.ndarray) -> list[tuple[int, slice]]:
    """The shards that are there, and where each stands."""
    if not len(sorted_shard):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(sorted_shard)) + 1).tolist(), len(sorted_shard)]
    return [(int(sorted_shard[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = as_bytes(batch.column(column))
        for a, b in chunks(texts, _BLOCK_BYTES):
            yield batch.slice(a, b - a), texts[a:b]


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[head], *(np.add.reduceat(v[order], head) if len(head) else v[:0] for v in values))


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, LARGEST + 1).astype(np.int64), minlength=LARGEST + 2)[1 : LARGEST + 1].tolist()


def _row(shard: int, parts: list[bytes]) -> tuple[int, bytes]:
    return shard, join_parts(parts)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "payload"])


@dataclass(frozen=True)
class Layout:
    """How keys are dealt: the same in every pass."""

    shards: int
    word_shards: int
    hot: tuple[np.ndarray, np.ndarray]
    turns: int = 1

    @property
    def word_turns(self) -> int:
        """Half as many: the postings of words are less than half of those of bigrams."""
        return min(max(1, self.turns // 2), self.word_shards)

    def of_turn(self, table: DataFrame, turn: int) -> DataFrame:
        """Rows of a table that was written in turns."""
        return table if self.turns == 1 else table.where(F.col("turn") == turn)


#: Words and bigrams, commonest in a sample, whose values every task knows.
COMMON_WORDS, COMMON_PAIRS = 2048, 16384


@dataclass(frozen=True)
class Sample:
    """Keys of the words and bigrams that are commonest in some texts, the words' counts, and the texts' tokens."""

    words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    tokens: int

    @staticmethod
    def of(texts: DataFrame, limit: int = 2000) -> Sample:
        """From ``limit`` texts, those of the smallest digests; any answer is right, this one saves most."""
        rows = texts.where("length(text) > 0").select(F.xxhash64("text").alias("h"), "text")
        picked = F.broadcast(rows.select("h").distinct().orderBy("h").limit(limit))  # a fixed number of digests

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, block in _blocks(batches, 0):
                w, h, _, _ = sequences(block)
                for kind, key in ((0, w), (1, bigram_key(h, w)), (2, np.zeros(len(w), _U64))):
                    k, n = _sum_by(key, np.ones(len(key), np.int64))
                    yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        got = rows.join(picked, "h", "left_semi").select("text").mapInArrow(count, "kind int, key long, n long")
        got = got.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 3 or kind = 2")
        top = [got.where(F.col("kind") == k).orderBy(F.desc("n"), "key").limit(n) for k, n in ((0, COMMON_WORDS), (1, COMMON_PAIRS), (2, 1))]
        found = top[0].union(top[1]).union(top[2]).collect()  # fixed numbers of keys
        of = lambda kind: sorted((r["key"] & (2**64 - 1), r["n"]) for r in found if r["kind"] == kind)
        word, pair, all_ = of(0), of(1), of(2)
        array = lambda rows, i, t: np.array([r[i] for r in rows], t)
        return Sample(array(word, 0, _U64), array(word, 1, np.int64), array(pair, 0, _U64), all_[0][1] if all_ else 0)

    def hot(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of over one shard's share of tokens, and the shards that each is spread over."""
        at = np.flatnonzero(self.counts * shards > self.tokens)
        # a text's begin comes before as many words as its end is
        keys = np.where(self.words[at] == _U64(END), _U64(BEGIN), self.words[at])
        order = np.argsort(keys)
        return keys[order], -(-self.counts[at][order] * shards // max(self.tokens, 1))


def count_bigrams(texts: DataFrame, layout: Layout, turn: int = 0) -> DataFrame:
    """Merged ``bigrams`` rows of a turn's shards, with their counts of counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 0):
            w, h, _, _ = sequences(block)
            if layout.turns > 1:
                keep = _shard_of(h, w, layout.shards, layout.hot) % layout.turns == turn
                w, h = w[keep], h[keep]
            if not len(w):
                continue
            key = bigram_key(h, w)
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            c = np.diff(np.append(head, len(key)))
            first = order[head]
            h, w = h[first], w[first]
            shard = _shard_of(h, w, layout.shards, layout.hot)
            order = np.lexsort((h, shard))
            h, w, c = h[order], w[order], c[order]
            yield _batch([_row(s, [pack_sorted(h[g]), w[g].tobytes(), pack(c[g].astype(np.uint32))]) for s, g in _runs(shard[order])])

    def merge(table: pa.Table) -> pa.Table:
        parts = [split_parts(p) for p in table.column("payload").to_pylist()]
        h = np.concatenate([unpack_sorted(p[0]) for p in parts])
        w = np.concatenate([np.frombuffer(p[1], _U64) for p in parts])
        c = np.concatenate([unpack(p[2], np.uint32) for p in parts]).astype(np.int64)
        key = bigram_key(h, w)
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        first = order[head]
        h, w, c = h[first], w[first], np.add.reduceat(c[order], head)
        order = np.argsort(h, kind="stable")
        payload = join_parts([pack_sorted(h[order]), w[order].tobytes(), pack(c[order].astype(np.uint64))])
        return pa.table({"shard": table.column("shard").slice(0, 1), "payload": pa.array([payload], pa.binary()), "cc": pa.array([counts_of_counts(c)], pa.list_(pa.int64()))})

    sent = texts.select("text").mapInArrow(send, _PART)
    return sent.groupBy("shard").applyInArrow(merge, _PART + ", cc array<long>")


def _bigram_row(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = split_parts(payload)
    return unpack_sorted(p[0]), np.frombuffer(p[1], _U64), unpack(p[2], np.uint64).astype(np.int64)


def count_words(bigrams: DataFrame, layout: Layout) -> DataFrame:
    """``unigrams`` (kind 0) and ``answers`` (kind 1) from the shards' own figures."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, w, c = _bigram_row(payload)
                w, c, n = _sum_by(w, c, np.ones(len(w), np.int64))
                rows = [(u, join_parts([np.int64(shard).tobytes(), pack_sorted(w[g]), pack(c[g]), pack(n[g])])) for u, g in _runs(word_shard(w, layout.word_shards))]
                yield _batch(rows)

    def answer(table: pa.Table) -> pa.Table:
        asked = [split_parts(p) for p in table.column("payload").to_pylist()]
        words = [unpack_sorted(p[1]) for p in asked]
        w, c, n = _sum_by(np.concatenate(words), np.concatenate([unpack(p[2], np.int64) for p in asked]), np.concatenate([unpack(p[3], np.int64) for p in asked]))
        u = table.column("shard")[0].as_py()
        rows = [(0, u, join_parts([pack_sorted(w), pack(c), pack(n)]), [int(c.sum()), len(w), int(n.sum()), *counts_of_counts(c), *counts_of_counts(n)])]
        for p, x in zip(asked, words, strict=True):
            at = np.searchsorted(w, x)
            rows.append((1, int(np.frombuffer(p[0], np.int64)[0]), join_parts([np.int64(u).tobytes(), pack(c[at]), pack(n[at])]), []))
        cols = list(zip(*rows, strict=True))
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()), "payload": pa.array(cols[2], pa.binary()), "stats": pa.array(cols[3], pa.list_(pa.int64()))})

    asked = bigrams.select("shard", "payload").mapInArrow(ask, _PART)
    return asked.groupBy("shard").applyInArrow(answer, "kind int, " + _PART + ", stats array<long>")


@dataclass(frozen=True)
class Figures:
    """Sums over the whole model: tokens, words, distinct bigrams, counts of counts."""

    tokens: int
    words: int
    pairs: int
    word_cc: tuple[int, ...]
    before_cc: tuple[int, ...]
    bigram_cc: tuple[int, ...]

    @staticmethod
    def of(bigrams: DataFrame, words: DataFrame) -> Figures:
        size = 3 + 2 * LARGEST
        r = words.where("kind = 0").agg(F.array(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(size)])).first()[0]
        b = bigrams.agg(F.array(*[F.coalesce(F.sum(F.col("cc")[i]), F.lit(0)) for i in range(LARGEST)])).first()[0]
        return Figures(r[0], r[1], r[2], tuple(r[3 : 3 + LARGEST]), tuple(r[3 + LARGEST :]), tuple(b))


class Formulas(Protocol):
    """A model's formulas. ``second`` is the figure of a second word that ``gain`` needs: 0 its count, 1 its distinct first words."""

    second: int

    def sums(self, start: np.ndarray, c: np.ndarray, wc: np.ndarray, wn: np.ndarray) -> np.ndarray:
        """Of runs of bigrams with one first word (their starts): what is summed over its followers."""

    def back(self, s: np.ndarray) -> np.ndarray:
        """Of first words, from their sums: what an unseen follower costs."""

    def gain(self, c: np.ndarray, f: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Of bigrams, from count, second word's figure and first word's sums: what being seen adds."""

    def value(self, c: np.ndarray, n: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of words: three columns, the last of them the model's."""


def weigh(bigrams: DataFrame, words: DataFrame, layout: Layout, rules: Formulas, scratch: Scratch, name: str, spent: str | None = None) -> DataFrame:
    """``scores`` (kind 0) and ``backoffs`` (kind 1) of every bigram and first word. Turns of the table ``spent`` are dropped as they are done."""
    answers = words.where("kind = 1").select("shard", "payload")
    hot_words = layout.hot[0]

    def open_(left: pa.Table, right: pa.Table):
        h, w, c = _bigram_row(left.column("payload")[0].as_py())
        got = sorted((split_parts(p) for p in right.column("payload").to_pylist()), key=lambda p: int(np.frombuffer(p[0], np.int64)[0]))
        distinct = np.unique(w)
        at = np.searchsorted(distinct, w)
        wc = np.concatenate([unpack(p[1], np.int64) for p in got])[at]
        wn = np.concatenate([unpack(p[2], np.int64) for p in got])[at]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h, w, c, wc, wn, start

    def both(turn: int):
        right = answers if layout.turns == 1 else answers.where(F.col("shard") % layout.turns == turn)
        return layout.of_turn(bigrams, turn).select("shard", "payload").groupBy("shard").cogroup(right.groupBy("shard"))

    whole: dict[int, np.ndarray] = {}
    if len(hot_words):
        def partial(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"h": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.float64()))})
            h, _, c, wc, wn, start = open_(left, right)
            s = rules.sums(start, c, wc, wn)
            keep = np.isin(h[start], hot_words)
            return pa.table({"h": pa.array(h[start][keep].view(np.int64)), "s": pa.array(s[keep].tolist(), pa.list_(pa.float64()))})

        for turn in range(layout.turns):
            with bounded_jobs(scratch.spark):
                got = both(turn).applyInArrow(partial, "h long, s array<double>").collect()  # twice the shards at most
            for r in got:
                k = r["h"] & (2**64 - 1)
                whole[k] = whole.get(k, 0) + np.array(r["s"])

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        if left.num_rows:
            h, w, c, wc, wn, start = open_(left, right)
            s = rules.sums(start, c, wc, wn)
            first = h[start]
            for i in np.flatnonzero(np.isin(first, hot_words)) if len(hot_words) else ():
                s[i] = whole[int(first[i])]
            back = rules.back(s)
            k = bigram_key(h, w)
            order = np.argsort(k, kind="stable")
            run = np.repeat(np.arange(len(start), dtype=np.uint32), np.diff(np.append(start, len(c))))
            rows.append((0, int(key[0].as_py()), join_parts([pack_sorted(k[order]), pack(run[order]), pack(c[order]), pack((wc, wn)[rules.second][order]), s.tobytes()])))
            order = np.argsort(first, kind="stable")
            first, back = first[order], back[order]
            rows += [(1, u, join_parts([pack_sorted(first[g]), back[g].tobytes()])) for u, g in _runs(word_shard(first, layout.word_shards))]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()), "payload": pa.array(cols[2], pa.binary())})

    return scratch.write_turns(lambda t: both(t).applyInArrow(finish, "kind int, " + _PART), name, layout.turns, ("kind",), "none", _dropper(scratch, spent, layout))


def _dropper(scratch: Scratch, name: str | None, layout: Layout) -> Callable[[int], None]:
    return lambda t: scratch.drop(name if layout.turns == 1 else f"{name}/turn={t}") if name else None


@dataclass(frozen=True)
class Common:
    """Values of common words (three columns, backoff in the last) and gains of common bigrams, by sorted keys."""

    words: np.ndarray
    values: np.ndarray
    pairs: np.ndarray
    gains: np.ndarray


def common_values(words: DataFrame, model: DataFrame, rules: Formulas, sample: Sample) -> Common:
    """Looks the sample's keys up in the stored tables; a bounded number of rows comes back."""
    keys = np.unique(np.concatenate([sample.words, np.array([BEGIN, END], _U64)])), sample.pairs

    def found(own: np.ndarray, all_: np.ndarray) -> np.ndarray:
        at, known = _look(own, all_)
        return np.flatnonzero(known)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = split_parts(payload)
                k = unpack_sorted(p[0])
                at = found(keys[1] if table == 2 else keys[0], k)
                a, b = np.zeros(len(at)), np.zeros(len(at))
                if table == 0:
                    a, b = unpack(p[1], np.int64)[at].astype(float), unpack(p[2], np.int64)[at].astype(float)
                elif table == 1:
                    a = np.frombuffer(p[1], np.float64)[at]
                elif len(at):
                    run, c, f = (unpack(x, t)[at] for x, t in zip(p[1:4], (np.uint32, np.int64, np.int64), strict=True))
                    a = rules.gain(c, f, np.frombuffer(p[4], np.float64).reshape(int(unpack(p[1], np.uint32).max()) + 1, -1)[run])
                yield pa.record_batch([pa.array(np.full(len(at), table, np.int32)), pa.array(k[at].view(np.int64)), pa.array(a), pa.array(b)], ["table", "key", "a", "b"])

    part = lambda df, kind, table: df.where(F.col("kind") == kind).select(F.lit(table).alias("table"), "payload")
    stored = part(words, 0, 0).union(part(model, 1, 1)).union(part(model, 0, 2))
    rows = stored.mapInArrow(find, "table int, key long, a double, b double").distinct().collect()  # a few rows a key at most
    c, n, back, gain = np.zeros(len(keys[0]), np.int64), np.zeros(len(keys[0]), np.int64), np.zeros(len(keys[0])), np.zeros(len(keys[1]))
    for r in rows:
        at = int(np.searchsorted(keys[1] if r["table"] == 2 else keys[0], np.uint64(r["key"] & (2**64 - 1))))
        if r["table"] == 0:
            c[at], n[at] = int(r["a"]), int(r["b"])
        elif r["table"] == 1:
            back[at] = r["a"]
        else:
            gain[at] = r["a"]
    values = rules.value(c, n, c > 0)
    values[keys[0] == _U64(BEGIN)] = 0
    values[:, 2] += back
    return Common(keys[0], values, keys[1], gain)


def _look(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.searchsorted(keys, want)
    at[at == len(keys)] = 0
    return at, keys[at] == want


def sparse_sums(d: np.ndarray, values: list[np.ndarray], own: np.ndarray | None) -> bytes:
    """Sums of one block's postings by document, and what its task knew itself; only documents that have any are named.

    A shard holds a bounded number of postings, so what it sends back stays bounded however many documents there are.
    """
    at, place = np.unique(d, return_inverse=True)
    sums = np.stack([np.bincount(place, v, len(at)) for v in values]).astype(np.float64)
    if own is not None:
        full = own.copy()
        full[:, at] += sums
        at, sums = np.arange(own.shape[1]), full
    return join_parts([pack(np.diff(at, prepend=0).astype(np.uint32)), np.int64(len(values)).tobytes(), sums.tobytes()])


def read_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their columns of ``sparse_sums``."""
    p = split_parts(raw)
    at = np.cumsum(unpack(p[0], np.uint32), dtype=np.int64)
    return at, np.frombuffer(p[2], np.float64).reshape(int(np.frombuffer(p[1], np.int64)[0]), len(at))


def score(docs: DataFrame, words: DataFrame, model: DataFrame, layout: Layout, rules: Formulas, scratch: Scratch, common: Common, seen: np.ndarray | None = None, spent: tuple[str, ...] = (), spent_pairs: str | None = None, parts: tuple[int, int] = (1, 1)) -> DataFrame:
    """Per row of ``doc_id, text``, and ``tag`` (string) if there: ``doc_id, n_tokens, s0, s1, s2`` and ``tag``.

    s0 and s1 are sums of ``rules.value``'s first two columns; s2 is the model's score. ``seen``,
    packed bits of the model's bigram keys, spares sending bigrams that the model can't hold. Tables ``spent`` are dropped once the words are done, turns of ``spent_pairs`` as their bigrams are.
    What is ``common`` is summed where the text is read, so that only rarer words and bigrams travel.
    Postings of a word shard and of a bigram shard are dealt by block over so many ``parts``, each with a copy of the shard of a small model.
    """
    bits = int(np.log2(len(seen) * 8)) if seen is not None else 0
    tagged = "tag" in docs.columns
    docs = docs.select("doc_id", "text", *(["tag"] if tagged else []))

    def header(batch: pa.RecordBatch, texts: list[bytes], size: np.ndarray) -> tuple[bytes, bytes]:
        ids = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min), dtype=np.int64)
        valid = np.asarray(batch.column(0).is_valid())
        head = [pack(np.diff(ids, prepend=0)), pack(size.astype(np.int64)), pack(valid.view(np.uint8))]
        if tagged:
            head.append(_squeeze(json.dumps(batch.column(2).to_pylist()).encode()))
        packed = join_parts(head)
        digest = hashlib.blake2b(packed, digest_size=16)
        digest.update(np.array([len(t) for t in texts], np.int64))
        for t in texts:
            digest.update(t)
        return digest.digest(), packed

    def postings(key: np.ndarray, d: np.ndarray, shard_of, shards: int, block: bytes, head: bytes, own: np.ndarray, always: bool, turn: int, turns: int) -> list[tuple[int, bytes, bytes]]:
        order = np.argsort(key, kind="stable")
        key, d = key[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(key)))
        shard = shard_of(key[at], order[at])
        by = np.argsort(shard, kind="stable")
        kind = np.uint16 if len(d) == 0 or int(d.max()) < 1 << 16 else np.uint32
        runs = [(s, by[g]) for s, g in _runs(shard[by])]
        first = turn + turns * (int.from_bytes(block[6:12]) % len(range(turn, shards, turns)))
        if not any(s == first for s, _ in runs):
            runs.append((first, by[:0]))  # the head and what the task knew itself go with one of the shards
        rows, in_block = [], docs_in(head)
        for s, g in runs:
            take = np.repeat(at[g] - np.concatenate([[0], np.cumsum(n[g])[:-1]]).astype(np.int64), n[g]) + np.arange(int(n[g].sum())) if len(g) else np.zeros(0, np.int64)
            rows.append((s, block, join_parts([head if s == first and always else b"", pack_sorted(key[at[g]]), pack(n[g].astype(np.uint32)), np.array([np.dtype(kind).itemsize], np.int64).tobytes(), pack(d[take].astype(kind)), np.int64(in_block).tobytes(), own.tobytes() if s == first else b""])))
        return rows

    def docs_in(head: bytes) -> int:
        return len(unpack(split_parts(head)[2], np.uint8))

    def as_batch(rows: list[tuple[int, bytes, bytes]], shards: int, n: int) -> pa.RecordBatch:
        rows = [(s + shards * (int.from_bytes(block[:6]) % n), block, payload) for s, block, payload in rows]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["shard", "block", "payload"])

    def send_words(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in _blocks(batches, 1):
                w, h, d, size = sequences(texts)
                block, head = header(batch, texts, size)
                key, d = np.concatenate([w, np.full(len(texts), BEGIN, _U64)]), np.concatenate([d, np.arange(len(texts))])
                if layout.word_turns > 1:
                    keep = word_shard(key, layout.word_shards) % layout.word_turns == turn
                    key, d = key[keep], d[keep]
                at, known = _look(common.words, key)
                own = np.stack([np.bincount(d[known], common.values[at[known], j], len(texts)) for j in range(3)]).astype(np.float64)
                # the head comes once, with the first turn
                yield as_batch(postings(key[~known], d[~known], lambda k, _: word_shard(k, layout.word_shards), layout.word_shards, block, head, own, turn == 0, turn, layout.word_turns), layout.word_shards, parts[0])

        return send

    def send_pairs(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.unpackbits(seen).astype(bool) if seen is not None else None
            for batch, texts in _blocks(batches, 1):
                w, h, d, size = sequences(texts)
                block, head = header(batch, texts, size)
                if layout.turns > 1:
                    keep = _shard_of(h, w, layout.shards, layout.hot) % layout.turns == turn
                    w, h, d = w[keep], h[keep], d[keep]
                key = bigram_key(h, w)
                if table is not None:
                    keep = np.flatnonzero(table[(key >> _U64(64 - bits)).astype(np.int64)])
                    key, w, h, d = key[keep], w[keep], h[keep], d[keep]
                at, known = _look(common.pairs, key)
                own = np.bincount(d[known], common.gains[at[known]], len(texts)).astype(np.float64)
                key, w, h, d = key[~known], w[~known], h[~known], d[~known]
                yield as_batch(postings(key, d, lambda k, i, h=h, w=w: _shard_of(h[i], w[i], layout.shards, layout.hot), layout.shards, block, head, own, False, turn, layout.turns), layout.shards, parts[1])

        return send

    def opened(payload: bytes):
        p = split_parts(payload)
        kind = np.uint16 if int(np.frombuffer(p[3], np.int64)[0]) == 2 else np.uint32
        return p[0], unpack_sorted(p[1]), unpack(p[2], np.uint32).astype(np.int64), unpack(p[4], kind).astype(np.int64), int(np.frombuffer(p[5], np.int64)[0]), np.frombuffer(p[6], np.float64)

    def sums_table(rows: list[tuple[bytes, bytes, bytes]]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table({"block": pa.array(cols[0], pa.binary()), "head": pa.array(cols[1], pa.binary()), "sums": pa.array(cols[2], pa.binary())})

    def word_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        w, c, n = np.zeros(0, _U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        fw, fb = [np.zeros(0, _U64)], [np.zeros(0)]
        for kind, payload in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True):
            p = split_parts(payload)
            if kind == 0:
                w, c, n = unpack_sorted(p[0]), unpack(p[1], np.int64), unpack(p[2], np.int64)
            else:
                fw.append(unpack_sorted(p[0]))
                fb.append(np.frombuffer(p[1], np.float64))
        fw, fb = np.concatenate(fw), np.concatenate(fb)
        order = np.argsort(fw, kind="stable")
        fw, fb = fw[order], fb[order]
        rows = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist(), strict=True):
            head, k, times, d, size, own = opened(payload)
            at, known = _look(w, k)
            zero = np.zeros(len(k), np.int64)
            cols = rules.value(c[at] * known if len(c) else zero, n[at] * known if len(n) else zero, known)
            cols[k == _U64(BEGIN)] = 0
            at, has = _look(fw, k)
            cols[:, 2] += fb[at] * has if len(fb) else 0
            rows.append((block, head, sparse_sums(d, [np.repeat(cols[:, j], times) for j in range(3)], own.reshape(3, -1) if len(own) else None)))
        return sums_table(rows)

    def pair_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.zeros(0, _U64)
        if right.num_rows:
            p = split_parts(right.column("payload")[0].as_py())
            keys, run, c, f = unpack_sorted(p[0]), unpack(p[1], np.uint32), unpack(p[2], np.int64), unpack(p[3], np.int64)
            s = np.frombuffer(p[4], np.float64).reshape(int(run.max()) + 1, -1)
        rows = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist(), strict=True):
            _, k, times, d, size, own = opened(payload)
            at, known = _look(keys, k)
            at, v = at[known], np.zeros(len(k))
            if len(at):
                v[known] = rules.gain(c[at], f[at], s[run[at]])
            rows.append((block, b"", sparse_sums(d, [np.repeat(v, times)], own.reshape(1, -1) if len(own) else None)))
        return sums_table(rows)

    def total(table: pa.Table) -> pa.Table:
        """Sums of one block; equal blocks (repeated rows) arrive together and come out as often."""
        heads = [x for x in table.column("head").to_pylist() if x]
        if not heads:
            raise RuntimeError("the documents were not read in the same blocks twice; write them to a table first")
        parts_ = split_parts(heads[0])
        ids, size, valid = (unpack(x, k) for x, k in zip(parts_, (np.int64, np.int64, np.uint8), strict=False))
        ids = np.cumsum(ids)
        sums = np.zeros((3, len(ids)))
        for x in table.column("sums"):
            at, got = read_sums(x.as_buffer().to_pybytes())
            sums[3 - len(got) :, at] += got
        times = len(heads)
        col = lambda x: np.tile(x, times)
        out = {"doc_id": pa.array(col(ids), mask=col(valid == 0)), "n_tokens": pa.array(col(size)), "s0": pa.array(col(sums[0] / times)), "s1": pa.array(col(sums[1] / times)), "s2": pa.array(col(sums[2] / times))}
        if tagged:
            out["tag"] = pa.array(json.loads(zstandard.ZstdDecompressor().decompress(parts_[3])) * times, pa.string())
        return pa.table(out)

    def copied(table: DataFrame, shards: int, n: int) -> DataFrame:
        return table if n == 1 else table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("shard", (F.col("shard") + shards * F.col("part")).cast("int")).drop("part")

    part = "shard int, block binary, payload binary"
    out = "block binary, head binary, sums binary"
    stored = words.where("kind = 0").select("kind", "shard", "payload").union(model.where("kind = 1").select("kind", "shard", "payload"))
    def by_word(turn: int) -> DataFrame:
        right = stored if layout.word_turns == 1 else stored.where(F.col("shard") % layout.word_turns == turn)
        return docs.mapInArrow(send_words(turn), part).groupBy("shard").cogroup(copied(right, layout.word_shards, parts[0]).groupBy("shard")).applyInArrow(word_sums, out)

    def by_pair(turn: int) -> DataFrame:
        right = layout.of_turn(model, turn).where("kind = 0").select("shard", "payload")
        return docs.mapInArrow(send_pairs(turn), part).groupBy("shard").cogroup(copied(right, layout.shards, parts[1]).groupBy("shard")).applyInArrow(pair_sums, out)

    # one after the other, so that only one set of shuffle files is there at a time; all passes cut the same
    # blocks, as ``docs`` is a stored table
    word_part = scratch.write_turns(by_word, "sums-words", layout.word_turns)
    for table in spent:
        scratch.drop(table)
    pair_part = scratch.write_turns(by_pair, "sums-pairs", layout.turns, done=_dropper(scratch, spent_pairs, layout))
    sums = ["block", "head", "sums"]
    return word_part.select(sums).union(pair_part.select(sums)).groupBy("block").applyInArrow(total, "doc_id long, n_tokens long, s0 double, s1 double, s2 double" + (", tag string" if tagged else ""))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
