"""Secrets by fixed patterns and a linear-chain conditional random field.

Tokens are runs of word characters or single marks. Each is tagged secret begin,
inside or outside from its shape, the words around it and features of its file;
weights come from maximum likelihood on a bounded sample of sequences whose labels
are the pattern spans (distant supervision), with the keyword hidden in part of it so
that shape and surroundings carry weight too. Decoding is exact Viterbi: tokens
that no transition could turn away from "outside" split a text into short runs,
and only those runs are searched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import Scratch
from .textkit import _BYTE, _FOLD, _powers, as_bytes, chunks, mix

# The pattern kinds, in order.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_O, _B, _I = 0, 1, 2
_HASH = 4096
_SHIFTS = (-3, -2, -1, 1)
_SHAPES = 10 * 12
_FILES = 4
_NEVER = -1e6
#: Tokens of a training sequence before and after a span, and at most.
_BEFORE, _AFTER, _WIDEST = 24, 8, 128
#: Training sequences whose marginals are held at a time.
_TRAIN_BLOCK = 500

_CLASS = np.full(256, 2, np.uint8)
for _c in b" \t\n\x0b\x0c\r":
    _CLASS[_c] = 0
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    _CLASS[_c] = 1
_CLASS[128:] = 1
_LOWER, _UPPER, _DIGIT, _HEXLET = (np.zeros(256, np.int32) for _ in range(4))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = 1
_HEXLET[97:103] = _HEXLET[48:58] = 1


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """Byte spans ``(start, kind, end)`` of the fixed patterns, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class _Tokens:
    """Tokens of some texts, their feature indices, and each text's range."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        cls = _CLASS[buf]
        cut = np.flatnonzero((cls[1:] != cls[:-1]) | (cls[1:] == 2)) + 1
        begin = np.concatenate([[0], cut])
        end = np.concatenate([cut, [len(buf)]])
        keep = cls[begin] != 0
        self.start, self.end = begin[keep], end[keep]
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.offset = np.concatenate([[0], ends])
        self.first = np.searchsorted(self.start, self.offset)
        n = len(self.start)
        size = self.end - self.start
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

        def count(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
            return total[self.end] - total[self.start]

        low, up, dig, hexes = count(_LOWER), count(_UPPER), count(_DIGIT), count(_HEXLET)
        kind = np.full(n, 9)
        kind[(low > 0) & (up == 0)] = 0
        kind[(low > 0) & (up == 1)] = 1
        kind[(low == 0) & (up > 0)] = 2
        kind[dig == size] = 3
        mixed = (dig > 0) & (dig < size)
        kind[mixed] = 4
        kind[mixed & (low > 0) & (up > 0)] = 5
        kind[mixed & (low == 0) & (up > 0)] = 6
        kind[mixed & (hexes == size)] = 7
        kind[(dig == 0) & (up > 1) & (low > 0)] = 8
        band = np.searchsorted([1, 2, 3, 5, 7, 9, 12, 16, 20, 28, 40], size, side="left")
        mark = cls[self.start] == 2
        self.shape = np.where(mark, 108 + (buf[self.start] % 12), np.minimum(kind * 12 + band, 107))
        power, inverse = _powers(len(buf) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_FOLD[buf]] * power[: len(buf)])])
        h = mix((total[self.end] - total[self.start]) * inverse[self.start])
        word = 1 + (h % np.uint64(_HASH - 1)).astype(np.int64)
        self.near = []
        for k in _SHIFTS:
            v = np.zeros(n, np.int64)
            if n > abs(k):
                same = self.doc[abs(k) :] == self.doc[: -abs(k)]
                if k < 0:
                    v[-k:] = np.where(same, word[:k], 0)
                else:
                    v[:-k] = np.where(same, word[k:], 0)
            self.near.append(v)
        per = np.bincount(self.doc, weights=mixed.astype(float), minlength=len(texts)) if n else np.zeros(len(texts))
        share = per / np.maximum(np.diff(self.first), 1)
        self.file = np.searchsorted([0.0005, 0.005, 0.05], share)[self.doc] if n else np.zeros(0, np.int64)


def _tags(tok: _Tokens, lo: int, hi: int, offset: int, text: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tags of one text's tokens from its pattern spans, and the token ranges of these spans."""
    tags, ranges = np.zeros(hi - lo, np.uint8), []
    for s, kind, e in base_spans(text):
        whole = np.flatnonzero((tok.start[lo:hi] >= s + offset) & (tok.end[lo:hi] <= e + offset))
        if not len(whole):
            continue
        # the secret is the value: of an assignment what its second group holds
        m = _ASSIGN.match(text, s) if kind == 0 else None
        inside = whole[tok.start[lo:hi][whole] >= m.start(2) + offset] if m else whole
        if len(inside):
            tags[inside] = _I
            tags[inside[0]] = _B
            ranges.append((int(whole[0]), int(inside[-1]) + 1))
    return tags, ranges


def _sequences(texts: list[bytes]) -> list[tuple[int, bytes]]:
    """Training sequences of whole spans with what stands around them (kind 1), and of plain tokens, one a text (kind 0)."""
    out = []
    for a, b in chunks(texts):
        tok = _Tokens(texts[a:b])
        for i in range(b - a):
            lo, hi = int(tok.first[i]), int(tok.first[i + 1])
            tags, ranges = _tags(tok, lo, hi, int(tok.offset[i]), texts[a + i])
            pieces: list[list[int]] = []
            for s, e in ranges:
                if pieces and s - _BEFORE < pieces[-1][1] and e - pieces[-1][0] <= _WIDEST:
                    pieces[-1][1] = min(e + _AFTER, hi - lo)
                else:
                    begin = max(s - _BEFORE, 0, pieces[-1][1] if pieces else 0)
                    pieces.append([min(begin, s), min(e + _AFTER, hi - lo)])
            cuts = [(1, s, min(e, s + _WIDEST)) for s, e in pieces]
            plain = (hi - lo) * (zlib.crc32(texts[a + i]) & 0xFFFF) >> 16  # any place, the same for equal texts
            end = min([plain + _BEFORE + _AFTER, hi - lo, *(s for s, _ in pieces if s > plain)])
            if end > plain and not tags[plain:end].any() and not any(s <= plain < e for s, e in pieces):
                cuts.append((0, plain, end))
            for kind, s, e in cuts:
                g = slice(lo + s, lo + e)
                parts = [tok.shape[g].astype(np.uint8), *(v[g].astype(np.uint16) for v in tok.near), tok.file[g].astype(np.uint8), tags[s:e]]
                out.append((kind, bytes([s == 0]) + b"".join(x.tobytes() for x in parts)))
    return out


def _block(sample: list[tuple[int, int, bytes]], first: int) -> tuple[np.ndarray, ...]:
    """Sequences side by side: shapes, words around, file, tags, which tokens are there, and which begin a text."""
    each = 3 + 2 * len(_SHIFTS)
    sizes = [(len(p) - 1) // each for _, _, p in sample]
    wide = max(sizes)
    S, A, Y, live = (np.zeros((len(sample), wide), k) for k in (np.int64, np.int64, np.int64, float))
    N = np.zeros((len(sample), len(_SHIFTS), wide), np.int64)
    for i, ((_, _, p), n) in enumerate(zip(sample, sizes, strict=True)):
        S[i, :n] = np.frombuffer(p, np.uint8, n, 1)
        N[i, :, :n] = np.frombuffer(p, np.uint16, len(_SHIFTS) * n, 1 + n).reshape(-1, n)
        A[i, :n] = np.frombuffer(p, np.uint8, n, 1 + n + 2 * len(_SHIFTS) * n)
        Y[i, :n] = np.frombuffer(p, np.uint8, n, 1 + 2 * n + 2 * len(_SHIFTS) * n)
        live[i, :n] = 1
    N[(first + np.arange(len(sample))) % 3 == 0] = 0  # in a third the words around are hidden
    return S, N, A, Y, live, np.array([p[0] == 1 for _, _, p in sample])


@dataclass(frozen=True)
class SecretTagger:
    """A fitted tagger: weights of a bounded number of features."""

    shape: np.ndarray
    near: np.ndarray
    file: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, limit: int = 40_000, sequences: int = 2_000, rounds: int = 40, rate: float = 0.5) -> SecretTagger:
        """Learn from a sample of at most ``limit`` texts.

        The texts are those of the smallest digests, each once, so neither order nor
        partitions matter. Executors cut sequences out of them: around every pattern
        span, and one elsewhere a text. Of each sort the ``sequences`` of the smallest
        digests of their features come to the driver, at most ``_WIDEST`` tokens each.
        """
        text = F.col("text").cast("string")
        rows = docs.where(F.length(text) > 0).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
        picked = F.broadcast(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).orderBy("h").limit(limit))  # a fixed number of digests

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _sequences(as_bytes(batch.column(0)))
                digest = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), signed=True) for _, p in found]
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array(digest, pa.int64()), pa.array([p for _, p in found], pa.binary())], ["kind", "digest", "payload"])

        cuts = rows.join(picked, ["h", "doc_id"], "left_semi").select("text").mapInArrow(cut, "kind int, digest long, payload binary")
        scratch = Scratch(docs.sparkSession, "crf")
        some = [scratch.write(cuts.where(F.col("kind") == k).orderBy("digest", "payload").limit(sequences), f"cuts-{k}") for k in (1, 0)]
        chosen = sorted({(r["kind"], r["digest"], bytes(r["payload"])) for r in some[0].union(some[1]).collect()})
        scratch.keep()
        return SecretTagger._learn(chosen, rounds, rate)

    @staticmethod
    def _learn(sample: list[tuple[int, int, bytes]], rounds: int, rate: float) -> SecretTagger:
        shape, near, file = np.zeros((_SHAPES, 3)), np.zeros((len(_SHIFTS), _HASH, 3)), np.zeros((_FILES, 3))
        move, begin = np.zeros((3, 3)), np.zeros(3)
        move[_O, _I] = begin[_I] = _NEVER
        shape[:, _B] = shape[:, _I] = -2.0
        model = SecretTagger(shape, near, file, move, begin)
        if not any(kind for kind, _, _ in sample):
            shape[:, _B] = shape[:, _I] = -50.0
            return model
        blocks = [_block(sample[i : i + _TRAIN_BLOCK], i) for i in range(0, len(sample), _TRAIN_BLOCK)]
        size = [np.full(x.shape, 1e-3) for x in (shape, near, file, move, begin)]
        for _ in range(rounds):
            grads = [np.zeros_like(x) for x in (shape, near, file, move, begin)]
            for S, N, A, Y, live, fresh in blocks:
                emit = shape[S] + sum(near[k][N[:, k]] for k in range(len(_SHIFTS))) + file[A]
                post, pairs = _marginals(emit, move, np.where(fresh[:, None], begin, move[_O]), live)
                gold = np.eye(3)[Y] * live[..., None]
                diff = gold - post * live[..., None]
                both = live[:, 1:] * live[:, :-1]
                np.add.at(grads[0], S, diff)
                for k in range(len(_SHIFTS)):
                    np.add.at(grads[1][k], N[:, k], diff)
                np.add.at(grads[2], A, diff)
                grads[3] += np.einsum("bti,btj,bt->ij", np.eye(3)[Y[:, :-1]], np.eye(3)[Y[:, 1:]], both) - pairs
                grads[3][_O] += diff[~fresh, 0].sum(0)  # what comes before a cut is outside
                grads[4] += diff[fresh, 0].sum(0)
            for x, g, s in zip((shape, near, file, move, begin), grads, size, strict=True):
                g -= 0.02 * np.where(np.abs(x) < 100, x, 0)
                s += g * g
                x += rate * g / np.sqrt(s)
            near[:, 0] = 0
            move[_O, _I] = begin[_I] = _NEVER
        return model

    def emissions(self, tok: _Tokens) -> np.ndarray:
        out = self.shape[tok.shape] + self.file[tok.file]
        for k, v in enumerate(tok.near):
            out += self.near[k][v]
        return out

    def decode(self, tok: _Tokens) -> np.ndarray:
        """The best tag of every token, by exact Viterbi over undecided runs."""
        emit = self.emissions(tok)
        n = len(emit)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        finite = np.concatenate([self.move[self.move > _NEVER / 2], self.begin[self.begin > _NEVER / 2]])
        reach = 3 * float(finite.max() - finite.min())
        follow = np.zeros(n)
        follow[:-1] = np.maximum(emit[1:, _I] - emit[1:, _B], 0)
        open_ = emit[:, _O] - np.maximum(emit[:, _B], emit[:, _I]) - follow <= reach
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        breaks = np.flatnonzero((np.diff(at) > 1) | (tok.doc[at[1:]] != tok.doc[at[:-1]])) + 1
        move = self.move.tolist()
        for run in np.split(at, breaks):
            lo, hi = int(run[0]), int(run[-1]) + 1
            fresh = lo == tok.first[tok.doc[lo]]
            last = hi == tok.first[tok.doc[lo] + 1]
            rows = emit[lo:hi].tolist()
            best = [(self.begin[y] if fresh else move[_O][y]) + rows[0][y] for y in range(3)]
            back = []
            for e in rows[1:]:
                step, now = [], []
                for y in range(3):
                    p = max(range(3), key=lambda x: best[x] + move[x][y])
                    step.append(p)
                    now.append(best[p] + move[p][y] + e[y])
                back.append(step)
                best = now
            y = max(range(3), key=lambda x: best[x] + (0.0 if last else move[x][_O]))
            for i in range(hi - 1, lo - 1, -1):
                tags[i] = y
                if i > lo:
                    y = back[i - lo - 1][y]
        return tags

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Sorted byte spans ``(start, kind, end)`` of each text; tagged ones only beside the patterns'."""
        out = []
        for a, b in chunks(texts):
            tok = _Tokens(texts[a:b])
            tags = self.decode(tok)
            found: dict[int, list[tuple[int, int]]] = {}
            for s in np.flatnonzero(tags == _B):
                e = int(s)
                while e + 1 < len(tags) and tags[e + 1] == _I and tok.doc[e + 1] == tok.doc[s]:
                    e += 1
                d = int(tok.doc[s])
                found.setdefault(d, []).append((int(tok.start[s] - tok.offset[d]), int(tok.end[e] - tok.offset[d])))
            for i in range(b - a):
                spans = base_spans(texts[a + i])
                extra = [(s, 3, e) for s, e in found.get(i, ()) if not any(s < y and x < e for x, _, y in spans)]
                out.append(sorted(spans + extra))
        return out


def _marginals(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each tag, and expected transition counts, by forward-backward."""
    b, n, _ = emit.shape
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = begin + emit[:, 0]
    for t in range(1, n):
        step = lse(fwd[:, t - 1, :, None] + move, 1) + emit[:, t]
        fwd[:, t] = np.where(live[:, t, None] > 0, step, fwd[:, t - 1])
    for t in range(n - 2, -1, -1):
        step = lse(move + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(live[:, t + 1, None] > 0, step, bwd[:, t + 1])
    z = lse(fwd[:, -1], 1)
    post = np.exp(fwd + bwd - z[:, None, None])
    pair = fwd[:, :-1, :, None] + move + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
    return post, (np.exp(np.minimum(pair, 0)) * (live[:, 1:] * live[:, :-1])[..., None, None]).sum((0, 1))


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not spans:
        return spans
    head = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(head[s]), k, int(head[e])) for s, k, e in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, tagger: SecretTagger) -> DataFrame:
    """Spans of every whole text, in code points, end exclusive.

    Reads ``doc_id`` and ``text``. Null and empty texts have none. Repeated rows
    give repeated results; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            counts, base, every = np.zeros((3, len(texts)), np.int64), [], []
            for i, (t, s) in enumerate(zip(texts, tagger.spans(texts), strict=True)):
                p = _points(t, s)
                for _, k, _ in p:
                    if k < 3:
                        counts[k, i] += 1
                base.append(hashlib.sha256(_joined([x for x in p if x[1] < 3]).encode()).hexdigest())
                every.append(_joined(p))
            yield pa.record_batch([batch.column(0), *[pa.array(c) for c in counts], pa.array(base), pa.array(every)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, tagger: SecretTagger, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of ``text`` replaced by ``mark``; other columns as they are."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at))
            out = []
            for t, spans in zip(texts, tagger.spans(texts), strict=True):
                parts, last = [], 0
                for s, _, e in spans:
                    if e > last:
                        parts += [t[last : max(s, last)], mark.encode()] if s >= last else []
                        last = e
                out.append((b"".join(parts) + t[last:]).decode("utf-8", "replace"))
            valid = batch.column(at).is_valid().to_pylist()
            new = pa.array([x if v else None for x, v in zip(out, valid, strict=True)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, schema)
