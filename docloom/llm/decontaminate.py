"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of ``m`` characters within ``k`` edits of a piece of a document shares
at least ``m - q + 1 - k q`` q-grams with it, all on diagonals at most ``k``
apart. Shared q-grams are counted in overlapping bands of diagonals; regions
that meet the bound are kept and aligned within their band. Passages are windows
of an item, one from every byte, so part of an item counts as a leak too. Texts are compared with A-Z
folded and blanks run together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import Scratch
from .textkit import _BLANK, _FOLD, as_bytes, chunks

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 22
#: Added to diagonals, which may be negative; above any length of an item.
_SHIFT = 1 << 40
#: Item text that one pass over the documents holds in memory; more items take more passes.
BLOCK_BYTES = 8 << 20
#: Pairs of equal grams that are held at a time.
PAIRS = 1 << 20
#: Rows of a batch whose texts are taken out at a time.
ROWS = 512


def fold(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, blanks run together and trimmed, and where each stood."""
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    out = np.where(blank[at], np.uint8(32), np.maximum(_FOLD[raw[at]], 1)).astype(np.uint8)
    lo = int(len(out) > 0 and out[0] == 32)
    hi = len(out) - int(len(out) > lo and out[-1] == 32)
    return out[lo:hi], at[lo:hi]


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct columns in order of their rows."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])] if rows.shape[1] else rows


def _grams(buf: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes (8 to 16) from each position."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = np.ndarray((len(buf) - 7,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    x = wide[:n] * _K1
    x ^= x >> np.uint64(29)
    x += wide[q - 8 : q - 8 + n] * _K2
    x ^= x >> np.uint64(32)
    return x * _K1


def locate(a: np.ndarray, b: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Fewest edits that turn all of ``a`` into a piece of ``b`` on diagonals ``low..high``, and the shortest such piece's
    begin and end; ``most + 1, 0, 0`` if there are more."""
    wide = np.arange(high - low + 1)
    one, far = 1 << 40, (most + 1) << 40
    # the cost above, below it how far the begin is from the text's end: least is the latest begin
    begin = low + wide
    row = np.where((begin >= 0) & (begin <= len(b)), len(b) - begin, far)
    padded = np.full(len(b) + len(a) + 2 * len(wide) + abs(low) + abs(high) + 2, -1, np.int64)
    shift = abs(low) + len(wide)
    padded[shift : shift + len(b)] = b
    for i, c in enumerate(a.tolist()):
        here = padded[shift + low + i : shift + low + i + len(wide)]
        new = row + np.where(here == c, 0, one)
        new[here < 0] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + one)
        row = np.minimum.accumulate(new - wide * one) + wide * one
        at = low + wide + i + 1
        row[(at < 0) | (at > len(b))] = far
        if row.min() >= far:
            return most + 1, 0, 0
    end = int(row.argmin())
    cost, back = divmod(int(row[end]), one)
    return (cost, len(b) - back, low + end + len(a)) if cost <= most else (most + 1, 0, 0)


def window_edits(item: np.ndarray, text: np.ndarray, starts: np.ndarray, m: int, low: int, high: int, most: int) -> np.ndarray:
    """Edits, as by ``locate``, of the ``m`` bytes of ``item`` from each start (ascending) in ``text``, diagonals counted from the item's begin."""
    out = np.full(len(starts), most + 1)
    wide = np.arange(high - low + 1)
    for a in range(0, len(starts), 4096):
        s = starts[a : a + 4096]
        # beyond the text stand zeros, which equal nothing: to replace one costs what to drop a byte costs
        begin, end = int(s[0]) + low, int(s[-1]) + m + high
        near = np.zeros(end - begin, np.uint8)
        lo, hi = min(max(begin, 0), len(text)), max(min(end, len(text)), 0)
        if lo < hi:
            near[lo - begin : hi - begin] = text[lo:hi]
        rows = np.lib.stride_tricks.sliding_window_view(near, len(wide))
        open_, row = np.arange(len(s)), np.zeros((len(s), len(wide)), np.int64)
        for i in range(m):
            at = s[open_] + i
            new = row + (rows[at - s[0]] != item[at][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            row = np.minimum.accumulate(new - wide, axis=1) + wide
            keep = row.min(axis=1) <= most
            if not keep.all():
                open_, row = open_[keep], row[keep]
                if not len(open_):
                    break
        if len(open_):
            out[a + open_] = row.min(axis=1)
    return out


@dataclass(frozen=True)
class _Index:
    """Q-grams of some items: sorted distinct hashes, where each occurs, and a bit table in front."""

    ids: list[int]
    texts: list[bytes]
    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray

    @staticmethod
    def build(items: list[tuple[int, bytes]], q: int) -> _Index:
        texts = [fold(t)[0] for _, t in items]
        grams = [_grams(t, q) for t in texts]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        keys, begin = np.unique(h[order], return_index=True)
        table = np.zeros(1 << _BITS, bool)
        table[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return _Index([i for i, _ in items], [t.tobytes() for t in texts], keys, np.append(begin, len(h)).astype(np.int32), item[order].astype(np.int32), place[order].astype(np.int32), table)


@dataclass(frozen=True)
class Decontaminator:
    """Finds documents that hold passages of benchmark items.

    Documents need ``doc_id`` and ``text``, items ``item_id`` and ``text``. Null
    and empty texts match nothing, nor do items of fewer than ``q`` folded bytes.
    Repeated rows give repeated results, repeated items count once, and no items
    or no documents give no rows. A passage is any ``window`` bytes of an item in
    a row, or all of a shorter one; its edit budget is ``rate`` of its length. Of the
    passages in a region the one of fewest edits is given, of those the first.
    """

    q: int = 10
    window: int = 80
    rate: float = 0.07

    def _budget(self, m: int) -> tuple[int, int]:
        """Edits, and shared q-grams that the lemma then asks for; where it asks for none, one."""
        k = int(self.rate * m)
        return k, max(1, m - self.q + 1 - k * self.q)

    def _leaks(self, texts: list[bytes], index: _Index) -> list[list[tuple[int, int, int, int]]]:
        """Of each text: item, edits, and start and end byte of the first passage found."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not len(index.keys):
            return out
        q, reach = self.q, int(self.rate * self.window)
        width = max(16, reach)
        for a, b in chunks(texts):
            folded = [fold(t) for t in texts[a:b]]
            gap = np.zeros(q + 8, np.uint8)
            buf = np.concatenate([x for f, _ in folded for x in (f, gap)])
            offset = np.concatenate([[0], np.cumsum([len(f) + len(gap) for f, _ in folded])])
            h = _grams(buf, q)
            at = np.flatnonzero(index.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            k = np.searchsorted(index.keys, h[at])
            k[k == len(index.keys)] = 0
            real = index.keys[k] == h[at]
            at, k = at[real], k[real]
            if not len(at):
                continue
            at_doc = np.searchsorted(offset, at, side="right") - 1
            group, spot = self._hits(index, k, at_doc, at - offset[at_doc], width, reach)
            head = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
            size = np.diff(np.append(head, group.shape[1]))
            # the lemma's bound for a passage of this item; a document that a leak is known of is done
            least = np.array([self._budget(min(len(t), self.window))[1] for t in index.texts])
            for g in np.flatnonzero(size >= least[group[1, head]]):
                d, it, band = group[:, head[g]].tolist()
                if any(x[0] == it for x in out[a + d]):
                    continue
                text, where = folded[d]
                found = self._verify(index.texts[it], text, spot[head[g] : head[g] + size[g]], band * width - _SHIFT, width + reach)
                if found:
                    edits, lo, hi = found
                    out[a + d].append((it, edits, int(where[lo]), int(where[hi - 1]) + 1))
        return out

    @staticmethod
    def _hits(index: _Index, k: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places of items, sorted by their group: document, item and diagonal band.

        Diagonals count from the document's begin, so no band spans documents or
        depends on its neighbours. Grams that repeat in text and item make many pairs;
        these are made in parts and kept once a place.
        """
        many = index.begin[k + 1] - index.begin[k]
        ends = np.cumsum(many, dtype=np.int64)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + PAIRS, PAIRS), side="left").clip(0, len(k)))
        parts = [np.zeros((4, 0), np.int64)]
        for x, y in zip(cuts, [*cuts[1:], len(k)], strict=True):
            n, total = many[x:y].astype(np.int64), int(many[x:y].sum())
            if not total:
                continue
            slot = np.repeat(index.begin[k[x:y]] - (np.cumsum(n) - n), n) + np.arange(total)
            place = index.place[slot].astype(np.int64)
            diagonal = np.repeat(at[x:y], n) - place + _SHIFT
            band = diagonal // width
            rows = np.stack([np.repeat(doc[x:y], n), index.item[slot].astype(np.int64), band, place])
            near = rows[:, (diagonal - band * width < reach) & (band > 0)]
            near[2] -= 1  # bands overlap
            parts.append(_distinct(np.concatenate([rows, near], axis=1)))
        rows = _distinct(np.concatenate(parts, axis=1))
        return rows[:3], rows[3]

    def _verify(self, item: bytes, text: np.ndarray, places: np.ndarray, low: int, span: int) -> tuple[int, int, int] | None:
        """Edits, begin and end of the best passage in the text on ``span`` diagonals from ``low`` on."""
        m = min(len(item), self.window)
        k, least = self._budget(m)
        starts = np.arange(len(item) - m + 1)
        shared = np.searchsorted(places, starts + m - self.q, side="right") - np.searchsorted(places, starts)
        for s in np.flatnonzero(shared == m - self.q + 1).tolist():
            begin = max(0, s + low - k)
            at = text[begin : max(0, s + low + span + m + k)].tobytes().find(item[s : s + m])
            if at >= 0:
                return 0, begin + at, begin + at + m
        starts = starts[shared >= least]
        if not len(starts):
            return None
        raw = np.frombuffer(item, np.uint8)
        edits = window_edits(raw, text, starts, m, low - k, low + span + k, k)
        best = int(edits.argmin())
        if edits[best] > k:
            return None
        s = int(starts[best])
        found = locate(raw[s : s + m], text, s + low - k, s + low + span + k, k)
        return found if found[0] <= k and found[2] > found[1] else None

    def _blocks(self, items: DataFrame) -> tuple[DataFrame, int]:
        """Distinct usable items, and the number of passes that bounded memory takes."""
        rows = items.where("item_id is not null and length(text) > 0").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return rows, max(1, -(-total // BLOCK_BYTES))

    def _indexes(self, items: DataFrame) -> Iterator[tuple[_Index, bool]]:
        """Items in blocks of bounded text, one index at a time, and whether there are more."""
        rows, blocks = self._blocks(items)
        for b in range(blocks):
            part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
            yield _Index.build([(r["item_id"], r["text"].encode()) for r in part], self.q), blocks > 1

    def leaks(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """``doc_id, item_id, edits, start_byte, end_byte`` of each document and item found in it."""
        schema = "doc_id long, item_id long, edits int, start_byte long, end_byte long"
        docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        scratch, out = Scratch(docs.sparkSession, "leaks"), None
        for n, (index, more) in enumerate(self._indexes(items)):

            def run(batches: Iterator[pa.RecordBatch], index: _Index = index) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = self._leaks(as_bytes(batch.column(1)), index)
                    ids = batch.column(0).to_pylist()
                    rows = [(ids[i], index.ids[it], e, s, t) for i, x in enumerate(found) for it, e, s, t in x]
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "edits", "start_byte", "end_byte"])

            part = docs.mapInArrow(run, schema)
            if more:  # so that no two indexes are alive
                part = scratch.write(part, f"pass-{n}")
            out = part if out is None else out.union(part)
        return out

    def clean(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """The rows without any passage, all columns as they are; nothing is shuffled."""
        at, scratch = docs.columns.index("text"), Scratch(docs.sparkSession, "clean")
        for n, (index, more) in enumerate(self._indexes(items)):

            def run(batches: Iterator[pa.RecordBatch], index: _Index = index) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for first in range(0, batch.num_rows, ROWS):  # few texts are held twice at a time
                        part = batch.slice(first, ROWS)
                        keep = [not x for x in self._leaks(as_bytes(part.column(at)), index)]
                        yield part.filter(pa.array(keep, pa.bool_()))

            docs = docs.mapInArrow(run, docs.schema)
            if more:
                docs = scratch.write(docs, f"pass-{n}")
                if n:
                    scratch.drop(f"pass-{n - 1}")
        return docs
