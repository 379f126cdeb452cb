"""Exact n-gram Jaccard join by parity sketches, and its link components.

Every text becomes its set of distinct word shingles. Sets fall in size bands.
A band of sets up to ``m`` shingles allows at most ``d = m (1 - t) / t`` shingles
of difference at threshold ``t``, so each set is cut by hash into ``p >= d + 1``
pieces and each piece is XOR-hashed into a 64-bit parity word: one shingle flips
one bit, so the Hamming distance of two sketches never exceeds the symmetric
difference. By the pigeonhole principle two linked sets agree on a piece. Empty
pieces say nothing: a band gets ``spare`` more pieces than it needs, and a set
with more empty pieces than that is cut again with another salt.

Work is linear in the pieces. Each set is first tested against the smallest one
that it shares a piece with; components of the links found so make nearly all
other pairs of a group needless. Sets outside a piece's largest component are
then tested against one member of it, and what pairs of different components
still share a piece are tested last. Every pair's sketches of about a bit a
shingle are compared before its sets are read. A piece that very many unlinked
sets share is first split by further cuts of the same sets, under each of which
linked ones agree again; what remains meets in bounded blocks. Their sketches are
compared in memory, and members that are near another one meet once more with
their sets, of which only links that join components come out. So no group is
expanded into its pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, merged
from .lookups import lookup
from .storage import Scratch
from .textkit import as_bytes, chunks, mix, shingle_sets

_SALTS = 4
_GROW = 1.5
#: Ids that may be broadcast as a filter (8 bytes each); more are joined.
BROADCAST_IDS = 2_000_000
#: Members of one piece whose open pairs are listed as rows; those of larger ones are compared by sketch.
LISTED = 8
#: Members of each side of one comparison, and bytes that the sets of a side may have: what a task holds at a time.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Pieces that a member names in a block, so that a pair is taken up in one piece only.
PIECES = 64
#: Members of one piece above which it is split by further cuts; how often at most, and by what factor a cut must lessen the comparisons to be taken.
SPLIT, LEVELS, GAIN = 4096, 6, 2.0


@dataclass(frozen=True)
class Threshold:
    """Link when ``den * |A and B| >= num * |A or B|``."""

    num: int
    den: int

    def difference(self, small: int) -> int:
        """Largest symmetric difference of a link whose smaller set has ``small`` shingles."""
        return small * (self.den - self.num) // self.num

    def linked(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


@lru_cache(maxsize=None)
def _bands(top: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, int(edges[-1] * _GROW)))
    return tuple(edges)


def _band(n: int) -> int:
    return int(np.searchsorted(_bands(max(n, 1 << 20)), n, side="right")) - 1


@lru_cache(maxsize=None)
def _plan(band: int, t: Threshold) -> tuple[int, int]:
    """Pieces and spare pieces of a band."""
    edges = _bands(1 << 40)
    low, high = edges[band], edges[band + 1] - 1
    need = t.difference(high) + 1
    spare = 0
    while need > 1:
        expected = (need + spare) * np.exp(-low / (need + spare))
        want = int(np.ceil(expected + 3 * np.sqrt(expected)))
        if want <= spare or spare > 4 * need:
            break
        spare += 1
    return need + spare, spare


def _bands_of(n: int, t: Threshold) -> range:
    """The own band, and those where a smaller partner may be."""
    return range(_band(-(-n * t.num // t.den)), _band(n) + 1)


def _words(hashes: np.ndarray, pieces: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity word, checksum and number of shingles of each piece."""
    h = mix(hashes + np.uint64(0x51ED270B * (salt + 1)))
    at = (h % np.uint64(pieces)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=pieces)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    word, check = np.zeros(pieces, np.uint64), np.zeros(pieces, np.uint64)
    full = count > 0
    bit = np.uint64(1) << (h >> np.uint64(58))
    word[full] = np.bitwise_xor.reduceat(bit[order], begin[full])
    check[full] = np.bitwise_xor.reduceat(hashes[order], begin[full])
    return word, check, count


def _keys(hashes: np.ndarray, t: Threshold) -> np.ndarray:
    """Join keys of a set; the low six bits hold the band."""
    out = []
    for band in _bands_of(len(hashes), t):
        pieces, spare = _plan(band, t)
        for salt in range(_SALTS):
            word, check, count = _words(hashes, pieces, salt)
            seed = np.uint64((band * _SALTS + salt) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            key = mix(mix(word + seed) ^ (check + np.arange(pieces, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))
            empty = int((count == 0).sum())
            keep = key if salt == _SALTS - 1 else key[count > 0]
            out.append((keep & ~np.uint64(63)) | np.uint64(band & 63))
            if empty <= spare:
                break
    return np.concatenate(out)


def _sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch of one to two bits a shingle; a power of two, so that larger ones fold to smaller ones."""
    bits = max(64, 1 << int(len(hashes) - 1).bit_length())
    at = (mix(hashes + np.uint64(0xABCDEF)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sub_keys(width: int, t: Threshold, salt: int):
    """Keys of every set under one more cut; sets with too many empty pieces keep those too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in chunks(texts, 1 << 20):
                ids, bands, keys = [], [], []
                for i, s in zip(batch.column(0).slice(a, b - a).to_pylist(), shingle_sets(texts[a:b], width), strict=True):
                    for band in _bands_of(len(s), t) if len(s) else ():
                        pieces, spare = _plan(band, t)
                        word, check, count = _words(s, pieces, salt)
                        key = mix(mix(word + np.uint64(salt)) ^ (check + np.arange(pieces, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))
                        keep = key if int((count == 0).sum()) > spare else key[count > 0]
                        keys.append(keep)
                        ids.append(np.full(len(keep), i, np.int64))
                        bands.append(np.full(len(keep), band & 63, np.int32))
                cat = lambda x, k: np.concatenate(x) if x else np.zeros(0, k)
                yield pa.record_batch([pa.array(cat(ids, np.int64)), pa.array(cat(bands, np.int32)), pa.array(cat(keys, np.uint64).view(np.int64))], ["rep", "band", "sub"])

    return run


_PACKED = "shard int, kind int, payload binary"
_FOUND = "kind int, doc_id long, key long, n long, x1 long, x2 long, sketch binary"


def _pack(shards: int, width: int, t: Threshold):
    """Per batch: signatures and sketches of all texts, and piece keys of one text of each distinct set.

    Keys that several texts of a batch share are known to be shared: those
    members go their own way, and only the smallest is sent to the key's shard,
    so a shard gets a key once a batch at most, however many texts have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), np.asarray(batch.column(0), dtype=np.int64)
            for a, b in chunks(texts, 2 << 20):
                rows: list[tuple[int, int, bytes]] = []
                sets = shingle_sets(texts[a:b], width)
                sig = np.zeros((b - a, 4), np.int64)
                first: dict[tuple, int] = {}
                for i, s in enumerate(sets):
                    x1 = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x1234567))) if len(s) else np.uint64(0)
                    x2 = np.add.reduce(mix(s + np.uint64(99))) if len(s) else np.uint64(0)
                    sig[i] = ids[a + i], len(s), x1.astype(np.int64), x2.astype(np.int64)
                    if len(s):
                        k = tuple(sig[i, 1:].tolist())
                        if k not in first or ids[a + i] < ids[a + first[k]]:
                            first[k] = i
                wide = [_sketch(s) if len(s) else b"" for s in sets]
                sizes = np.array([len(x) for x in wide], np.int64)
                rows.append((int(mix(np.uint64(ids[a]))) % shards, 2, np.int64(b - a).tobytes() + sig.tobytes() + sizes.tobytes() + b"".join(wide)))
                keyed = [(_keys(sets[i], t), ids[a + i]) for i in first.values()]
                keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in keyed)])
                owner = np.repeat(np.array([o for _, o in keyed], np.int64), np.array([len(k) for k, _ in keyed], np.int64))
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                head = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
                shared = ~head | np.concatenate([~head[1:], [False]])[: len(keys)]
                if shared.any():
                    part = np.stack([keys[shared].view(np.int64), owner[shared]])
                    rows.append((int(mix(np.uint64(ids[a] + 7))) % shards, 1, part.tobytes()))
                keys, owner = keys[head], owner[head]
                shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                for part in np.split(order, cuts) if len(order) else ():
                    rows.append((int(shard[part[0]]), 0, np.stack([keys[part].view(np.int64), owner[part]]).tobytes()))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "kind", "payload"])

    return run


def _shared_keys(table: pa.Table) -> pa.Table:
    """Of one shard: members of keys that several batches have, and what only passes through."""
    kinds, payload = table.column("kind").to_pylist(), table.column("payload")
    sig, sketch = [np.zeros((0, 4), np.int64)], []
    for i, k in enumerate(kinds):
        if k == 2:
            raw = payload[i].as_py()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            sig.append(np.frombuffer(raw, np.int64, 4 * n, 8).reshape(-1, 4))
            ends = 8 + 40 * n + np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 32 * n))
            sketch += [raw[x:y] for x, y in zip([8 + 40 * n, *ends[:-1]], ends, strict=True)]
    passed = [np.frombuffer(payload[i].as_buffer(), np.int64).reshape(2, -1) for i, k in enumerate(kinds) if k == 1]
    sent = [np.frombuffer(payload[i].as_buffer(), np.int64).reshape(2, -1) for i, k in enumerate(kinds) if k == 0]
    members = passed
    if sent:
        both = np.concatenate(sent, axis=1)
        both = both[:, np.argsort(both[0], kind="stable")]
        same = both[0, 1:] == both[0, :-1]
        members = passed + [both[:, np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
    m = np.concatenate(members, axis=1) if members else np.zeros((2, 0), np.int64)
    s = np.concatenate(sig)
    a, b = m.shape[1], len(s)
    zero = np.zeros(a, np.int64)
    return pa.table({
        "kind": pa.array(np.concatenate([np.ones(a, np.int32), np.full(b, 2, np.int32)])),
        "doc_id": pa.array(np.concatenate([m[1], s[:, 0]])),
        "key": pa.array(np.concatenate([m[0], np.zeros(b, np.int64)])),
        "n": pa.array(np.concatenate([zero, s[:, 1]])), "x1": pa.array(np.concatenate([zero, s[:, 2]])), "x2": pa.array(np.concatenate([zero, s[:, 3]])),
        "sketch": pa.array([None] * a + sketch, pa.binary()),
    })


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's stored size; where it has none, the texts are measured."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def shard_count(df: DataFrame, each: int = 4 << 20) -> int:
    """Shards that grow with the table, about ``each`` stored bytes behind one."""
    return max(input_bytes(df) // each, 8)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids; the ids are broadcast only when counted small."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in chunks(texts, 4 << 20):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], width)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "elements"])

    return run


def _close(t: Threshold):
    """Of pairs with sizes and sketches: those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            keep = np.minimum(a, b) * t.den >= np.maximum(a, b) * t.num
            most = (a + b) * (t.den - t.num) // (t.den + t.num)
            for i in np.flatnonzero(keep):
                x, y = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)
                w = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum()) <= most[i]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(a: np.ndarray, b: np.ndarray, t: Threshold) -> bool:
    """Whether two sorted sets link."""
    if not len(a) or min(len(a), len(b)) * t.den < max(len(a), len(b)) * t.num:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return common > 0 and t.linked(len(a), len(b), common)


def _verified(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), t) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([out.column(0), out.column(1)], ["u", "v"])

    return run


def _near(table: pa.Table, t: Threshold, size: np.ndarray, sketch: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Of one block: each row of role 1, and the rows of role 0 that may link with it, nearest sketches first.

    Pairs of one component are left out, and pairs that name a common smaller piece, as they meet there too.
    """
    role, comp, free = (np.asarray(table.column(c)) for c in ("role", "comp", "free"))
    ids, key = np.asarray(table.column("rep")), table.column("key")[0].as_py()
    words = min(map(len, sketch))
    sketch = [_folded(x, words) for x in sketch]
    every, pieces, smaller = np.flatnonzero(role == 0), table.column("pieces"), {}

    def below(i: int) -> frozenset[int]:
        if i not in smaller:
            smaller[i] = frozenset(k for k in pieces[i].as_py() if k < key)
        return smaller[i]

    wide = np.stack([sketch[i] for i in every]) if len(every) else np.zeros((0, words), np.uint64)
    for r in np.flatnonzero(role == 1).tolist():
        apart = np.bitwise_count(wide ^ sketch[r]).sum(axis=1, dtype=np.int64)
        most = (size[every] + size[r]) * (t.den - t.num) // (t.den + t.num)
        # two members outside the largest component meet in both roles
        hit = np.flatnonzero((apart <= most) & (comp[every] != comp[r]) & (~free[every] | (ids[every] < ids[r])))
        hit = every[hit[np.argsort(apart[hit], kind="stable")]]
        own = np.array([i for i in hit.tolist() if below(r).isdisjoint(below(i))], np.int64)
        if len(own):
            yield r, own


def _block_members(t: Threshold):
    """Of one block of a piece: the members that are near another one by sketch."""

    def run(table: pa.Table) -> pa.Table:
        sketch = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sketch")]
        found = [np.append(own, r) for r, own in _near(table, t, np.asarray(table.column("n")), sketch)]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        out = table.select(["key", "x", "y", "role", "rep", "comp", "free"]).take(pa.array(at))
        return out.append_column("pieces", table.column("pieces").take(pa.array(at)).cast(pa.list_(pa.int64())))

    return run


def _block_links(t: Threshold):
    """Of one block's near members with their sets: links that join components, so fewer than members."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = np.asarray(table.column("rep")), np.asarray(table.column("comp")).copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        us, vs = [], []
        for r, own in _near(table, t, np.array([len(s) for s in sets], np.int64), [np.frombuffer(_sketch(s), np.uint64) for s in sets]):
            for i in own.tolist():
                if label[i] != label[r] and _links(sets[i], sets[r], t):
                    us.append(max(ids[i], ids[r]))
                    vs.append(min(ids[i], ids[r]))
                    label[label == label[i]] = label[r]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


@dataclass(frozen=True)
class JaccardJoin:
    """Links of documents whose word-shingle sets are similar, as components.

    ``docs`` needs ``doc_id`` (long, unique) and ``text``; other columns are
    ignored. Null and empty texts, and texts of blanks, have no shingles and
    link with nothing. Rows with a null ``doc_id`` take no part. Equal texts
    share a component. An empty table gives no rows.
    """

    width: int = 5
    num: int = 80
    den: int = 100

    def classes(self, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
        """One row a document: ``doc_id, n_shingles, component_id``."""
        t = Threshold(self.num, self.den)
        scratch = scratch or Scratch(docs.sparkSession, "jaccard")
        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        shards = shard_count(docs)
        packed = docs.mapInArrow(_pack(shards, self.width, t), _PACKED)
        found = scratch.write(packed.groupBy("shard").applyInArrow(_shared_keys, _FOUND), "found", ("kind",))
        sig = found.where("kind = 2").select("doc_id", "n", "x1", "x2")
        copies = sig.where("n > 0").groupBy("n", "x1", "x2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
        copies = scratch.write(copies, "copies")
        member = scratch.write(lookup(sig, copies, ["n", "x1", "x2"], 32, "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n"), "member")
        sketch = found.where("kind = 2 and n > 0").select("doc_id", "n", "sketch")
        shared = found.where("kind = 1").select("doc_id", "key").distinct()
        by_key = shared.join(member.select("doc_id", "rep"), "doc_id").select("key", "rep").distinct()
        by_key = scratch.write(by_key, "keys")
        hubs = by_key.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).where("members > 1")
        star = by_key.join(hubs, "key").groupBy(F.col("rep").alias("u")).agg(F.min("hub").alias("v")).where("u <> v")
        tested = scratch.write(star, "tested-1")
        links = self._verify(docs, tested, sketch, scratch, "links-1")
        comp = components(links, scratch, "cc1")
        for k, pairs in ((2, self._second_hubs), (3, self._open_pairs)):
            comp = scratch.write(comp, f"comp-{k}")
            placed = by_key.join(comp.withColumnRenamed("vertex", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
            open_ = self._mixed(placed, scratch, f"mixed-{k}")
            if open_.isEmpty():
                break
            if k == 3:
                open_ = self._split(docs, open_, scratch)
            more = scratch.write(pairs(open_).distinct().join(tested, ["u", "v"], "left_anti"), f"tested-{k}")
            tested = tested.union(more)
            links = self._verify(docs, more, sketch, scratch, f"links-{k}")
            if k == 3:
                links = links.unionByName(self._blocks(docs, open_, sketch, scratch))
            comp = merged(comp, links, scratch, f"cc{k}")
        comp = scratch.write(comp, "components")
        scratch.keep("member", "components")
        return lookup(member, comp.withColumnRenamed("vertex", "rep"), ["rep"], 16, "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
        )

    def _verify(self, docs: DataFrame, pairs: DataFrame, sketch: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Pairs that link: first by sketches, what these leave by the sets themselves."""
        t = Threshold(self.num, self.den)
        left = sketch.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
        right = sketch.select(F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
        near = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "su", "sv")
        near = scratch.write(near.mapInArrow(_close(t), "u long, v long"), f"{name}-near")
        ids = near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
        ids = scratch.write(ids, f"{name}-ids")
        sets = scratch.write(_only(docs, ids).mapInArrow(_sets(self.width), "doc_id long, elements binary"), f"{name}-sets")
        left = sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("a"))
        right = sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("b"))
        joined = near.join(left, "u").join(right, "v").select("u", "v", "a", "b")
        links = scratch.write(joined.mapInArrow(_verified(t), "u long, v long"), name)
        scratch.drop(f"{name}-sets")
        return links

    @staticmethod
    def _mixed(placed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Members of pieces that several components share, with the piece's largest component and a member of it."""
        per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("rep").alias("top"))
        mixed = per.groupBy("key").agg(F.sum("c").alias("total"), F.count("*").alias("comps"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max_by("top", F.struct("c", "comp")).alias("hub"))
        return scratch.write(placed.join(mixed.where("comps > 1").drop("comps"), "key"), name)

    @staticmethod
    def _second_hubs(rows: DataFrame) -> DataFrame:
        """Members outside a piece's largest component against one member of it."""
        return rows.where("comp <> main").select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v"))

    def _split(self, docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """The rows, those of pieces with over ``SPLIT`` members regrouped by further cuts of the same sets."""
        small, t = rows.where(F.col("total") <= SPLIT), Threshold(self.num, self.den)
        large = rows.where(F.col("total") > SPLIT)
        for level in range(LEVELS):
            if large.isEmpty():
                return small
            ids = scratch.write(large.select(F.col("rep").alias("doc_id")).distinct(), f"split-ids-{level}")
            sub = scratch.write(_only(docs, ids).mapInArrow(_sub_keys(self.width, t, _SALTS + level), "rep long, band int, sub long"), f"split-keys-{level}")
            cut = large.withColumn("band", F.col("key").bitwiseAND(63).cast("int")).join(sub, ["rep", "band"])
            key = F.xxhash64("key", "sub").bitwiseAND(~63).bitwiseOR(F.col("band").cast("long"))
            cut = self._mixed(cut.select(key.alias("key"), "rep", "comp").distinct(), scratch, f"split-{level}")
            before, after = (df.agg(F.sum(F.col("total") - F.col("most"))).first()[0] or 0 for df in (large, cut))
            if after * GAIN > before:
                break  # sets so alike that every cut puts them together again
            small, large = small.unionByName(cut.where(F.col("total") <= SPLIT)), cut.where(F.col("total") > SPLIT)
        return small.unionByName(large)

    @staticmethod
    def _open_pairs(rows: DataFrame) -> DataFrame:
        """All pairs of different components that share a small piece."""
        rows = rows.where(f"total <= {LISTED}")
        a, b = rows.alias("a"), rows.where("comp <> main").alias("b")
        listed = a.join(b, F.col("a.key") == F.col("b.key")).where("a.comp <> b.comp")
        return listed.select(F.greatest("a.rep", "b.rep").alias("u"), F.least("a.rep", "b.rep").alias("v"))

    def _blocks(self, docs: DataFrame, rows: DataFrame, sketch: DataFrame, scratch: Scratch) -> DataFrame:
        """Links that join the components of larger pieces; rows out follow members, not pairs."""
        t, rows = Threshold(self.num, self.den), rows.where(f"total > {LISTED}")
        edges = _bands(1 << 40)
        most = [max(min(BLOCK, BLOCK_BYTES // (8 * edges[b + 1])), min(BLOCK, 16)) for b in range(64)]
        band = F.col("key").bitwiseAND(63).cast("int")
        rows = rows.select("key", "rep", "comp", "total", "most", (F.col("comp") != F.col("main")).alias("free"), F.element_at(F.array(*map(F.lit, most)), band + 1).alias("block"))
        # most pieces fit one block; larger ones are laid out as a grid of blocks
        one = [rows.where("total <= block").where(f"{r} = 0 or free").select("key", "rep", "comp", "free", F.lit(r).alias("role"), F.lit(0).alias("x"), F.lit(0).alias("y")) for r in (0, 1)]
        wide = rows.where("total > block").withColumn("cols", F.ceil(F.col("total") / F.col("block")).cast("int")).withColumn("bars", F.ceil((F.col("total") - F.col("most")) / F.col("block")).cast("int"))
        place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        every = wide.select("key", "rep", "comp", "free", F.lit(0).alias("role"), place("cols").alias("x"), F.explode(F.sequence(F.lit(0), F.col("bars") - 1)).alias("y"))
        rest = wide.where("free").select("key", "rep", "comp", "free", F.lit(1).alias("role"), place("bars").alias("y"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("x"))
        # the smallest of a member's pieces tell nearly always where a pair meets first; if not, it is compared again
        about = rows.groupBy("rep").agg(F.slice(F.sort_array(F.collect_set("key")), 1, PIECES).alias("pieces")).join(sketch.withColumnRenamed("doc_id", "rep"), "rep")
        laid = one[0].unionByName(one[1]).unionByName(every).unionByName(rest).join(about, "rep")
        near = laid.groupBy("key", "x", "y").applyInArrow(_block_members(t), "key long, x int, y int, role int, rep long, comp long, free boolean, pieces array<long>")
        near = scratch.write(near, "near")
        ids = scratch.write(near.select(F.col("rep").alias("doc_id")).distinct(), "near-ids")
        sets = scratch.write(_only(docs, ids).mapInArrow(_sets(self.width), "doc_id long, elements binary"), "near-sets")
        links = near.join(sets.withColumnRenamed("doc_id", "rep"), "rep").groupBy("key", "x", "y").applyInArrow(_block_links(t), "u long, v long")
        return scratch.write(links, "block-links")
