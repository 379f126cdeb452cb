"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is made of toxic training texts and one of ordinary ones, each by
itself and in the same way: the words that its class's texts use in most
contexts, the commonest last, where references are short. Contexts are counted
rather than occurrences, so that copies of a text don't fill a dictionary with
its rare words. Every text is cut into overlapping windows of running text; a window's gain is its compressed length
with the ordinary dictionary less that with the toxic one. What a text is judged
by are the shares of its windows whose gains reach each of several thresholds,
and its largest gain; a logistic calibration on training texts that neither
dictionary has seen turns these into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .textkit import as_bytes, chunks

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Gains in bytes whose shares of windows are features.
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8)


def dictionary(texts: list[bytes], size: int, contexts: int) -> bytes:
    """The words that follow at least ``contexts`` different words, up to ``size`` bytes, commonest last."""
    known: dict[bytes, int] = {}
    pairs, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in texts:
        words = _WORD.findall(t)
        at = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at
        pair = np.unique((before + 1) << 32 | at)
        pairs.append(pair)
        owner.append(pair & 0xFFFFFFFF)
    _, first = np.unique(np.concatenate(pairs), return_index=True)
    held = np.bincount(np.concatenate(owner)[first], minlength=len(known))
    chosen, total = [], 0
    for w in sorted((w for w, i in known.items() if held[i] >= contexts), key=lambda w: (-held[known[w]], w)):
        total += len(w) + 1
        if total > size:
            break
        chosen.append(w)
    return b" " + b" ".join(reversed(chosen)) + b" " * 8  # zstandard wants eight bytes


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(window_log=19, chain_log=18, hash_log=18, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=d)


def windows(sizes: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and owner of each window of texts that lie end to end; the last of a text ends with it."""
    count = np.where(sizes > 0, np.maximum(-(-(sizes - width) // step), 0) + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(sizes) - sizes
    return base[owner] + nth * step, np.minimum(width, sizes[owner] - nth * step), owner


def compressed_lengths(c: zstandard.ZstdCompressor, buffer: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Compressed bytes of each window of the buffer."""
    if not len(begin):
        return np.zeros(0, np.int64)
    segments = np.stack([begin, length], axis=1).astype(np.uint64).tobytes()
    out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, segments), threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


@dataclass(frozen=True)
class CompressionToxicity:
    """A fitted model; small, of bounded size.

    ``score`` reads ``doc_id`` and ``text`` only, over whole texts. Null and empty
    texts have no windows and get the calibrated score of no gain. Repeated rows
    score alike; no rows give no rows.
    """

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    width: int = 32
    step: int = 24
    threshold: float = 0.3

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, limit: int = 3_000, text_bytes: int = 32 << 10, size: int = 200_000, contexts: int = 8) -> CompressionToxicity:
        """Learn from documents ``doc_id, text`` with labels ``doc_id, toxic``.

        At most ``limit`` rows of each label are read, those of the smallest text
        digests, so the choice depends neither on order nor on partitions and equal
        texts fall out together. Texts of over ``text_bytes`` are not drawn, so that
        the sample is bounded in bytes too; they are scored like all others. Ids and
        digests alone are joined and sorted; only the chosen rows' texts move. A
        quarter of the distinct texts, chosen by digest, calibrates; the rest makes
        the dictionaries, ``size`` bytes each at most. The calibration weighs the
        sample's labels as often as all rows have them. Rows with a null label or
        text are left out; without both labels the score is the share of toxic ones.
        """
        docs = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        digests = docs.select("doc_id", F.xxhash64("text").alias("h"), (F.octet_length("text") <= text_bytes).alias("fits"))
        marked = digests.join(labels.where("toxic is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")), "doc_id")
        distinct = marked.where("fits").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
        share = {bool(r["y"]): r["n"] for r in marked.groupBy((F.col("toxic") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
        picked = [distinct.where((F.col("toxic") == 1) == y).orderBy("h", "toxic").limit(limit) for y in (True, False)]  # bounded samples
        texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.encode("text", "UTF-8").alias("text"))
        rows = texts.join(F.broadcast(picked[0].union(picked[1])), ["doc_id", "h"]).select("h", "toxic", "text").collect()
        sample = sorted({(r["h"], int(r["toxic"] == 1), bytes(r["text"]).translate(_FOLD)) for r in rows})
        part = {y: [t for h, k, t in sample if k == y and h % 4] for y in (0, 1)}
        held = [(t, y) for h, y, t in sample if h % 4 == 0]
        total = sum(share.values())
        flat = (float(np.log((share.get(True, 0) + 0.5) / (share.get(False, 0) + 0.5))) if total else 0.0, *[0.0] * (len(THRESHOLDS) + 2))
        model = CompressionToxicity(dictionary(part[1], size, contexts), dictionary(part[0], size, contexts), flat)
        if not part[0] or not part[1] or len({y for _, y in held}) < 2:
            return model
        x, y = model.features([t for t, _ in held]), np.array([y for _, y in held], float)
        return CompressionToxicity(model.toxic, model.ordinary, logistic(x, y, np.where(y == 1, share[True] / y.sum(), share[False] / (len(y) - y.sum()))))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of folded texts: one, shares of windows whose gain reaches each threshold, largest gain, and length."""
        toxic, ordinary = compressor(self.toxic), compressor(self.ordinary)
        return np.concatenate([self._features(texts[a:b], toxic, ordinary) for a, b in chunks(texts)]) if texts else np.zeros((0, len(THRESHOLDS) + 3))

    def _features(self, texts: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        begin, length, owner = windows(sizes, self.width, self.step)
        out = np.zeros((len(texts), len(THRESHOLDS) + 3))
        out[:, 0] = 1
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        buffer, most = b"".join(texts), np.zeros(len(texts))
        for a in range(0, len(begin), 1 << 16):  # a very long text has many windows
            g = slice(a, a + (1 << 16))
            gain = compressed_lengths(ordinary, buffer, begin[g], length[g]) - compressed_lengths(toxic, buffer, begin[g], length[g])
            for k, least in enumerate(THRESHOLDS, 1):
                out[:, k] += np.bincount(owner[g], gain >= least, len(texts))
            np.maximum.at(most, owner[g], gain)
        # square roots, as one window in ten tells more than the tenth after nine
        out[:, 1:-2] = np.sqrt(out[:, 1:-2] / count[:, None])
        out[:, -2], out[:, -1] = np.minimum(most, 20) / 10, np.log1p(count) / 5
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, score, predicted, top_gain`` of every row."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            toxic, ordinary = compressor(model.toxic), compressor(model.ordinary)
            for batch in batches:
                texts = as_bytes(batch.column(1))
                for a, b in chunks(texts):
                    x = model._features([t.translate(_FOLD) for t in texts[a:b]], toxic, ordinary)
                    p = model.probabilities(x)
                    yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= model.threshold).astype(np.int32)), pa.array(np.rint(x[:, -2] * 10).astype(np.int64))], ["doc_id", "score", "predicted", "top_gain"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, top_gain long")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton's method; the first column is one and not shrunk."""
    w, cost = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - cost @ w
        w += np.clip(np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + cost, grad), -5, 5)
    return tuple(w.tolist())


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = 3_000) -> DataFrame:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not 2, score all rows."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = CompressionToxicity.fit(docs.select("doc_id", "text"), labels.where(fold != 2), limit)
    return model.score(docs).withColumn("held_out", fold == 2).select("doc_id", "held_out", "score", "predicted", "top_gain")
