"""Quality by an interpolated modified Kneser-Ney word-bigram model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .jaccard_join import BROADCAST_IDS
from .lookups import lookup
from .ngram_shards import Figures, Layout, Sample, common_values, count_bigrams, count_words, score, split_parts, unpack_sorted, weigh
from .storage import Scratch

_FILTER_BITS = 26
#: Bigrams of a model up to which their keys are marked; beyond, all bigrams of the documents are sent.
_FILTER_PAIRS = 1 << 24
#: Trusted text behind one shard of the model.
SHARD_BYTES = 4 << 20
#: Turns in which the shards are counted and asked, so that the postings of one turn are on disk at a time; fewer for less text than so much a turn.
TURNS, TURN_BYTES = 4, 16 << 20
#: Text whose postings meet in one group, on average, when documents are scored.
GROUP_BYTES = 32 << 20


def discounts(cc: tuple[int, ...]) -> np.ndarray:
    """Chen and Goodman's discounts of counts 0, 1, 2, and 3 and more; three quarters where counts of counts fail."""
    out = np.array([0.0, 0.75, 0.75, 0.75])
    if cc[0] and cc[1]:
        y = cc[0] / (cc[0] + 2 * cc[1])
        for r in (1, 2, 3):
            d = r - (r + 1) * y * cc[r] / cc[r - 1] if cc[r - 1] else -1.0
            if 0 < d < r:
                out[r] = d
    return out


class KneserNey:
    """Formulas of the model; logs are natural.

    Unigrams are continuation shares, discounted and interpolated with a uniform
    share of the words and one unknown; bigrams are discounted shares
    interpolated with those, so both sum to one.
    """

    second = 1

    def __init__(self, f: Figures):
        self.pairs, self.words = max(f.pairs, 1), f.words
        self.d1, self.d2 = discounts(f.before_cc), discounts(f.bigram_cc)
        n1, n2 = f.before_cc[0], f.before_cc[1]
        freed = self.d1[1] * n1 + self.d1[2] * n2 + self.d1[3] * (f.words - n1 - n2)
        self.spread = (freed / self.pairs if f.words else 1.0) / (self.words + 1)

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(n - self.d1[np.minimum(n, 3)], 0) / self.pairs + self.spread

    def sums(self, start: np.ndarray, c: np.ndarray, wc: np.ndarray, wn: np.ndarray) -> np.ndarray:
        """Per first word: its count, and what discounting frees."""
        return np.stack([np.add.reduceat(c.astype(float), start), np.add.reduceat(self.d2[np.minimum(c, 3)], start)], axis=1)

    def back(self, s: np.ndarray) -> np.ndarray:
        return np.log(s[:, 1] / s[:, 0])

    def gain(self, c: np.ndarray, f: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.log1p((c - self.d2[np.minimum(c, 3)]) / (s[:, 1] * self.unigram(f)))

    def value(self, c: np.ndarray, n: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.stack([known.astype(float), np.zeros(len(c)), np.log(self.unigram(n))], axis=1)


def _seen(model: DataFrame) -> np.ndarray:
    """Packed bits of the bigram keys of a model of at most ``_FILTER_PAIRS`` bigrams."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _FILTER_BITS, bool)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                at = unpack_sorted(split_parts(payload)[0]) >> np.uint64(64 - _FILTER_BITS)
                bits[at.astype(np.int64)] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    # the number of keys is bounded, so one task can mark them; one row of eight MB comes back
    row = model.where("kind = 0").select("payload").coalesce(1).mapInArrow(marked, "bits binary").first()
    return np.frombuffer(row["bits"], np.uint8) if row is not None else np.zeros(1 << (_FILTER_BITS - 3), np.uint8)


def parts_of(size: int, layout: Layout) -> tuple[int, int]:
    """Parts of each word shard and bigram shard for scoring ``size`` bytes of text, so that groups don't grow with it."""
    return max(1, -(-size // (layout.word_shards * GROUP_BYTES))), max(1, -(-size // (layout.shards * GROUP_BYTES)))


def judge(docs: DataFrame, trusted: DataFrame, limit: int | None = None, low: float = 0.01, high: float = 0.99, slack: float = 2.0, shards: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Perplexity of every document, and whether it is within its language's limits.

    ``trusted`` has the ``doc_id`` of trusted documents. The model is fitted on
    all of their distinct texts; a ``limit``, if one is given, keeps those of the
    smallest digests. The limits of a language are the ``low`` and ``high``
    quantiles of the perplexity of all its trusted documents (of those that a
    ``limit`` leaves out of the model, if there are any), widened by the factor
    ``slack``, as the model has seen their texts; a language without trusted documents
    takes those of all languages together, and without any trusted document
    nothing is refused.

    Reads ``doc_id, text, lang``. Null and empty texts are the end token alone; a
    null lang is a language of its own. Every row comes out, repeated ones as often
    as they stand, also where doc_ids are null or repeated; a null doc_id is not
    trusted. No rows give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "kneser-ney")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("(null)")).alias("lang"))
    trusted = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    hashed = docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("h"), "text")
    marked = hashed.select("doc_id", "h").join(trusted, "doc_id")
    picked = marked.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    picked = scratch.write(picked if limit is None else picked.orderBy("h").limit(limit), "picked")
    own = F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked
    train = scratch.write(hashed.join(own, ["h", "doc_id"], "left_semi").dropDuplicates(["h"]).select("text"), "train")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(16, size // SHARD_BYTES)
    sample = Sample.of(train)  # tells where to spread and what to sum early; counts are of all texts
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(shards, max(4, shards // 4), sample.hot(shards), min(TURNS, shards, 1 + whole // TURN_BYTES))
    bigrams = scratch.write_turns(lambda t: count_bigrams(train, layout, t), "bigrams", layout.turns, codec="none")
    scratch.drop("train")
    words = scratch.write(count_words(bigrams, layout), "words", ("kind",), "none")
    figures = Figures.of(bigrams, words)
    kn = KneserNey(figures)
    model = weigh(bigrams, words, layout, kn, scratch, "model", "bigrams")
    scratch.drop("words/kind=1")  # the answers have been used
    seen = _seen(model) if figures.pairs <= _FILTER_PAIRS else None
    # the model may be much smaller than the documents: its shards are copied then, and the documents' blocks dealt over the copies
    parts = parts_of(whole, layout)
    backoffs = ["model/kind=1"] if layout.turns == 1 else [f"model/turn={t}/kind=1" for t in range(layout.turns)]
    got = score(docs.withColumnRenamed("lang", "tag"), words, model, layout, kn, scratch, common_values(words, model, kn, sample), seen, ("words", *backoffs), "model", parts)
    got = scratch.write(got.select("doc_id", F.col("tag").alias("lang"), "n_tokens", F.exp(-F.col("s2") / F.col("n_tokens")).alias("perplexity")), "scores")
    inside = marked.join(own.select("h"), "h", "left_semi").select("doc_id").distinct().withColumn("inside", F.lit(True))
    known = trusted.withColumn("trusted", F.lit(True)).join(inside, "doc_id", "left")
    good = scratch.write(got.join(known, "doc_id"), "trusted")
    picks = lambda df, *by: df.groupBy(*by).agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("limits"))
    outside = picks(good.where("inside is null"), "lang").withColumnRenamed("limits", "a")
    within = picks(good, "lang").withColumnRenamed("limits", "b")
    every = picks(good).first()["limits"] or [0.0, float("inf")]
    limits = scratch.write(within.join(outside, "lang", "left").select("lang", F.coalesce("a", "b").alias("limits")), "limits")
    scratch.keep("scores", "limits")
    rows = lookup(got, limits, ["lang"], 100, "left").withColumn("limits", F.coalesce("limits", F.array(*[F.lit(float(x)) for x in every])))
    least, most = F.col("limits")[0] / slack, F.col("limits")[1] * slack
    return rows.select("doc_id", "lang", "n_tokens", "perplexity", most.alias("threshold"), F.col("perplexity").between(least, most).alias("accepted"))
