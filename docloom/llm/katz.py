"""Katz backoff word-bigram model with Good-Turing discounts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .jaccard_join import shard_count
from .ngram_shards import LARGEST, Figures, Layout, Sample, common_values, count_bigrams, count_words, fold_of, score, weigh
from .storage import Scratch


def good_turing(cc: tuple[int, ...]) -> np.ndarray:
    """Discount ratio of counts 0, 1, ..., 5 and more (none), from counts of counts.

    Katz's form, in which discounts stop after five. Where counts of counts
    leave a ratio outside (0, 1), half a count is taken off instead.
    """
    out = np.ones(LARGEST + 1)
    k = LARGEST - 1
    top = (k + 1) * cc[k] / cc[0] if cc[0] else 1.0
    for r in range(1, k + 1):
        ratio = ((r + 1) * cc[r] / (r * cc[r - 1]) - top) / (1 - top) if cc[r - 1] and top < 1 else -1.0
        out[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return out


class Katz:
    """Formulas of the model, given the whole counts' figures; logs are to base 10.

    Unigrams: discounted shares of the training tokens; what that leaves is the
    probability of the one class of unknown words, so they sum to one. Bigrams:
    discounted shares of the first word's count; what that leaves is spread over
    all other words by their unigram probability, scaled to sum to one exactly.
    A first word whose followers leave nothing gets half a count more below the line.
    """

    second = 0

    def __init__(self, f: Figures):
        self.tokens, self.words = max(f.tokens, 1), f.words
        self.d1, self.d2 = good_turing(f.word_cc), good_turing(f.bigram_cc)
        kept = f.tokens - sum((1 - self.d1[r]) * r * f.word_cc[r - 1] for r in range(1, LARGEST))
        # without words that were seen once there may be nothing left
        self.below = self.tokens if kept < f.tokens - 1e-9 else self.tokens + 0.5
        self.unknown = (1.0 if f.words == 0 else (self.below - kept) / self.below)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d1[np.minimum(c, LARGEST)] * c / self.below, self.unknown)

    def sums(self, start: np.ndarray, c: np.ndarray, wc: np.ndarray, wn: np.ndarray) -> np.ndarray:
        """Per first word: its count, discounted count and its followers' unigram mass."""
        return np.stack([np.add.reduceat(c.astype(float), start), np.add.reduceat(self.d2[np.minimum(c, LARGEST)] * c, start), np.add.reduceat(self.unigram(wc), start)], axis=1)

    def _below(self, s: np.ndarray) -> np.ndarray:
        return np.where(s[:, 1] < s[:, 0] - 1e-9, s[:, 0], s[:, 0] + 0.5)

    def back(self, s: np.ndarray) -> np.ndarray:
        below = self._below(s)
        return np.log10((below - s[:, 1]) / below) - np.log10(np.maximum(1 - s[:, 2], 1e-12))

    def gain(self, c: np.ndarray, f: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.log10(self.d2[np.minimum(c, LARGEST)] * c / self._below(s)) - np.log10(self.unigram(f)) - self.back(s)

    def value(self, c: np.ndarray, n: np.ndarray, known: np.ndarray) -> np.ndarray:
        base = np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        return np.stack([known.astype(float), base, np.log10(self.unigram(c))], axis=1)


def score_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Train on rows whose crc32(doc_id) mod 5 is not 1, score all rows.

    Reads ``doc_id`` and ``text``. Null and empty texts are the end token alone;
    a null doc_id folds as an empty text. Repeated rows count, and come out, as
    often as they stand. With no training rows every token is unknown (its
    probability one), and no rows give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "katz")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shard_count(docs, 2 << 20)
    train = docs.where(fold_of(F.col("doc_id"), 5) != 1).select("text")
    sample = Sample.of(train)
    layout = Layout(shards, max(4, shards // 8), sample.hot(shards))
    bigrams = scratch.write(count_bigrams(train, layout), "bigrams", codec="none")
    words = scratch.write(count_words(bigrams, layout), "words", ("kind",), "none")
    figures = Figures.of(bigrams, words)
    katz = Katz(figures)
    model = weigh(bigrams, words, layout, katz, scratch, "model")
    scratch.drop("bigrams")
    scratch.drop("words/kind=1")  # the answers have been used
    common = common_values(words, model, katz, sample)
    got = score(docs, words, model, layout, katz, scratch, common, spent=("words", "model/kind=1"))
    scratch.keep("sums-words", "sums-pairs")
    return got.select(
        "doc_id",
        (fold_of(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        F.round("s0").cast("long").alias("n_known"),
        F.lit(figures.tokens).cast("long").alias("train_tokens"),
        F.col("s1").alias("base_score"),
        F.col("s2").alias("score"),
    )
