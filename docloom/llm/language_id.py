"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from byte-trigram models fitted on a bounded labelled
sample. Everything else covers all rows by grouped aggregation: how often each
declared markup language goes with each language of the texts, and priors of
each host, smoothed towards those of its address suffix, smoothed towards the
whole. A row's own vote is taken out of its priors. The class ``und`` stands for
text of no known language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .lookups import lookup
from .storage import Scratch
from .textkit import _FOLD, as_bytes, chunks

_BUCKETS = 1 << 16
UNKNOWN = "und"
#: Rows that may be broadcast as a filter; more are joined.
BROADCAST_IDS = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of letters and blanks, and each text's first; no trigram is all blank."""
    raw = _FOLD[np.frombuffer(b"  " + b"  ".join(texts) + b"   ", np.uint8)]
    letter = _LETTER[raw]
    raw = np.where(letter, raw, np.uint8(32)).astype(np.uint32)
    code = raw[:-2] | (raw[1:-1] << 8) | (raw[2:] << 16)
    keep = letter[1:-1]  # the middle one is a letter, so none spans two texts
    at = np.flatnonzero(keep)
    bucket = (code[at] * np.uint32(2654435761)) >> np.uint32(16)
    begin = 2 + np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    return bucket.astype(np.int64), np.searchsorted(at + 1, begin)


def suffix_of(host: Column) -> Column:
    """The last label of a host name; empty where there is no dot."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Text, declared language, host and suffix of raw pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), text.alias("text"), declared.alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"))


def document_evidence(docs: DataFrame, *keep: str) -> DataFrame:
    """The same of documents: ``lang`` is what is declared, ``source`` the host. Columns of ``keep`` go along."""
    host = F.lower(F.coalesce(F.col("source").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string"), F.lower(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"), *keep)


@dataclass(frozen=True)
class LanguageModel:
    """Trigram log-probabilities of each language; of bounded size."""

    languages: tuple[str, ...]
    table: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, limit: int = 8000, most: int = 256) -> LanguageModel:
        """Learn from at most ``limit`` texts with a declared language, those of the smallest digests.

        At most ``most`` languages, the commonest of the sample; others are unknown.
        """
        rows = docs.where("lang is not null and lang <> '' and length(text) > 0").select(F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string"), F.xxhash64("text", "lang").alias("h"))
        picked = F.broadcast(rows.select("h").distinct().orderBy("h").limit(limit))  # a fixed number of digests
        named = rows.join(picked, "h", "left_semi").select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
        sample = rows.join(picked, "h", "left_semi").join(F.broadcast(named), "lang", "left_semi").dropDuplicates(["h"])  # at most ``most`` names

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                texts, langs = as_bytes(batch.column(1)), batch.column(0).to_pylist()
                for a, b in chunks(texts):
                    bucket, first = _trigrams(texts[a:b])
                    for i in range(b - a):
                        c = held.setdefault(langs[a + i], np.zeros(_BUCKETS + 1))
                        c[:_BUCKETS] += np.bincount(bucket[first[i] : first[i + 1]], minlength=_BUCKETS)
                        c[_BUCKETS] += 1
            for k, c in held.items():
                at = np.flatnonzero(c)
                yield pa.record_batch([pa.array([k] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

        found: dict[str, np.ndarray] = {}
        for r in sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most ``most`` times the buckets, by partition
            found.setdefault(r["lang"], np.zeros(_BUCKETS + 1))[r["bucket"]] = r["n"]
        names = sorted(found)
        table = np.zeros((_BUCKETS, len(names) + 1), np.float32)
        for j, k in enumerate(names):
            c = found[k][:_BUCKETS]
            table[:, j] = np.log((c + 0.1) / (c.sum() + 0.1 * _BUCKETS))
        table[:, -1] = np.log(1.0 / _BUCKETS)
        return LanguageModel((*names, UNKNOWN), table)

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """The rows without their text, with ``grams`` and tempered log-likelihoods ``ll``."""
        keep = [c for c in rows.columns if c != text]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + ", grams long, ll array<double>"
        table = self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
                total, size = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
                for a, b in chunks(texts):
                    bucket, first = _trigrams(texts[a:b])
                    n = np.diff(first)
                    size[a:b] = n
                    full = np.flatnonzero(n)
                    if len(full):
                        total[a:b][full] = np.add.reduceat(table[bucket].astype(np.float64), first[:-1][full], axis=0)
                # neighbouring trigrams tell much the same: evidence saturates
                total /= (1.0 + size / 60.0)[:, None]
                ll = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, table.shape[1], dtype=np.int32)), pa.array(total.ravel()))
                yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(size), ll], [*keep, "grams", "ll"])

        return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class LanguageIdentifier:
    """Posterior language of rows ``text, declared, host, suffix``; other columns pass through.

    Nulls in them count as empty, and what is empty says nothing. Texts without
    letters are ``und`` and rejected, as are rows whose best posterior is below
    ``least``. Repeated rows count as often as they stand. No rows give no rows.
    """

    model: LanguageModel
    least: float = 0.5
    strength: float = 20.0
    unknown_prior: float = 1e-3

    def identify(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Adds ``language``, ``posterior`` and ``accepted``; drops the text."""
        names = self.model.languages
        size = len(names)
        rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "declared", "host", "suffix")})
        scored = self.model.score(rows).withColumn("best", F.when(F.col("grams") > 0, F.array_position("ll", F.array_max("ll")) - 1).otherwise(size - 1).cast("int"))
        scored = scratch.write(scored, "scored")
        votes = [F.count_if(F.col("best") == i).cast("double") for i in range(size)]
        total = scored.agg(F.array(*votes).alias("all_votes")).first()["all_votes"]
        seen = sum(total) or 1.0
        prior = [(1 - self.unknown_prior) * (total[i] + 1) / (seen - total[-1] + size - 1) for i in range(size - 1)] + [self.unknown_prior]
        overall = F.array(*[F.lit(float(p)) for p in prior])
        by_suffix = scored.groupBy("suffix").agg(F.array(*votes).alias("suffix_votes"))
        by_host = scored.groupBy("host", "suffix").agg(F.array(*votes).alias("host_votes"))
        by_declared = scored.groupBy("declared").agg(F.array(*votes).alias("declared_votes"))
        # a host, suffix or declared language may have a third of all rows
        by_suffix, by_host, by_declared = scratch.write(by_suffix, "by-suffix"), scratch.write(by_host, "by-host"), scratch.write(by_declared, "by-declared")
        known = scratch.write(lookup(by_host, by_suffix, ["suffix"], 8 * size + 64), "known")
        rows = lookup(lookup(scored, known, ["host", "suffix"], 16 * size + 128), by_declared, ["declared"], 8 * size + 64)
        k = self.strength

        def own(votes: str) -> Column:
            """Votes of the group without the row's own."""
            return F.transform(F.col(votes), lambda v, i: F.when(i == F.col("best"), v - 1).otherwise(v))

        def smoothed(votes: Column, base: Column) -> Column:
            n = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)
            return F.zip_with(votes, base, lambda v, b: (v + k * b) / (n + k))

        by_suffix_prior = F.when(F.col("suffix") == "", overall).otherwise(smoothed(own("suffix_votes"), overall))
        rows = rows.withColumn("_prior", by_suffix_prior)
        rows = rows.withColumn("_prior", F.when(F.col("host") == "", F.col("_prior")).otherwise(smoothed(own("host_votes"), F.col("_prior"))))
        # P(declared | language): its share of the language's votes, smoothed by its share of all
        share = F.aggregate(F.col("declared_votes"), F.lit(0.0), lambda a, v: a + v) / seen
        of_language = F.array(*[F.lit(float(v)) for v in total])
        told = F.zip_with(own("declared_votes"), of_language, lambda v, n: (v + k * share) / (n + k))
        rows = rows.withColumn("_told", F.when(F.col("declared") == "", F.array_repeat(F.lit(1.0), size)).otherwise(told))
        joint = F.zip_with(F.zip_with("ll", "_prior", lambda x, p: x + F.log(p)), "_told", lambda x, p: x + F.log(F.greatest(p, F.lit(1e-12))))
        rows = rows.withColumn("_joint", joint).withColumn("_top", F.array_max("_joint"))
        rows = rows.withColumn("posterior", 1 / F.aggregate(F.col("_joint"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))))
        language = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("_joint", F.col("_top")).cast("int"))
        rows = rows.withColumn("language", F.when(F.col("grams") > 0, language).otherwise(UNKNOWN))
        rows = rows.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= self.least))
        return rows.drop("ll", "best", "grams", "host_votes", "suffix_votes", "declared_votes", "_prior", "_told", "_joint", "_top")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is accepted, all columns as they are.

    Judged row by row: rows of one doc_id, or without any, stand or go each by its own text.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "text", "lang", "source")]
    keys = {"__row_a": F.xxhash64(*parts), "__row_b": F.xxhash64(*reversed(parts))}  # 128 bits of what is judged
    marked = docs.withColumns(keys)
    judged = LanguageIdentifier(LanguageModel.fit(docs)).identify(document_evidence(marked, *keys), scratch)
    refused = scratch.write(judged.where("not accepted").select(*keys).distinct(), "refused")
    scratch.keep("refused")
    small = refused.count() <= BROADCAST_IDS
    return marked.join(F.broadcast(refused) if small else refused, list(keys), "left_anti").drop(*keys)
