"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import Decontaminator
from .inner_topk import InnerProductTopK
from .jaccard_join import JaccardJoin
from .katz import score_documents as katz_scores
from .kneser_ney import judge
from .language_id import LanguageIdentifier, LanguageModel, document_evidence, page_evidence
from .raking import Raking
from .secret_crf import SecretTagger, scan
from .storage import Scratch
from .toxicity import score_documents
from .warc_store import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"))


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scan(docs, SecretTagger.fit(docs, limit=40_000, sequences=2_000))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontaminator().leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return Raking(fraction=0.5, temper=0.5).draw(docs, columns=["doc_id", "source", "lang"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), limit=3_000)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(width=3, num=90, den=100).classes(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = document_evidence(docs).unionByName(page_evidence(_table(spark, sf_dir, "pages")))
    return LanguageIdentifier(LanguageModel.fit(docs)).identify(rows, Scratch(spark, "langid"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return judge(_table(spark, sf_dir, "documents"), trusted)


def op10_inner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return InnerProductTopK(k=10, every=100, scale=1024).search(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_katz": op1_katz,
    "op2_secret_crf": op2_secret_crf,
    "op3_decontaminate": op3_decontaminate,
    "op4_raking": op4_raking,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_inner_topk": op10_inner_topk,
}

SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             r AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
                          max(page_id) OVER (PARTITION BY b) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM r""",
    "op10_inner_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
             k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
}
