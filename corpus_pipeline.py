"""The corpus pipeline: five stages over ``documents``, each reading what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm.decontaminate import Decontaminator
from docloom.llm.jaccard_join import BROADCAST_IDS, JaccardJoin
from docloom.llm.language_id import keep_identified
from docloom.llm.raking import Raking
from docloom.llm.secret_crf import SecretTagger, redact
from docloom.llm.storage import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates (five words, 0.8).

    Of a row that is repeated whole one stays; rows without a doc_id all do.
    """
    scratch = Scratch(spark, "copies")
    classes = JaccardJoin(width=5, num=80, den=100).classes(docs)
    copies = scratch.write(classes.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = _without(docs, copies)
    again = scratch.write(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    few = again.count() <= BROADCAST_IDS
    return _without(kept, again).unionByName(kept.join(F.broadcast(again) if few else again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates())


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of other ids; the ids are broadcast only where counted small."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    clean = Decontaminator().clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return Scratch(spark, "clean").write(clean, "docs")  # in small batches for Python


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars set anew."""
    clean = redact(docs, SecretTagger.fit(docs))
    clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return Scratch(spark, "hidden").write(clean, "docs")  # in small batches for Python


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the source, language and topic targets."""
    drawn = Raking(fraction=0.5, temper=0.5).draw(docs)
    return drawn.where("sampled").select(*docs.columns, "topic", "tokens", "probability")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets),
    ("mix", mix),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
