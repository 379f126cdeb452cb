"""Keyword search and path queries over documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import parse_query
from ..functions.semantics import MAX_DEPTH, text_of
from ..plans.nodes import kind_name, leaves, matches
from ..plans.walker import Node, as_node, roots


def keyword_hit(text: Column, word: str, whole_word: bool) -> Column:
    if whole_word:
        return F.rlike(text, F.lit(rf"(?i)(?<!\w){re.escape(word)}(?!\w)"))
    return F.contains(F.lower(text), F.lit(word.lower()))


def keyword_test(leaf: Column, words: list[str], whole_word: bool, strings_only: bool) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | keyword_hit(leaf["txt"], w, whole_word)
    hit = F.coalesce(hit, F.lit(False))
    return hit & (leaf["kind"] == "string") if strings_only else hit


def _words(keywords: str | list[str]) -> list[str]:
    return [w for w in ([keywords] if isinstance(keywords, str) else keywords) if w]


def search(df: DataFrame, keywords: str | list[str], keep: list[str], whole_word: bool = False, strings_only: bool = False, limit: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row for each leaf that holds a keyword: ``keep..., path, value, key, keyword``.

    The keyword is the first of the list that hits; ``limit`` is for each document.
    """
    words = _words(keywords)
    found = F.filter(leaves(as_node(df), max_depth), lambda x: keyword_test(x, words, whole_word, strings_only))
    if limit is not None:
        found = F.slice(found, 1, limit) if limit > 0 else F.slice(found, 1, 0)
    rows = df.select(*keep, F.explode(found).alias("__hit"))
    first = F.coalesce(*[F.when(keyword_hit(F.col("__hit.txt"), w, whole_word), w) for w in words]) if words else F.lit(None).cast("string")
    return rows.select(*keep, F.col("__hit.path").alias("path"), F.col("__hit.txt").alias("value"), F.col("__hit.key").alias("key"), first.alias("keyword"))


def holds_any(nodes: list[Node], words: list[str], whole_word: bool = False, strings_only: bool = False, max_depth: int = MAX_DEPTH) -> Column:
    """Whether any leaf below the nodes holds a word; fields outside arrays are tested where they stand."""
    hit = F.lit(False)
    for n in nodes:
        if n.depth > max_depth + 1:
            continue
        if n.is_struct:
            below = holds_any(n.children(), words, whole_word, strings_only, max_depth)
            hit = hit | (n.col.isNotNull() & below)
        elif n.is_array:
            hit = hit | F.exists(leaves(n, max_depth), lambda x: keyword_test(x, words, whole_word, strings_only))
        elif not strings_only or kind_name(n.kind) == "string":
            for w in words:
                hit = hit | F.coalesce(keyword_hit(text_of(n.col, n.kind), w, whole_word), F.lit(False))
    return hit


def search_any(df: DataFrame, keywords: str | list[str], whole_word: bool = False, strings_only: bool = False, max_depth: int = MAX_DEPTH) -> Column:
    return holds_any(roots(df), _words(keywords), whole_word, strings_only, max_depth)


def query_path(df: DataFrame, path: str, max_depth: int = MAX_DEPTH) -> Column:
    """Matches of a path in each row's document, in pre-order: ``array<struct<path, value>>``."""
    segments = parse_query(path or "")
    return matches(as_node(df), segments, max_depth) if segments else F.array().cast("array<struct<path:string,value:string>>")


def query_rows(df: DataFrame, path: str, keep: list[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """The same, one row a match: ``keep..., pos, path, value``."""
    rows = df.select(*keep, F.posexplode(query_path(df, path, max_depth)).alias("pos", "__m"))
    return rows.select(*keep, "pos", F.col("__m.path").alias("path"), F.col("__m.value").alias("value"))


def get_first(df: DataFrame, path: str) -> Column:
    """The first match's value as JSON text, or null."""
    return F.get(query_path(df, path), F.lit(0))["value"]


def get_all(df: DataFrame, path: str) -> Column:
    return F.transform(query_path(df, path), lambda m: m["value"])
