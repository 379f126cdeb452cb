"""Masking and redaction of sensitive fields, with audit trails."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.detect import detect_pii, key_category
from ..functions.masks import apply_mask
from ..functions.paths import any_matches, globs
from ..functions.semantics import MAX_DEPTH, text_of
from ..plans.walker import DESCEND, DROP, KEEP, Built, Node, rewrite

AUDIT = "array<struct<path:string,key:string,action:string,mode:string,category:string>>"


@dataclass
class Masked:
    """A table, and an audit of what was done to each row, a column over the table as it came."""

    df: DataFrame
    audit: Column
    paths: list[str] = field(default_factory=list)
    again: Callable[[Column, str], DataFrame] | None = None

    def audited(self, name: str = "audit") -> DataFrame:
        """The table with its audit beside it, both from one pass."""
        return self.again(self.audit, name)


def _again(df: DataFrame, visit: Callable[[Node], str | Built], max_depth: int) -> Callable[[Column, str], DataFrame]:
    def run(audit: Column, name: str) -> DataFrame:
        return rewrite(df.withColumn(name, audit), lambda n: KEEP if n.path and n.path[0] == name else visit(n), max_depth=max_depth)

    return run


def _shown(node: Node) -> str:
    return ".".join(s if s is not None else "*" for s in node.path)


def _entry(node: Node, action: str, mode: str | None, category: Column | None, when: Column | None) -> Column:
    none = F.lit(None).cast("string")
    e = F.struct(F.lit(_shown(node)).alias("path"), F.lit(node.key or "").alias("key"), F.lit(action).alias("action"), (F.lit(mode) if mode else none).alias("mode"), (none if category is None else category).alias("category"))
    return e if when is None else F.when(when, e)


def _trail(entries: list[Column]) -> Column:
    return F.array_compact(F.array(*entries)) if entries else F.array().cast(AUDIT)


def _found(node: Node, threshold: float, categories: list[str] | None) -> tuple[Column, Column] | None:
    """Whether a leaf is sensitive enough, and its category; None where that is settled as no."""
    if node.key is None or node.is_struct or (not isinstance(node.kind, T.StringType) and key_category(node.key) is None):
        return None
    d = detect_pii(node.key, node.col, node.kind)
    test = d["sensitive"] & (d["confidence"] >= threshold)
    if categories:
        test = test & d["category"].isin(categories)
    return F.coalesce(test, F.lit(False)), d["category"]


def mask_sensitive(df: DataFrame, fields: list[str] = (), mode: str = "full", custom: Callable[[Column], Column] | None = None, auto_detect: bool = False, threshold: float = 0.8, categories: list[str] | None = None, mark: str = "*", max_depth: int = MAX_DEPTH) -> Masked:
    """Fields whose path or name matches become masked text, nested values too; a null becomes empty text.

    ``auto_detect`` also masks leaves that are sensitive by name or value.
    The audit is kept for fields outside arrays.
    """
    compiled = globs(fields)
    entries: list[Column] = []
    paths: list[str] = []

    def visit(node: Node) -> str | Built:
        if node.key is None:
            return DESCEND
        text = F.lit("[object Object]") if node.is_struct else text_of(node.col, node.kind)
        if fields and any_matches(compiled, node.path, node.key):
            paths.append(_shown(node))
            if None not in node.path:
                entries.append(_entry(node, "masked", mode, None, None))
            return Built(apply_mask(text, mode, mark, custom), T.StringType())
        hit = _found(node, threshold, categories) if auto_detect else None
        if hit is not None:
            if None not in node.path:
                entries.append(_entry(node, "masked", mode, hit[1], hit[0]))
            if isinstance(node.kind, T.StringType):
                return Built(F.when(hit[0], apply_mask(text, mode, mark, custom)).otherwise(node.col), node.kind)
            sure = key_category(node.key)
            if sure and sure[1] >= threshold and (not categories or sure[0] in categories):
                return Built(apply_mask(text, mode, mark, custom), T.StringType())
        return DESCEND

    out = rewrite(df, visit, max_depth=max_depth)
    return Masked(out, _trail(entries), list(paths), _again(df, visit, max_depth))


def redact_keys(df: DataFrame, keys: list[str] = (), auto_detect: bool = False, threshold: float = 0.8, categories: list[str] | None = None, max_depth: int = MAX_DEPTH) -> Masked:
    """Keys whose path or name matches are removed; with ``auto_detect`` sensitive names too, and values that are become null."""
    compiled = globs(keys)
    entries: list[Column] = []
    paths: list[str] = []

    def visit(node: Node) -> str | Built:
        if node.key is None:
            return DESCEND
        if keys and any_matches(compiled, node.path, node.key):
            paths.append(_shown(node))
            if None not in node.path:
                entries.append(_entry(node, "redacted", None, None, None))
            return DROP
        if auto_detect:
            sure = key_category(node.key)
            if sure and sure[1] >= threshold and (not categories or sure[0] in categories):
                paths.append(_shown(node))
                if None not in node.path:
                    entries.append(_entry(node, "redacted", None, F.lit(sure[0]), None))
                return DROP
            hit = _found(node, threshold, categories)
            if hit is not None:
                if None not in node.path:
                    entries.append(_entry(node, "redacted", None, hit[1], hit[0]))
                return Built(F.when(~hit[0], node.col), node.kind)
        return DESCEND

    out = rewrite(df, visit, max_depth=max_depth)
    return Masked(out, _trail(entries), list(paths), _again(df, visit, max_depth))


def _matches_masked(text: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    """The text put together again from what stands between matches, and masks of these."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # an empty match at the very begin splits off nothing
    between = F.when(F.size(between) == F.size(found), F.concat(F.array(F.lit("")), between)).otherwise(between)
    masked = F.concat(F.transform(found, mask), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, masked, lambda x, m: F.concat(x, m)), "")


def mask_by_pattern_audited(df: DataFrame, patterns: list[str], mode: str = "full", match_only: bool = False, mark: str = "*", custom: Callable[[Column], Column] | None = None, max_depth: int = MAX_DEPTH) -> Masked:
    """String fields that hold a pattern are masked, whole or only where they match; strings inside arrays stay.

    The audit is kept for fields outside arrays; its size is a row's number of masked fields.
    """
    entries: list[Column] = []
    for p in patterns:
        re.compile(p)

    def visit(node: Node) -> str | Built:
        if node.key is None or not isinstance(node.kind, T.StringType):
            return DESCEND if node.is_struct or node.is_array else KEEP
        col = node.col
        for p in patterns:
            if not match_only:
                col = F.when(node.col.rlike(p), apply_mask(node.col, mode, mark, custom)).otherwise(col)
                continue
            col = _matches_masked(col, p, lambda m: apply_mask(m, mode, mark, custom))
        if None not in node.path:
            entries.append(_entry(node, "masked", mode, None, ~col.eqNullSafe(node.col) if match_only else reduce(lambda a, b: a | b, [F.coalesce(node.col.rlike(p), F.lit(False)) for p in patterns], F.lit(False))))
        return Built(col, node.kind)

    out = rewrite(df, visit, max_depth=max_depth)
    return Masked(out, _trail(entries), again=_again(df, visit, max_depth))


def mask_by_pattern(df: DataFrame, patterns: list[str], mode: str = "full", match_only: bool = False, **options) -> DataFrame:
    """The masked table alone."""
    return mask_by_pattern_audited(df, patterns, mode, match_only, **options).df


def safe_clone(df: DataFrame, mask_fields: list[str] = (), redact_fields: list[str] = (), mode: str = "full", auto_detect: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Redaction, then masking; with ``auto_detect`` redaction leaves masking nothing to find."""
    out = redact_keys(df, list(redact_fields), auto_detect=auto_detect, max_depth=max_depth).df
    return mask_sensitive(out, list(mask_fields), mode, auto_detect=auto_detect, max_depth=max_depth).df
