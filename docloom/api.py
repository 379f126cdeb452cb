"""Everything public in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .functions.detect import detect_pii, detect_type, is_date_like, is_numeric_like, is_sensitive_key
from .functions.formatters import create_boolean_formatter, create_currency_formatter, create_date_formatter, create_enum_formatter, create_number_formatter, format_boolean, format_currency, format_date, format_enum, format_number
from .functions.labels import ABBREVIATIONS, clear_label_cache, convert_key, convert_key_case, display_label, is_acronym, key_tokens, label_keys, last_segment, lookup, looks_like_acronym, merge_letters, sentence_case, title_case, title_word, tokenize, unescape_key
from .functions.masks import apply_mask, quick_hash, sha_prefix
from .functions.paths import any_matches, glob, globs, has_unsafe, is_valid, join_path, leaf_key, parent_path, parse_extract, split_path
from .functions.semantics import DELIMITER, MAX_DEPTH, UNSAFE_KEYS, is_unsafe, text_of
from .operators.csv_export import CsvColumn, to_csv
from .operators.documents import collect_keys, document_json, flatten, flatten_rows, is_empty_value, remove_nulls, row_keys, strip_empty
from .operators.extract import extract_field, has_field, omit_keys, pick_keys
from .operators.filters import exclude_keys, hide_if, include_keys, is_empty_array, is_empty_object, is_empty_string, is_falsy, is_null, is_nullish, removed_paths
from .operators.json_schema import json_schema, json_schema_from_samples, json_schema_text
from .operators.query import Query, all_of, from_, path_predicate
from .operators.search import get_all, get_first, keyword_hit, query_path, query_rows, search, search_any
from .operators.sections import Sections, flatten_sections, humanize, merge_sections
from .operators.security import mask_by_pattern, mask_by_pattern_audited, mask_sensitive, redact_keys, safe_clone
from .operators.structure import array_to_object, compact_sparse, deep_equal, deep_merge, merge_deep, normalize_keys, object_to_array, parse_flat_key, pivot_structure, remap, unflatten
from .operators.values import apply_defaults, inject_computed, transform_values
from .sources.parse import configure, deep_safe_parse, read_documents, safe_parse, safe_parse_typed


def to_safe_string(col: Column, kind: T.DataType) -> Column:
    """A value's text; null is empty."""
    return F.coalesce(text_of(col, kind), F.lit(""))


def deep_clone(df: DataFrame) -> DataFrame:
    """The table itself: tables don't change."""
    return df


def exclude_keys_direct(df: DataFrame, patterns: list[str], **options) -> DataFrame:
    return exclude_keys(df, patterns, **options)[0]


# forms without a report: these give the table itself already
include_keys_direct, hide_if_direct, strip_empty_direct, mask_by_pattern_direct, safe_clone_direct, remap_direct = include_keys, hide_if, strip_empty, mask_by_pattern, safe_clone, remap


def mask_sensitive_direct(df: DataFrame, *args, **options) -> DataFrame:
    return mask_sensitive(df, *args, **options).df


def redact_keys_direct(df: DataFrame, *args, **options) -> DataFrame:
    return redact_keys(df, *args, **options).df


def transform_values_direct(df: DataFrame, *args, **options) -> DataFrame:
    return transform_values(df, *args, **options)[0]


def to_csv_string(df: DataFrame, order: list[str], **options) -> str:
    """CSV text of a small table."""
    return to_csv(df, keep=order, **options).text(order)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "F", "T")]
