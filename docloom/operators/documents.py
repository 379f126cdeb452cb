"""Flattening, cleaning and key discovery of typed documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.semantics import DELIMITER, MAX_DEPTH, is_array, is_nested, text_of
from ..plans.nodes import leaves
from ..plans.walker import DESCEND, KEEP, Built, Node, as_node, rewrite, roots


@dataclass
class Flat:
    """A flat table, and what the schema tells of it."""

    df: DataFrame
    leaf_count: int
    max_depth: int
    array_object_paths: list[str] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return self.df.columns


def _flat_key(prefix: str, key: str, delimiter: str) -> str:
    piece = f"[{key}]" if delimiter in key else key
    return f"{prefix}{delimiter}{piece}" if prefix else piece


def _array_text(col: Column, kind: T.ArrayType) -> Column:
    """Scalars joined by comma and blank, null items empty; an empty array is null."""
    items = F.transform(col, lambda x: F.coalesce(text_of(x, kind.elementType), F.lit("null")))
    return F.when(F.size(col) > 0, F.array_join(items, ", "))


def flatten(df: DataFrame, delimiter: str = DELIMITER, max_depth: int = MAX_DEPTH, skip_arrays: bool = False, exclude_keys: list[str] = ()) -> Flat:
    """One column for each leaf, named by its path.

    Arrays of scalars become text, other arrays JSON text; what lies below
    ``max_depth`` becomes JSON text; empty objects and arrays are null.
    """
    out: dict[str, Column] = {}
    arrays: list[str] = []
    deepest = 0

    def walk(node: Node, name: str, depth: int) -> None:
        nonlocal deepest
        deepest = max(deepest, depth)
        if is_array(node.kind):
            if skip_arrays:
                return
            if is_nested(node.kind.elementType):
                arrays.append(name)
                out[name] = F.when(F.size(node.col) > 0, F.to_json(node.col))
            else:
                out[name] = _array_text(node.col, node.kind)
        elif node.is_struct:
            if depth > max_depth:
                out[name] = F.to_json(node.col)
            elif not node.children():
                out[name] = F.lit(None).cast("string")
            for c in node.children() if depth <= max_depth else ():
                if c.key not in exclude_keys:
                    walk(c, _flat_key(name, c.key, delimiter), depth + 1)
        else:
            out[name] = F.to_json(node.col) if is_nested(node.kind) else node.col

    for r in roots(df):
        if r.key not in exclude_keys:
            walk(r, _flat_key("", r.key, delimiter), 1)
    return Flat(df.select(*[c.alias(k) for k, c in out.items()]), len(out), deepest, arrays)


def flatten_rows(df: DataFrame, prefix_by: str, **options) -> DataFrame:
    """Long form: ``row, key, value``; keys carry the row's number, which no fixed schema could."""
    flat = flatten(df, **options)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), text_of(F.col(f"`{k}`"), flat.df.schema[k].dataType).alias("value")) for k in flat.keys])
    return flat.df.select(F.col(f"`{prefix_by}`").alias("row"), F.explode(pairs).alias("p")).select("row", F.concat(F.col("row").cast("string"), F.lit("."), "p.key").alias("key"), "p.value")


def row_keys(*tables: DataFrame) -> list[str]:
    """Union of the columns, in order of first appearance."""
    return list(dict.fromkeys(c for t in tables for c in t.columns))


def collect_keys(df: DataFrame, dot_notation: bool = False, max_depth: int = MAX_DEPTH) -> tuple[list[str], int]:
    """Keys, or dotted paths, that the schema has, and the number of object entries in it."""
    keys: dict[str, None] = {}
    n = 0

    def walk(node: Node, name: str) -> None:
        nonlocal n
        if node.is_struct and node.depth <= max_depth:
            for c in node.children():
                n += 1
                full = f"{name}.{c.key}" if name else c.key
                keys[full if dot_notation else c.key] = None
                walk(c, full)
        elif is_array(node.kind):
            walk(Node(node.col, node.kind.elementType, node.path), name)

    walk(as_node(df), "")
    return list(keys), n


def is_empty_value(col: Column, kind: T.DataType) -> Column:
    """Null, blank text, or an array or object without anything in it."""
    if isinstance(kind, T.StringType):
        return col.isNull() | (F.trim(col) == "")
    if is_array(kind) or isinstance(kind, T.MapType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()


def _prune(df: DataFrame, gone, drop_empty_objects: bool, drop_empty_arrays: bool, max_depth: int) -> DataFrame:
    """Nulls in place of what ``gone(node, column)`` names, from below; JSON text then leaves the keys out."""

    def visit(node: Node) -> str:
        return DESCEND if node.is_struct or node.is_array else KEEP

    def after(node: Node, b: Built) -> Built:
        col, kind = b.col, b.kind
        if isinstance(kind, T.StructType):
            if drop_empty_objects and kind.fields:
                some = F.lit(False)
                for f in kind.fields:
                    some = some | col.getField(f.name).isNotNull()
                col = F.when(some, col)
        elif is_array(kind):
            if not is_nested(kind.elementType):
                inner = kind.elementType
                col = F.transform(col, lambda x: F.when(~gone(inner, x), x))
            col = F.filter(col, lambda x: x.isNotNull())
            if drop_empty_arrays:
                col = F.when(F.size(col) > 0, col)
        else:
            col = F.when(~gone(kind, col), col)
        return Built(col, kind)

    return rewrite(df, visit, max_depth=max_depth, after=after)


def remove_nulls(df: DataFrame, remove_empty_strings: bool = True, remove_empty_arrays: bool = False, remove_empty_objects: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Removed fields are null, and absent from JSON text; null items leave arrays."""

    def gone(kind: T.DataType, col: Column) -> Column:
        return F.coalesce(col == "", F.lit(False)) if remove_empty_strings and isinstance(kind, T.StringType) else F.lit(False)

    return _prune(df, gone, remove_empty_objects, remove_empty_arrays, max_depth)


def strip_empty(df: DataFrame, preserve_false: bool = True, preserve_zero: bool = True, preserve_empty_strings: bool = False, preserve_empty_arrays: bool = False, preserve_empty_objects: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Null, empty text, empty arrays and empty objects removed, children first."""

    def gone(kind: T.DataType, col: Column) -> Column:
        if isinstance(kind, T.StringType) and not preserve_empty_strings:
            return F.coalesce(col == "", F.lit(False))
        if isinstance(kind, T.BooleanType) and not preserve_false:
            return F.coalesce(~col, F.lit(False))
        if isinstance(kind, T.NumericType) and not preserve_zero:
            return F.coalesce(col == 0, F.lit(False))
        return F.lit(False)

    return _prune(df, gone, not preserve_empty_objects, not preserve_empty_arrays, max_depth)


def document_json(df: DataFrame) -> Column:
    """Each row as JSON text, without null fields."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def leaf_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row a leaf: ``keep..., path, key, kind, txt``."""
    rows = df.select(*keep, F.explode(leaves(as_node(df))).alias("l"))
    return rows.select(*keep, "l.path", "l.key", "l.kind", "l.txt")


