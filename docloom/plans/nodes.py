"""Leaves and matches of typed documents as arrays, and of variant documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.paths import Deep, Index, Star
from ..functions.semantics import MAX_DEPTH, is_nested, json_of, text_of
from .walker import Node

LEAF = "struct<path:string,key:string,kind:string,txt:string>"


def kind_name(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "array" if isinstance(kind, T.ArrayType) else "object" if is_nested(kind) else "string"


def _step(path: Column, key: str) -> Column:
    piece = f"[{key}]" if "." in key else key
    return F.when(path == "", F.lit(piece)).otherwise(F.concat(path, F.lit("." + piece)))


def _place(path: Column, i: Column) -> Column:
    return F.when(path == "", i.cast("string")).otherwise(F.concat(path, F.lit("."), i.cast("string")))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def leaves(node: Node, max_depth: int = MAX_DEPTH, path: Column | None = None) -> Column:
    """All scalars below a node in document order: ``array<struct<path, key, kind, txt>>``; nulls have no text."""
    path = F.lit("") if path is None else path
    if node.depth > max_depth + 1:
        return _none(LEAF)
    if node.is_struct:
        parts = [leaves(c, max_depth, _step(path, c.key)) for c in node.children()]
        return F.coalesce(F.when(node.col.isNotNull(), F.concat(*parts) if parts else _none(LEAF)), _none(LEAF))
    if node.is_array:
        each = F.transform(node.col, lambda x, i: leaves(node.element(x), max_depth, _place(path, i)))
        return F.coalesce(F.flatten(each), _none(LEAF))
    key = next((k for k in reversed(node.path) if k is not None), "")
    return F.array(F.struct(path.alias("path"), F.lit(key).alias("key"), F.lit(kind_name(node.kind)).alias("kind"), text_of(node.col, node.kind).alias("txt")))


MATCH = "struct<path:string,value:string>"


def matches(node: Node, segments: list, max_depth: int = MAX_DEPTH, path: Column | None = None) -> Column:
    """Nodes that a query path reaches, in pre-order: ``array<struct<path, value>>``, values as JSON text."""
    path = F.lit("") if path is None else path
    if node.depth > max_depth + 1:
        return _none(MATCH)
    if not segments:
        return F.array(F.struct(path.alias("path"), json_of(node.col, node.kind).alias("value")))
    head, rest = segments[0], segments[1:]

    def below(tail: list) -> Column:
        if node.is_struct:
            parts = [F.when(node.col.isNotNull(), matches(c, tail, max_depth, _step(path, c.key))) for c in node.children()]
            return F.flatten(F.array_compact(F.array(*parts))) if parts else _none(MATCH)
        if node.is_array:
            return F.coalesce(F.flatten(F.transform(node.col, lambda x, i: matches(node.element(x), tail, max_depth, _place(path, i)))), _none(MATCH))
        return _none(MATCH)

    if isinstance(head, Deep):
        return F.concat(matches(node, rest, max_depth, path), below(segments))
    if isinstance(head, Star):
        return below(rest)
    if isinstance(head, Index):
        if not node.is_array:
            return _none(MATCH)
        found = matches(node.element(F.get(node.col, F.lit(head.at))), rest, max_depth, _place(path, F.lit(head.at)))
        return F.coalesce(F.when(F.size(node.col) > head.at, found), _none(MATCH))
    child = next((c for c in node.children() if c.key == head), None)
    if child is None:
        return _none(MATCH)
    return F.coalesce(F.when(node.col.isNotNull(), matches(child, rest, max_depth, _step(path, head))), _none(MATCH))


def variant_nodes(df: DataFrame, column: str, keep: list[str], depth: int = 6) -> DataFrame:
    """One row for each node below a VARIANT column: ``keep..., path, key, pos, depth, kind, txt, value``.

    Lateral explodes, one a level, so it also runs on streams. Object keys come in
    the order of VARIANT, which is alphabetical.
    """
    spark = df.sparkSession
    level = df.select(*keep, F.col(column).alias("value"), F.lit("").alias("path"))
    out = None
    for d in range(1, depth + 1):
        step = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "child"))
        piece = F.coalesce("key", F.col("pos").cast("string"))
        piece = F.when(piece.contains("."), F.concat(F.lit("["), piece, F.lit("]"))).otherwise(piece)
        level = step.select(*keep, "pos", "key", F.col("child").alias("value"), F.when(F.col("path") == "", piece).otherwise(F.concat("path", F.lit("."), piece)).alias("path"))
        rows = level.select(*keep, "path", "key", "pos", F.lit(d).alias("depth"), F.schema_of_variant("value").alias("kind"), F.expr("try_variant_get(value, '$', 'string')").alias("txt"), "value")
        out = rows if out is None else out.unionByName(rows)
        level = level.select(*keep, "value", "path")
    return out
