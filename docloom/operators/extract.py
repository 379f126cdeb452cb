"""Safe access to fields by path, over structs, arrays, maps and variants."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.paths import Index, Segment, parse_extract
from ..functions.semantics import is_unsafe
from ..plans.walker import Built, Node, as_node


def _variant_path(segments: list[Segment]) -> str:
    return "$" + "".join(f"[{s.at}]" if isinstance(s, Index) else f"[{json.dumps(s)}]" for s in segments)


def follow(node: Node, segments: list[Segment]) -> Built:
    """The value at a path; null where anything on the way is missing."""
    nothing = Built(F.lit(None), T.NullType())
    for i, s in enumerate(segments):
        if isinstance(s, str) and is_unsafe(s):
            return nothing
        if isinstance(node.kind, T.VariantType):
            return Built(F.try_variant_get(node.col, _variant_path(segments[i:]), "variant"), T.VariantType())
        if isinstance(s, Index):
            if not node.is_array:
                return nothing
            node = Node(F.get(node.col, F.lit(s.at)), node.kind.elementType, (*node.path, None))
        elif isinstance(node.kind, T.MapType):
            node = Node(F.try_element_at(node.col, F.lit(s)), node.kind.valueType, (*node.path, s))
        else:
            found = next((c for c in node.children() if c.key == s), None)
            if found is None:
                return nothing
            node = found
    return Built(node.col, node.kind)


def resolve(df: DataFrame, path: str) -> Built:
    """The column at an extract path of the table's rows."""
    segments = parse_extract(path)
    if segments and isinstance(segments[0], str) and path in df.columns:
        segments = [path]
    if segments and isinstance(segments[0], str) and segments[0] in df.columns and not is_unsafe(segments[0]):
        field = next(f for f in reversed(df.schema.fields) if f.name == segments[0])
        return follow(Node(F.col(f"`{segments[0]}`"), field.dataType, (segments[0],)), segments[1:])
    return Built(F.lit(None), T.NullType())


def extract_field(df: DataFrame, path: str, default: object = None) -> Column:
    """The value at the path; ``default`` stands for both missing and null."""
    col = resolve(df, path).col
    return col if default is None else F.coalesce(col, F.lit(default))


def has_field(df: DataFrame, path: str) -> Column:
    """Whether the path is there; an explicit null counts as there."""
    segments = parse_extract(path)
    if not segments:
        return F.lit(False)
    node, ok = as_node(df), F.lit(True)
    for i, s in enumerate(segments):
        if isinstance(s, str) and is_unsafe(s):
            return F.lit(False)
        if isinstance(node.kind, T.VariantType):
            return ok & F.try_variant_get(node.col, _variant_path(segments[i:]), "variant").isNotNull()
        if node.path:
            ok = ok & node.col.isNotNull()
        if isinstance(s, Index):
            if not node.is_array:
                return F.lit(False)
            ok = ok & (F.size(node.col) > s.at)
            node = Node(F.get(node.col, F.lit(s.at)), node.kind.elementType, (*node.path, None))
        elif isinstance(node.kind, T.MapType):
            ok = ok & F.map_contains_key(node.col, F.lit(s))
            node = Node(F.try_element_at(node.col, F.lit(s)), node.kind.valueType, (*node.path, s))
        else:
            found = next((c for c in (node.children() if node.path else [Node(F.col(f"`{f.name}`"), f.dataType, (f.name,)) for f in node.kind.fields]) if c.key == s), None)
            if found is None:
                return F.lit(False)
            node = found
    return F.coalesce(ok, F.lit(False))


def pick_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only the named columns, in the table's order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keys])


def omit_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
