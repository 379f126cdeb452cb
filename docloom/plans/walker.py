"""Rewriting documents by walking their schema: one Catalyst expression, no job.

A table's columns are the fields of a root object. The walk meets every node
once, with its column, type and path; array positions are ``None`` in paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.semantics import MAX_DEPTH, is_array, is_unsafe


@dataclass(frozen=True)
class Node:
    """A place in a document."""

    col: Column
    kind: T.DataType
    path: tuple[str | None, ...]

    @property
    def key(self) -> str | None:
        return self.path[-1] if self.path else None

    @property
    def depth(self) -> int:
        return len(self.path)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.kind, T.StructType)

    @property
    def is_array(self) -> bool:
        return is_array(self.kind)

    def children(self) -> list[Node]:
        """Fields of an object, unsafe names left out; of duplicate names the last."""
        if not self.is_struct:
            return []
        last = {f.name: f for f in self.kind.fields if not is_unsafe(f.name)}
        return [Node(self.col.getField(f.name), f.dataType, (*self.path, f.name)) for f in last.values()]

    def element(self, col: Column) -> Node:
        return Node(col, self.kind.elementType, (*self.path, None))


def roots(df: DataFrame) -> list[Node]:
    """The table's columns as nodes."""
    return [Node(F.col(f"`{f.name}`"), f.dataType, (f.name,)) for f in df.schema.fields if not is_unsafe(f.name)]


@dataclass(frozen=True)
class Built:
    """A rewritten node: its column and type."""

    col: Column
    kind: T.DataType


#: What a visitor may say of a node.
KEEP, DESCEND, DROP = "keep", "descend", "drop"
Visit = Callable[[Node], "str | Built"]
Rename = Callable[[Node], str]


def rebuild(node: Node, visit: Visit, rename: Rename | None = None, max_depth: int = MAX_DEPTH, after: Callable[[Node, Built], Built] | None = None) -> Built | None:
    """The node rewritten; None if it is dropped. Below ``max_depth`` all stays as it is."""
    said = visit(node)
    if said == DROP:
        return None
    if isinstance(said, Built):
        return said
    out = Built(node.col, node.kind)
    if said == DESCEND and node.depth <= max_depth:
        if node.is_struct:
            out = build_struct(node.col, _fields(node.children(), visit, rename, max_depth, after))
        elif node.is_array and isinstance(node.kind.elementType, (T.StructType, T.ArrayType)):
            made: list[Built | None] = []

            def each(x: Column) -> Column:
                made.append(rebuild(node.element(x), visit, rename, max_depth, after))
                return made[-1].col if made[-1] else x

            col = F.transform(node.col, each)
            if made[-1] is not None:
                out = Built(col, T.ArrayType(made[-1].kind))
    return after(node, out) if after else out


def _fields(nodes: list[Node], visit: Visit, rename: Rename | None, max_depth: int, after) -> dict[str, Built]:
    out: dict[str, Built] = {}
    for n in nodes:
        b = rebuild(n, visit, rename, max_depth, after)
        if b is not None:
            out[rename(n) if rename else n.key] = b  # the last of equal names wins, at the first's place
    return out


def build_struct(guard: Column | None, fields: dict[str, Built]) -> Built:
    """An object of the fields; null where ``guard`` is."""
    kind = T.StructType([T.StructField(k, b.kind) for k, b in fields.items()])
    made = F.struct(*[b.col.alias(k) for k, b in fields.items()]) if fields else F.struct()
    return Built(made if guard is None else F.when(guard.isNotNull(), made), kind)


def rewrite(df: DataFrame, visit: Visit, rename: Rename | None = None, max_depth: int = MAX_DEPTH, after=None) -> DataFrame:
    """The table with every document rewritten."""
    fields = _fields(roots(df), visit, rename, max_depth, after)
    return df.select(*[b.col.alias(k) for k, b in fields.items()])


def as_node(df: DataFrame) -> Node:
    """The whole row as one object."""
    return Node(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, ())
