"""Filtering keys of documents by globs and by values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.paths import any_matches, globs
from ..functions.semantics import MAX_DEPTH, is_array, is_nested
from ..plans.walker import DESCEND, DROP, KEEP, Built, Node, rewrite, roots


def exclude_keys(df: DataFrame, patterns: list[str], case_insensitive: bool = False, deep: bool = True, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, list[str]]:
    """The table without keys whose path, or whose name alone, matches; and the removed paths.

    Array items are never removed. Removal is by schema: nothing is read.
    """
    compiled = globs(patterns, case_insensitive)
    removed: list[str] = []

    def visit(node: Node) -> str:
        if node.key is not None and any_matches(compiled, node.path, node.key):
            removed.append(".".join(s if s is not None else "*" for s in node.path))
            return DROP
        return DESCEND if deep else KEEP

    return rewrite(df, visit, max_depth=max_depth), removed


def include_keys(df: DataFrame, patterns: list[str], case_insensitive: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Only what matches, with all below it, and the way to it.

    A bare name is found at any depth of objects, not inside arrays. With a
    pattern that starts with ``**`` everything counts as on the way, so scalars stay.
    """
    compiled = globs(patterns, case_insensitive)
    bare, full = [g for g in compiled if g.bare and g.parts[0] not in ("*", "**")], compiled

    def has_bare(node: Node) -> bool:
        return any(any(g.matches((c.key,)) for g in bare) or has_bare(c) for c in node.children())

    def visit(node: Node) -> str | Built:
        if node.key is None:
            return DESCEND
        inside_array = None in node.path
        if any(g.matches(node.path) for g in full) or (not inside_array and any(g.matches((node.key,)) for g in bare)):
            return KEEP
        if any(g.leads_to(node.path) for g in full if not g.bare or g.parts[0] in ("*", "**")):
            return DESCEND
        if node.is_struct and not inside_array and has_bare(node):
            return DESCEND
        return DROP

    return rewrite(df, visit, max_depth=max_depth)


Predicate = Callable[[Column, T.DataType, str | None, tuple], Column | bool | None]


def hide_if(df: DataFrame, test: Predicate, remove_empty_parents: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Values for which ``test(column, type, key, path)`` holds become null, and leave JSON text and arrays.

    The test comes before descent; parents that lose all they had go too.
    """

    def said(node: Node) -> Column | None:
        out = test(node.col, node.kind, node.key, node.path)
        return None if out is None or out is False else F.coalesce(F.lit(out) if out is True else out, F.lit(False))

    def visit(node: Node) -> str:
        return DESCEND

    def after(node: Node, b: Built) -> Built:
        col, kind = b.col, b.kind
        if is_array(kind):
            if not is_nested(kind.elementType):
                def item(x: Column) -> Column:
                    hit = said(node.element(x))
                    return x if hit is None else F.when(~hit, x)

                col = F.transform(col, item)
            kept = F.filter(col, lambda x: x.isNotNull())
            col = F.when(F.size(kept) > 0, kept).when(F.size(node.col) == 0, kept) if remove_empty_parents else kept
        elif isinstance(kind, T.StructType) and remove_empty_parents and kind.fields:
            some = F.lit(False)
            for f in kind.fields:
                some = some | col.getField(f.name).isNotNull()
            col = F.when(some, col)
        hit = said(node)
        return Built(col if hit is None else F.when(~hit, col), kind)

    return rewrite(df, visit, max_depth=max_depth, after=after)


def removed_paths(df: DataFrame, test: Predicate) -> Column:
    """Paths of fields outside arrays for which the test holds: ``array<string>``."""
    found: list[Column] = []

    def walk(node: Node) -> None:
        out = test(node.col, node.kind, node.key, node.path)
        if out is not None and out is not False:
            found.append(F.when(F.coalesce(F.lit(out) if out is True else out, F.lit(False)), F.lit(".".join(node.path))))
        for c in node.children():
            walk(c)

    for r in roots(df):
        walk(r)
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def is_null(col: Column, kind: T.DataType, key=None, path=()) -> Column:
    return col.isNull()


is_nullish = is_null


def is_empty_string(col: Column, kind: T.DataType, key=None, path=()) -> Column | None:
    return col == "" if isinstance(kind, T.StringType) else None


def is_empty_array(col: Column, kind: T.DataType, key=None, path=()) -> Column | None:
    return F.size(col) == 0 if is_array(kind) else None


def is_empty_object(col: Column, kind: T.DataType, key=None, path=()) -> Column | None:
    if isinstance(kind, T.MapType):
        return F.size(col) == 0
    if isinstance(kind, T.StructType):
        out = col.isNotNull()
        for f in kind.fields:
            out = out & col.getField(f.name).isNull()
        return out
    return None


def is_falsy(col: Column, kind: T.DataType, key=None, path=()) -> Column:
    if isinstance(kind, T.StringType):
        return col.isNull() | (col == "")
    if isinstance(kind, T.BooleanType):
        return col.isNull() | ~col
    if isinstance(kind, T.NumericType):
        return col.isNull() | (col == 0) | F.isnan(col.cast("double"))
    return col.isNull()


