"""Reshaping documents: unflatten, remap, merge, pivot and key cases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.labels import convert_key
from ..functions.paths import split_path
from ..functions.semantics import DELIMITER, MAX_DEPTH, canonical, is_array, is_object, is_unsafe
from ..plans.walker import DESCEND, Built, Node, as_node, build_struct, rewrite
from .extract import resolve


def normalize_keys(df: DataFrame, case: str = "camel", deep: bool = True, custom: dict[str, str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Keys in another case, at every depth; of names that fall together the last counts."""
    return rewrite(df, lambda n: DESCEND if deep else "keep", rename=lambda n: convert_key(n.key, case, custom), max_depth=max_depth)


@dataclass
class _Tree:
    """Paths of an unflattened document; ``within`` is null where the object itself is."""

    leaf: Column | None = None
    kind: T.DataType | None = None
    within: Column | None = None
    named: dict[str, _Tree] = field(default_factory=dict)
    placed: dict[int, _Tree] = field(default_factory=dict)


def parse_flat_key(key: str, delimiter: str = DELIMITER, arrays: bool = True) -> list[str | int]:
    """Brackets with digits are positions, brackets with anything else escaped keys, the rest keys."""
    out: list[str | int] = []
    now, i = "", 0
    while i < len(key):
        if key[i] == "[" and "]" in key[i:]:
            end = key.index("]", i)
            body = key[i + 1 : end]
            if now:
                out.append(now)
                now = ""
            out.append(int(body) if body.isdigit() and arrays else body)
            i = end + 1
        elif key.startswith(delimiter, i):
            if now:
                out.append(now)
                now = ""
            i += len(delimiter)
        else:
            now += key[i]
            i += 1
    return out + ([now] if now else [])


def unflatten(df: DataFrame, delimiter: str = DELIMITER, parse_arrays: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Nested columns from flat names; names too deep or unsafe are left out, the last of equal ones counts.

    A name that is both a value and an object is an error.
    """
    root = _Tree()
    for name in df.columns:
        parts = parse_flat_key(name, delimiter, parse_arrays)
        if not parts or len(parts) > max_depth or any(isinstance(p, str) and is_unsafe(p) for p in parts):
            continue
        at = root
        for p in parts:
            if at.leaf is not None:
                raise ValueError(f"{name!r} goes below a value")
            at = (at.placed if isinstance(p, int) else at.named).setdefault(p, _Tree())
        if at.named or at.placed:
            raise ValueError(f"{name!r} is both a value and an object")
        at.leaf = F.col(f"`{name}`")

    def build(t: _Tree) -> Column:
        if t.leaf is not None:
            return t.leaf
        if t.placed and not t.named:
            return F.array(*[build(t.placed[i]) if i in t.placed else F.lit(None) for i in range(max(t.placed) + 1)])
        return F.struct(*[build(c).alias(k) for k, c in t.named.items()], *[build(c).alias(str(k)) for k, c in t.placed.items()])

    return df.select(*[build(t).alias(k) for k, t in root.named.items()])


def compact_sparse(col: Column) -> Column:
    """An array from a map with numeric keys, null where one is missing."""
    numbers = F.transform(F.map_keys(col), lambda k: k.try_cast("int"))
    numeric = F.forall(numbers, lambda k: k.isNotNull())
    top = F.array_max(numbers)
    return F.when(numeric & (F.size(col) > 0), F.transform(F.sequence(F.lit(0), top), lambda i: F.try_element_at(col, i.cast("string"))))


def remap(df: DataFrame, mapping: dict[str, str], keep_unmapped: bool = False, default: object = None) -> DataFrame:
    """Values of source paths under target paths; what is missing takes the default or is skipped.

    ``keep_unmapped`` carries every field over that no source path names, by its
    path or by its name, at any depth; objects that lose all their fields go.
    """
    root = _Tree()
    for source, target in mapping.items():
        found = resolve(df, source)
        missing = isinstance(found.kind, T.NullType)
        if missing and default is None:
            continue
        at = root
        parts = split_path(target)
        if any(is_unsafe(p) for p in parts):
            continue
        for p in parts:
            at = at.named.setdefault(p, _Tree())
        at.leaf, at.kind = (F.lit(default), None) if missing else (found.col, found.kind)

    def carry(fields: list[Node], tree: _Tree, path: str) -> None:
        for f in fields:
            own = f"{path}.{f.key}" if path else f.key
            if own in mapping or f.key in mapping or is_unsafe(f.key):
                continue
            there = tree.named.get(f.key)
            if f.is_struct:
                below = there or _Tree(within=f.col)
                if below.leaf is not None:  # a mapped object gets what it lacks, another value makes way
                    inner = below.kind.fields if isinstance(below.kind, T.StructType) else []
                    below = _Tree(named={x.name: _Tree(below.leaf.getField(x.name), x.dataType) for x in inner})
                carry(f.children(), below, own)
                if below.named:
                    tree.named[f.key] = below
            elif there is None:
                tree.named[f.key] = _Tree(f.col, f.kind)

    def build(t: _Tree) -> Column:
        if t.leaf is not None:
            return t.leaf
        both = F.struct(*[build(c).alias(k) for k, c in t.named.items()])
        return both if t.within is None else F.when(t.within.isNotNull(), both)

    if keep_unmapped:
        carry([Node(F.col(f"`{f.name}`"), f.dataType, (f.name,)) for f in df.schema.fields], root, "")
    return df.select(*[build(t).alias(k) for k, t in root.named.items()])


def _merged(a: Node, b: Node, strategy: str, depth: int) -> Built:
    if a.is_struct and b.is_struct and depth <= MAX_DEPTH:
        left, right = {c.key: c for c in a.children()}, {c.key: c for c in b.children()}
        out = {}
        for k in [*left, *[k for k in right if k not in left]]:
            if k in left and k in right:
                out[k] = _merged(left[k], right[k], strategy, depth + 1)
            else:
                n = left.get(k) or right[k]
                out[k] = Built(n.col, n.kind)
        both = build_struct(None, out)
        return Built(F.when(b.col.isNull() & a.col.isNull(), None).otherwise(both.col), both.kind)
    if a.is_array and b.is_array and strategy != "replace":
        empty = F.array().cast(b.kind.simpleString())
        x, y = F.coalesce(a.col.cast(b.kind.simpleString()), empty), F.coalesce(b.col, empty)
        return Built(F.array_distinct(F.concat(x, y)) if strategy == "unique" else F.concat(x, y), b.kind)
    return Built(b.col, b.kind)


def merge_deep(*parts: Column | str, df: DataFrame, arrays: str = "replace") -> Column:
    """Objects merged from left to right; a field that the right has counts, even null. Arrays: replace, concat or unique."""
    nodes = []
    for p in parts:
        col = F.col(p) if isinstance(p, str) else p
        nodes.append(Node(col, df.select(col.alias("v")).schema["v"].dataType, ("v",)))
    out = Built(nodes[0].col, nodes[0].kind)
    for n in nodes[1:]:
        out = _merged(Node(out.col, out.kind, ("v",)), n, arrays, 1)
    return out.col


def deep_merge(a: Column | str, b: Column | str, df: DataFrame) -> Column:
    """The plain form: arrays are replaced."""
    return merge_deep(a, b, df=df)


def array_to_object(col: Column, kind: T.ArrayType, key: str) -> Column:
    """A map of an array's objects by a field, which leaves the values; null keys are skipped, the last of equal ones counts.

    That is what ``spark.sql.mapKeyDedupPolicy`` does as ``configure`` sets it.
    """
    inner: T.StructType = kind.elementType
    named = F.filter(col, lambda x: x.getField(key).isNotNull())
    rest = [f.name for f in inner.fields if f.name != key]
    text = lambda x: canonical(x.getField(key), inner[key].dataType)
    return F.map_from_entries(F.transform(named, lambda x: F.struct(text(x).alias("key"), F.struct(*[x.getField(n).alias(n) for n in rest]).alias("value"))))


def object_to_array(col: Column, kind: T.DataType, key_name: str = "key", value_name: str = "value") -> Column:
    """An array of a map's or object's entries; objects are spread beside their key, scalars stand under ``value_name``."""

    def entry(k: Column, v: Column, vk: T.DataType) -> Column:
        if isinstance(vk, T.StructType):
            return F.struct(k.alias(key_name), *[v.getField(f.name).alias(f.name) for f in vk.fields if f.name != key_name])
        return F.struct(k.alias(key_name), v.alias(value_name))

    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(col), lambda e: entry(e["key"], e["value"], kind.valueType))
    fields = [f for f in kind.fields if not is_unsafe(f.name)]
    return F.when(col.isNotNull(), F.array(*[entry(F.lit(f.name), col.getField(f.name), f.dataType) for f in fields]))


def pivot_structure(df: DataFrame, column: str, direction: str, **options) -> Column:
    """``arrayToObject`` or ``objectToArray``; another shape is an error."""
    kind = df.schema[column].dataType
    if direction == "arrayToObject":
        if not is_array(kind):
            raise TypeError("arrayToObject needs an array")
        return array_to_object(F.col(column), kind, options.get("key_field", "id"))
    if direction == "objectToArray":
        if not is_object(kind):
            raise TypeError("objectToArray needs an object")
        return object_to_array(F.col(column), kind, options.get("key_name", "key"), options.get("value_name", "value"))
    raise ValueError(f"unknown direction {direction!r}")


def deep_equal(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> Column:
    """Equality that minds neither the order of keys nor the width of numbers."""
    if isinstance(kind_a, T.StructType) and isinstance(kind_b, T.StructType):
        if set(kind_a.names) != set(kind_b.names):
            return a.isNull() & b.isNull()
        out = F.lit(True)
        for n in kind_a.names:
            out = out & deep_equal(a.getField(n), b.getField(n), kind_a[n].dataType, kind_b[n].dataType)
        return (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & out)
    if is_array(kind_a) and is_array(kind_b):
        same = F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: deep_equal(x["a"], x["b"], kind_a.elementType, kind_b.elementType))
        return F.coalesce((F.size(a) == F.size(b)) & same, a.isNull() & b.isNull())
    if isinstance(kind_a, T.NumericType) and isinstance(kind_b, T.NumericType):
        return a.eqNullSafe(b)
    return a.eqNullSafe(b) if type(kind_a) is type(kind_b) else a.isNull() & b.isNull()


def whole(df: DataFrame) -> Column:
    """The row as one object."""
    return as_node(df).col
