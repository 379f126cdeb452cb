"""Defaults, value transforms and computed fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import formatters as fmt
from ..functions.detect import ISO_DATE
from ..functions.paths import Glob, glob, split_path
from ..functions.semantics import MAX_DEPTH, is_unsafe
from ..plans.walker import DESCEND, Built, Node, rewrite

Transform = dict | Callable[[Column, T.DataType], Column]


def _literal(value: object) -> Built:
    col = F.lit(value)
    kind = T.StringType() if isinstance(value, str) else T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else None
    if kind is None:
        raise TypeError(f"no column stands for {value!r}")
    return Built(col.cast(kind), kind)


def apply_defaults(df: DataFrame, defaults: dict[str, object], max_depth: int = MAX_DEPTH) -> DataFrame:
    """Fill nulls and inject what is missing.

    A bare key fills nulls at any depth and, where the root lacks it, becomes a
    column; a dotted path fills its field and is injected where its parent is there.
    """
    compiled: list[tuple[Glob, object]] = [(glob(p), v) for p, v in defaults.items()]

    def visit(node: Node) -> str | Built:
        for g, v in compiled:
            if node.key is not None and (g.matches(node.path) or (g.bare and g.matches((node.key,)))) and not node.is_struct and not node.is_array:
                given = _literal(v)
                return Built(F.coalesce(node.col, given.col.cast(node.kind)), node.kind)
        return DESCEND

    out = rewrite(df, visit, max_depth=max_depth)
    for p, v in defaults.items():
        parts = split_path(p)
        if any(x in ("*", "**") or is_unsafe(x) for x in parts):
            continue
        if len(parts) == 1 and parts[0] not in out.columns:
            out = out.withColumn(parts[0], _literal(v).col)
        elif len(parts) > 1 and parts[0] in out.columns:
            kind = out.schema[parts[0]].dataType
            for x in parts[1:-1]:
                kind = kind[x].dataType if isinstance(kind, T.StructType) and x in kind.names else None
            if isinstance(kind, T.StructType) and parts[-1] not in kind.names:
                out = out.withColumn(parts[0], F.col(f"`{parts[0]}`").withField(".".join(f"`{x}`" for x in parts[1:]), _literal(v).col))
    return out


def transform_column(spec: Transform, col: Column, kind: T.DataType) -> Built:
    """One value by a kind of transform: date, currency, number, boolean, enum, default, auto, or a function."""
    if callable(spec):
        out = spec(col, kind)
        return Built(out, T.NullType())
    options = {k: v for k, v in spec.items() if k != "type"}
    name = spec["type"]
    if name == "function":
        return Built(options["fn"](col, kind), T.NullType())
    if name == "default":
        return Built(F.coalesce(col, F.lit(options["value"]).cast(kind)), kind)
    if name == "auto":
        return auto_format(col, kind)
    made = {"date": fmt.format_date, "currency": fmt.format_currency, "number": fmt.format_number, "boolean": fmt.format_boolean, "enum": fmt.format_enum}[name]
    if name == "number":
        options.pop("fallback", None)  # has no effect here
    return Built(made(col, kind, **options), T.StringType())


def auto_format(col: Column, kind: T.DataType) -> Built:
    """Dates and booleans by their kind; others stay."""
    if isinstance(kind, T.BooleanType):
        return Built(fmt.format_boolean(col, kind), T.StringType())
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Built(fmt.format_date(col, kind), T.StringType())
    if isinstance(kind, T.StringType):
        return Built(F.when(col.rlike(ISO_DATE), fmt.format_date(col, kind)).otherwise(col), kind)
    return Built(col, kind)


def transform_values(df: DataFrame, transforms: dict[str, Transform] | None = None, computed: dict[str, Callable[[DataFrame], Column]] | None = None, defaults: dict[str, object] | None = None, auto: bool = False, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, list[str]]:
    """Defaults, then transforms, then computed fields; and the transformed paths.

    A bare key counts before an exact path, that before the first glob that
    matches. What is transformed is not descended into.
    """
    if defaults:
        df = apply_defaults(df, defaults, max_depth)
    table = transforms or {}
    compiled = {p: glob(p) for p in table}
    done: list[str] = []

    def pick(node: Node) -> Transform | None:
        if node.key in table:
            return table[node.key]
        exact = ".".join(s if s is not None else "*" for s in node.path)
        if exact in table:
            return table[exact]
        return next((table[p] for p, g in compiled.items() if g.matches(node.path)), None)

    def visit(node: Node) -> str | Built:
        spec = pick(node) if node.key is not None else None
        if spec is not None:
            done.append(".".join(s if s is not None else "*" for s in node.path))
            return transform_column(spec, node.col, node.kind)
        if auto and node.key is not None and not node.is_struct and not node.is_array:
            return auto_format(node.col, node.kind)
        return DESCEND

    out = rewrite(df, visit, max_depth=max_depth)
    return (inject_computed(out, computed) if computed else out), done


def inject_computed(df: DataFrame, fields: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """New fields, all computed from the table as it came; a path names a nested one."""
    made = {p: f(df) for p, f in fields.items()}
    flat, nested = {}, {}
    for p, c in made.items():
        parts = split_path(p)
        if any(is_unsafe(x) for x in parts):
            continue
        if len(parts) == 1:
            flat[parts[0]] = c
        else:
            nested.setdefault(parts[0], []).append((parts[1:], c))
    for root, added in nested.items():
        base = F.col(f"`{root}`") if root in df.columns and isinstance(df.schema[root].dataType, T.StructType) else None
        for parts, c in added:
            name = ".".join(f"`{x}`" for x in parts)
            if base is None:
                base = c
                for x in reversed(parts):
                    base = F.struct(base.alias(x))
            else:
                base = base.withField(name, c)
        flat[root] = base
    return df.withColumns(flat) if flat else df
