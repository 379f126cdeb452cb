"""The fluent query layer: immutable steps over a DataFrame.

Order is kept as pending sort keys over an ordinal: a business key the caller
names, or a number attached when a step first needs one. Nothing runs before a
terminal, and filters stay next to the scan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.paths import has_unsafe
from ..functions.semantics import canonical, finite, is_array, is_number
from .extract import resolve
from .search import search_any

ORD = "__ord"
# Operator names and their aliases.
OPERATORS = {"eq": "eq", "=": "eq", "==": "eq", "ne": "ne", "!=": "ne", "gt": "gt", ">": "gt", "gte": "gte", ">=": "gte", "lt": "lt", "<": "lt", "lte": "lte", "<=": "lte", "in": "in", "contains": "contains"}


def _same_type(kind: T.DataType, value: object) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_number(kind)
    if isinstance(value, str):
        return isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return False


def _strict(col: Column, kind: T.DataType, value: object) -> Column:
    """Strict equality; a type that can't be equal is settled at plan time."""
    if value is None:
        return col.isNull()
    if isinstance(kind, T.VariantType):
        to = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        kinds = {"boolean": ["BOOLEAN"], "double": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "string": ["STRING"]}[to]
        return F.coalesce(F.regexp_extract(F.schema_of_variant(col), r"^[A-Z]+", 0).isin(kinds) & F.try_variant_get(col, "$", to).eqNullSafe(F.lit(value).cast(to)), F.lit(False))
    return col.eqNullSafe(F.lit(value)) if _same_type(kind, value) else F.lit(False)


def compare(col: Column, kind: T.DataType, op: str, value: object) -> Column:
    """A two-valued predicate with JavaScript's rules for missing fields and mixed types."""
    if op not in OPERATORS:
        warnings.warn(f"unknown operator {op!r}, eq is used", stacklevel=2)
    op = OPERATORS.get(op, "eq")
    if op == "eq":
        return _strict(col, kind, value)
    if op == "ne":
        return ~_strict(col, kind, value)
    if op in ("gt", "gte", "lt", "lte"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        if isinstance(kind, T.VariantType):
            ok = F.regexp_extract(F.schema_of_variant(col), r"^[A-Z]+", 0).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
            col = F.when(ok, F.try_variant_get(col, "$", "double"))
        elif not is_number(kind):
            return F.lit(False)
        test = {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[op]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            test = test & ~F.isnan(col)  # Spark holds NaN above all numbers
        return col.isNotNull() & test  # false, not null, where it is missing; both parts reach the scan
    if op == "in":
        if not isinstance(value, (list, tuple, set)):
            return F.lit(False)
        fit = [v for v in value if v is not None and _same_type(kind, v)]
        test = F.coalesce(col.isin(fit), F.lit(False)) if fit else F.lit(False)
        return test | col.isNull() if any(v is None for v in value) else test
    if is_array(kind):
        inner = kind.elementType
        if value is None:
            return F.coalesce(F.exists(col, lambda x: x.isNull()), F.lit(False))
        return F.coalesce(F.array_contains(col, F.lit(value)), F.lit(False)) if _same_type(inner, value) else F.lit(False)
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return F.coalesce(F.contains(F.lower(col), F.lit(value.lower())), F.lit(False))
    return F.lit(False)


def path_predicate(df: DataFrame, path: str, op: str, value: object) -> Column:
    if has_unsafe(path):
        return F.lit(False)
    found = resolve(df, path)
    return compare(found.col, found.kind, op, value)


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


Selector = str | Callable[[DataFrame], Column]


class Query:
    """A table with pending order; every step gives a new one."""

    def __init__(self, df: DataFrame, key: list[str] | None = None, _sort: tuple[tuple[Column, bool], ...] = ()):
        self._df, self._key, self._sort = df, key, _sort

    # steps

    def where(self, test: str | Callable[[DataFrame], Column] | Column, op: str | None = None, value: object = None) -> Query:
        """A predicate of columns, or path, operator and value."""
        if isinstance(test, Column):
            cond = test
        elif callable(test):
            cond = F.coalesce(test(self._df), F.lit(False))
        else:
            cond = path_predicate(self._df, test, op or "eq", value)
        return Query(self._df.where(cond), self._key, self._sort)

    def where_indexed(self, test: Callable[[DataFrame, Column], Column]) -> Query:
        """A predicate that also gets the position within this step, from 0."""
        from pyspark.sql import Window

        q = self._ordered()
        at = F.row_number().over(Window.orderBy(*q._order())) - 1
        df = q._df.withColumn("__at", at)
        return Query(df.where(F.coalesce(test(df, F.col("__at")), F.lit(False))).drop("__at"), q._key, q._sort)

    def select(self, what: list[str] | Callable[[DataFrame], list[Column]]) -> Query:
        """Columns named by their literal paths, or columns of a function."""
        cols = what(self._df) if callable(what) else [resolve(self._df, p).col.alias(p) for p in what]
        if not self._sort and self._key is None and not self._hidden():
            return Query(self._df.select(*cols))
        q = self._ordered()
        held = [c.alias(f"__s{i}") for i, (c, _) in enumerate(q._sort)]
        own = [F.col(c).alias(f"__k{i}") for i, c in enumerate(q._ordinals())]
        return Query(q._df.select(*cols, *held, *own), [f"__k{i}" for i in range(len(own))], tuple((F.col(f"__s{i}"), d) for i, (_, d) in enumerate(q._sort)))

    def select_many(self, path: str | Callable[[DataFrame], Column]) -> Query:
        """One row for each item of an array; rows whose value is no array are dropped."""
        q = self._ordered()
        if callable(path):
            col = path(q._df)
        else:
            found = resolve(q._df, path)
            if not is_array(found.kind):
                return Query(q._df.where(F.lit(False)), q._key, q._sort)
            col = found.col
        held = [c.alias(f"__s{i}") for i, (c, _) in enumerate(q._sort)]
        own = [F.col(c).alias(f"__k{i}") for i, c in enumerate(q._ordinals())]
        df = q._df.select(*held, *own, F.posexplode(col).alias("__pos", "item"))
        inner = df.schema["item"].dataType
        fields = [F.col(f"item.`{f.name}`").alias(f.name) for f in inner.fields] if isinstance(inner, T.StructType) else [F.col("item")]
        order = [*(f"__k{i}" for i in range(len(own))), "__pos"]
        return Query(df.select(*fields, *(f"__s{i}" for i in range(len(held))), *order), order, tuple((F.col(f"__s{i}"), d) for i, (_, d) in enumerate(q._sort)))

    def order_by(self, by: Selector, descending: bool = False) -> Query:
        """Stable; nulls last either way; the latest call is the first key."""
        col = by(self._df) if callable(by) else resolve(self._df, by).col
        return Query(self._df, self._key, ((col, descending), *self._sort))

    def order_by_desc(self, by: Selector) -> Query:
        return self.order_by(by, True)

    def take(self, n: int) -> Query:
        if n < 0:
            raise ValueError("take needs a number of 0 or more")
        q = self._ordered()
        return Query(q._df.orderBy(*q._order()).limit(n), q._key, q._sort)

    def skip(self, n: int) -> Query:
        if n < 0:
            raise ValueError("skip needs a number of 0 or more")
        q = self._ordered()
        return Query(q._df.orderBy(*q._order()).offset(n), q._key, q._sort)

    def search(self, keywords: str | list[str], whole_word: bool = False, strings_only: bool = False, limit: int | None = None) -> Query:
        """Rows of which any leaf matches; a limit has no effect on a row test."""
        return Query(self._df.where(search_any(self._visible(), keywords, whole_word, strings_only)), self._key, self._sort)

    # terminals

    def to_df(self) -> DataFrame:
        """The rows, in order where an order was asked for."""
        out = self._df.orderBy(*self._order()) if self._sort or self._hidden() else self._df
        return out.drop(*self._hidden())

    def to_list(self) -> list:
        return self._ordered_df().collect()

    def first(self):
        return self._ordered_df().first()

    def last(self):
        q = self._ordered()
        flipped = [*(c.asc_nulls_first() if d else c.desc_nulls_first() for c, d in q._sort), *[F.col(c).desc() for c in q._ordinals()]]
        return q._df.orderBy(*flipped).drop(*q._hidden()).first()

    def count(self) -> int:
        return self._df.count()

    def any(self) -> bool:
        return not self._df.isEmpty()

    def all(self, test: Callable[[DataFrame], Column]) -> bool:
        """True of an empty table."""
        return self._df.where(~F.coalesce(test(self._df), F.lit(False))).isEmpty()

    def aggregates(self, *wanted: tuple[str, str]) -> DataFrame:
        """One row of ``(function, path)`` aggregates: sum, avg, min, max, count."""
        return self._df.agg(*[aggregate(self._df, f, p).alias(f"{f}_{p}".replace(".", "_")) for f, p in wanted])

    def sum(self, path: str) -> float:
        return self._df.agg(aggregate(self._df, "sum", path)).first()[0]

    def avg(self, path: str) -> float:
        return self._df.agg(aggregate(self._df, "avg", path)).first()[0]

    def min(self, path: str) -> float:
        return self._df.agg(aggregate(self._df, "min", path)).first()[0]

    def max(self, path: str) -> float:
        return self._df.agg(aggregate(self._df, "max", path)).first()[0]

    def group_by(self, path: str, wanted: list[tuple[str, str]] = (), items: bool = False) -> DataFrame:
        """``key, count`` in order of first appearance, with aggregates, and members where asked for.

        Members of a group come together in one row; leave ``items`` off for large groups.
        """
        q = self._ordered()
        found = resolve(q._df, path)
        order = F.struct(*[F.col(c) for c in q._ordinals()])
        aggs = [F.min_by(found.col, order).alias("key"), F.count("*").alias("count"), F.min(order).alias("__first")]
        aggs += [aggregate(q._df, f, p).alias(f"{f}_{p}".replace(".", "_")) for f, p in wanted]
        if items:
            member = F.struct(*[F.col(f"`{c}`") for c in q._df.columns if not c.startswith("__")])
            aggs.append(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), member.alias("m")))), lambda x: x["m"]).alias("items"))
        return q._df.groupBy(canonical(found.col, found.kind).alias("__key")).agg(*aggs).orderBy("__first").drop("__key", "__first")

    def distinct(self, path: str) -> DataFrame:
        """Distinct values in order of first appearance."""
        return self.group_by(path).select(F.col("key").alias("value"))

    # order

    def _hidden(self) -> list[str]:
        return [c for c in self._df.columns if c.startswith(("__s", "__k")) or c in (ORD, "__pos")]

    def _visible(self) -> DataFrame:
        return self._df.drop(*self._hidden())

    def _ordinals(self) -> list[str]:
        return list(self._key or [ORD])

    def _ordered(self) -> Query:
        if self._key is not None or ORD in self._df.columns:
            return self
        return Query(self._df.withColumn(ORD, F.monotonically_increasing_id()), None, self._sort)

    def _order(self) -> list[Column]:
        return [*(c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in self._sort), *[F.col(c) for c in self._ordinals()]]

    def _ordered_df(self) -> DataFrame:
        q = self._ordered()
        return q._df.orderBy(*q._order()).drop(*q._hidden())


def aggregate(df: DataFrame, name: str, path: str) -> Column:
    """An aggregate over finite numbers: bad values count as 0 in avg; empty sum 0, avg NaN, min and max the infinities."""
    found = resolve(df, path)
    x = finite(found.col) if is_number(found.kind) else F.lit(None).cast("double")
    total = F.coalesce(F.sum(x), F.lit(0.0))
    return {
        "sum": total,
        "avg": F.when(F.count("*") == 0, F.lit(float("nan"))).otherwise(total / F.count("*")),
        "min": F.coalesce(F.min(x), F.lit(float("inf"))),
        "max": F.coalesce(F.max(x), F.lit(float("-inf"))),
        "count": F.count("*"),
    }[name]


def from_(df: DataFrame, key: list[str] | str | None = None) -> Query:
    """A query over a table; ``key`` names columns that give its order."""
    if not isinstance(df, DataFrame):
        raise TypeError("from_ needs a DataFrame")
    return Query(df, [key] if isinstance(key, str) else key)
