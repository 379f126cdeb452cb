"""Readable names and sectioned views of documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.labels import display_label
from ..functions.semantics import MAX_DEPTH, is_array, text_of
from ..plans.nodes import kind_name
from ..plans.walker import DESCEND, KEEP, Node, rewrite, roots
from .documents import flatten

FIELD = "struct<section:string,title:string,section_ord:array<int>,field_ord:int,label:string,value:string,path:string,key:string,type:string>"


def _label(key: str, labels: dict[str, str], options: dict) -> str:
    low = {k.lower(): v for k, v in labels.items()}
    return labels.get(key, low.get(key.lower())) or display_label(key, **options)


def humanize(df: DataFrame, deep: bool = True, flat: bool = False, labels: dict[str, str] | None = None, **options) -> DataFrame:
    """Keys renamed as people read them; of names that fall together the last counts.

    ``flat`` flattens first and joins the labels of a path by blanks.
    """
    own = labels or {}
    if flat:
        table = flatten(df).df
        names = {c: own.get(c) or " ".join(_label(s, own, options) for s in c.split(".")) for c in table.columns}
        last = {v: k for k, v in names.items()}
        return table.select(*[F.col(f"`{last[v]}`").alias(v) for v in dict.fromkeys(names.values())])
    return rewrite(df, lambda n: DESCEND if deep else KEEP, rename=lambda n: _label(n.key, own, options))


@dataclass(frozen=True)
class Sections:
    """How documents become sections of fields."""

    titles: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)
    include_nulls: bool = False
    root_title: str = "General"
    max_depth: int = MAX_DEPTH

    def _takes(self, key: str) -> bool:
        return key not in self.exclude and (not self.include or key in self.include)

    def _title(self, key: str) -> str:
        return self.titles.get(key) or _label(key, self.labels, {})

    def fields(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """One row a field: ``keep..., section, title, section_ord, field_ord, label, value, path, key, type``.

        Objects are sections, scalars their fields; nested arrays of objects are
        sections of items, top-level arrays and arrays of scalars single fields.
        Nulls are left out below the top level.
        """
        made: list[Column] = []

        def leaf(node: Node, at: Column, title: str, order: Column, n: int, path: Column, top: bool) -> Column:
            if is_array(node.kind) or isinstance(node.kind, T.StructType):
                value = F.to_json(node.col)
            else:
                value = text_of(node.col, node.kind)
            kind = F.when(node.col.isNull(), "null").otherwise("array" if is_array(node.kind) else "object" if kind_name(node.kind) == "object" else "primitive")
            one = F.struct(at.alias("section"), F.lit(title).alias("title"), order.alias("section_ord"), F.lit(n).alias("field_ord"), F.lit(_label(node.key, self.labels, {})).alias("label"), value.alias("value"), path.alias("path"), F.lit(node.key).alias("key"), kind.alias("type"))
            return one if top or self.include_nulls else F.when(node.col.isNotNull(), one)

        def walk(node: Node, title: str, order: Column, path: Column) -> Column:
            parts = []
            singles = [F.lit(None).cast(FIELD)]
            nested = 0
            for n, c in enumerate(node.children()):
                if not self._takes(c.key):
                    continue
                at = F.concat(path, F.lit("." + c.key))
                if c.is_struct and c.depth <= self.max_depth:
                    parts.append(walk(c, self._title(c.key), F.concat(order, F.array(F.lit(nested))), at))
                    nested += 1
                elif c.is_array and isinstance(c.kind.elementType, T.StructType):
                    name = self._title(c.key)
                    rank = nested
                    held = F.coalesce(c.col, F.array().cast(c.kind.simpleString()))
                    parts.append(F.flatten(F.transform(held, items(c, name, F.concat(order, F.array(F.lit(rank))), at))))
                    nested += 1
                else:
                    singles.append(leaf(c, path, title, order, n, at, False))
            own = F.array_compact(F.array(*singles))
            return F.when(node.col.isNotNull(), F.concat(own, *parts)).otherwise(F.array().cast(f"array<{FIELD}>"))

        def items(c: Node, name: str, order: Column, at: Column):
            return lambda x, i: walk(c.element(x), name, F.concat(order, F.array(i)), F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))

        tops = []
        nested = 0
        for n, r in enumerate(roots(df)):
            if r.key in keep or not self._takes(r.key):
                continue
            if r.is_struct:
                nested += 1
                made.append(walk(r, self._title(r.key), F.array(F.lit(nested)), F.lit(r.key)))
            else:
                tops.append(leaf(r, F.lit(""), self.root_title, F.array(F.lit(0)), n, F.lit(r.key), True))
        rows = F.concat(F.array(*tops) if tops else F.array().cast(f"array<{FIELD}>"), *made)
        out = df.select(*keep, F.explode(rows).alias("f"))
        return out.select(*keep, *[F.col(f"f.{c}").alias(c) for c in ("section", "title", "section_ord", "field_ord", "label", "value", "path", "key", "type")])


def flatten_sections(fields: DataFrame, keep: list[str]) -> DataFrame:
    """Fields in pre-order, own ones before those of sections below."""
    return fields.orderBy(*keep, "section_ord", "field_ord")


def merge_sections(*tables: DataFrame) -> DataFrame:
    """Sections of one title as one: ``title, section, fields``; the first section's path is kept."""
    both = None
    for i, t in enumerate(tables):
        part = t.withColumn("__t", F.lit(i))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    order = F.struct("__t", "section_ord", "field_ord", "section")
    item = F.struct("label", "value", "path", "key", "type")
    return both.groupBy("title").agg(F.min_by("section", order).alias("section"), F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("f")))), lambda x: x["f"]).alias("fields"))
