"""JSON Schema of a table of documents, by one aggregate over all rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.semantics import MAX_DEPTH, is_array, is_unsafe

# Draft addresses and string formats.
DRAFTS = {"draft-07": "http://json-schema.org/draft-07/schema#", "draft-2019-09": "https://json-schema.org/draft/2019-09/schema", "draft-2020-12": "https://json-schema.org/draft/2020-12/schema"}
FORMATS = [
    ("date-time", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("time", r"^\d{2}:\d{2}(:\d{2})?$"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"),
    ("uri", r"^https?://"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"),
]


def _getter(name: str):
    return lambda x: x.getField(name)


class _Place:
    """A place in the documents: all its values of a row as one array, and their types."""

    def __init__(self, name: str, values: Column, kind: T.DataType, depth: int, most: int = MAX_DEPTH, merge: bool = True):
        self.name, self.values, self.kind, self.depth = name, values, kind, depth
        self.fields: dict[str, _Place] = {}
        self.items: _Place | None = None
        kept = F.filter(values, lambda x: x.isNotNull())
        if depth > most:
            return
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                if not is_unsafe(f.name):
                    self.fields[f.name] = _Place(f"{name}.{f.name}", F.transform(kept, _getter(f.name)), f.dataType, depth + 1, most, merge)
        elif is_array(kind):
            self.items = _Place(f"{name}[]", F.flatten(kept if merge else F.transform(kept, lambda x: F.slice(x, 1, 1))), kind.elementType, depth + 1, most, merge)

    def tests(self) -> list[tuple[str, Column]]:
        """Each type the place can show, and how many of a row's values show it."""
        count = lambda p: F.size(F.filter(self.values, p))
        out = [("null", count(lambda x: x.isNull()))]
        k = self.kind
        if isinstance(k, T.NullType):
            return out
        if isinstance(k, (T.DoubleType, T.FloatType, T.DecimalType)):
            return [*out, ("integer", count(lambda x: x == F.floor(x))), ("number", count(lambda x: x != F.floor(x)))]
        name = "integer" if isinstance(k, T.IntegralType) else "boolean" if isinstance(k, T.BooleanType) else "array" if is_array(k) else "object" if isinstance(k, (T.StructType, T.MapType)) else "string"
        return [*out, (name, count(lambda x: x.isNotNull()))]

    def all(self) -> list[_Place]:
        below = [p for c in self.fields.values() for p in c.all()] + (self.items.all() if self.items else [])
        return [self, *below]


def json_schema(df: DataFrame, draft: str = "draft-07", required: bool = False, title: str | None = None, description: str | None = None, strict: bool = False, examples: bool = False, merge_array_items: bool = True, max_depth: int = MAX_DEPTH, infer_formats: bool = True) -> dict:
    """A schema that all rows meet, merged as if document by document.

    Types that differ at a place become a list in order of appearance, and what
    is below it goes. With ``required``, a key is listed if no object lacks it or has it null.
    Formats, examples and closed objects are only told where one value was seen.
    Without ``merge_array_items`` an array's first item stands for all; below
    ``max_depth`` nothing is told.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    root = _Place("$", F.array(row), df.schema, 0, max_depth, merge_array_items)
    places = root.all()
    seen = df.select(F.monotonically_increasing_id().alias("__at"), *[F.struct(*[c.alias(t) for t, c in p.tests()], F.get(F.filter(p.values, lambda x: x.isNotNull()), F.lit(0)).alias("__one")).alias(f"p{i}") for i, p in enumerate(places)])
    aggs = []
    for i, p in enumerate(places):
        for t, _ in p.tests():
            aggs += [F.sum(f"p{i}.{t}").alias(f"n{i}_{t}"), F.min(F.when(F.col(f"p{i}.{t}") > 0, F.col("__at"))).alias(f"f{i}_{t}")]
        if isinstance(p.kind, T.StringType) or examples and not isinstance(p.kind, (T.StructType, T.ArrayType, T.MapType, T.NullType)):
            aggs.append(F.any_value(f"p{i}.__one", True).alias(f"one{i}"))
    got = seen.agg(*aggs).first().asDict()
    at = {id(p): i for i, p in enumerate(places)}

    def types(p: _Place) -> list[str]:
        i = at[id(p)]
        return [t for _, _, t in sorted((got[f"f{i}_{t}"], t == "null", t) for t, _ in p.tests() if got[f"n{i}_{t}"])]

    def build(p: _Place) -> dict:
        if p.depth > max_depth:
            return {}
        found, i = types(p), at[id(p)]
        count = sum(got[f"n{i}_{t}"] or 0 for t, _ in p.tests())
        if not found:
            return {}
        if len(found) > 1:
            return {"type": found}
        t = found[0]
        out: dict = {"type": t}
        if t == "object":
            out["properties"] = {k: build(c) for k, c in p.fields.items()}
            need = [k for k, c in p.fields.items() if required and not got[f"n{at[id(c)]}_null"]]
            if need:
                out["required"] = need
            if strict and count == 1:
                out["additionalProperties"] = False
        elif t == "array":
            out["items"] = build(p.items) if p.items else {}
        elif count == 1:
            one = got.get(f"one{i}")
            if t == "string" and infer_formats and isinstance(one, str):
                import re

                name = next((n for n, r in FORMATS if re.search(r, one)), None)
                if name:
                    out["format"] = name
            if examples and one is not None and not (isinstance(one, str) and len(one) > 100):
                out["examples"] = [one]
        return out

    body = build(root)
    head = {"$schema": DRAFTS[draft]}
    if title:
        body["title"] = title
    if description:
        body["description"] = description
    return {**head, **body}


def json_schema_from_samples(df: DataFrame, required: bool = False, **options) -> dict:
    """The schema of sample documents, one a row; of none that of an empty object."""
    out = json_schema(df, required=required, **options)
    return out if "type" in out else {**out, "type": "object", "properties": {}}


def json_schema_text(df: DataFrame, **options) -> str:
    return json.dumps(json_schema(df, **options), default=str)


def type_counts(df: DataFrame) -> DataFrame:
    """``path, type, n`` of every place of the documents, as rows."""
    root = _Place("$", F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])), df.schema, 0)
    pairs = [F.struct(F.lit(p.name).alias("path"), F.lit(t).alias("type"), c.cast("long").alias("n")) for p in root.all() for t, c in p.tests()]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).groupBy("x.path", "x.type").agg(F.sum("x.n").alias("n"))
    return rows.where("n > 0")
