"""Reading JSON text that may be wrapped in itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.semantics import UNSAFE_KEYS
from ..plans.walker import DESCEND, KEEP, Built, Node, rewrite

#: Settings under which documents read as JSON.parse reads them.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
_GATE = r"(?s)^(?:\{.*\}|\[.*\]|\".+\"|\"\"|true|false|null|\d.+)$"


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def looks_like_json(text: Column) -> Column:
    """Objects, arrays, quoted text, the three words, and what starts with a digit; two characters at least."""
    return (F.length(text) >= 2) & text.rlike(_GATE)


def unwrapped_text(text: Column, rounds: int = 10) -> Column:
    """The innermost JSON text: quotes are taken off as long as what is inside looks like JSON."""

    def off(held: Column, _: Column) -> Column:
        t = F.trim(held)
        inner = F.try_variant_get(F.try_parse_json(t), "$", "string")
        more = looks_like_json(t) & t.startswith('"') & inner.isNotNull() & looks_like_json(F.trim(inner))
        return F.when(more, inner).otherwise(held)

    return F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), text, off) if rounds > 1 else text


def safe_parse(text: Column, rounds: int = 10, throw_on_pollution: bool = False) -> Column:
    """The text's value as VARIANT; never fails on bad JSON, which stays a string.

    Unsafe keys can be made an error; a reader of a declared schema drops them anyway.
    """
    inner = unwrapped_text(text, rounds)
    t = F.trim(inner)
    parsed = F.when(looks_like_json(t), F.try_parse_json(t))
    if throw_on_pollution:
        bad = F.lit(False)
        for k in UNSAFE_KEYS:
            bad = bad | F.coalesce(F.array_contains(F.json_object_keys(t), k), F.lit(False))
        parsed = F.when(bad & looks_like_json(t), F.raise_error(F.lit("unsafe key in document")).cast("variant")).otherwise(parsed)
    return F.coalesce(parsed, F.try_parse_json(F.substring(F.to_json(F.array(inner)), F.lit(2), F.length(F.to_json(F.array(inner))) - 2)))


def safe_parse_typed(text: Column, schema: T.DataType | str, rounds: int = 10) -> Column:
    """The text's value in a declared schema; null where it doesn't fit. Duplicate keys: the last counts."""
    return F.from_json(F.trim(unwrapped_text(text, rounds)), schema)


def deep_safe_parse(df: DataFrame, payloads: dict[str, T.DataType | str] | None = None) -> DataFrame:
    """Every string of the documents parsed.

    ``payloads`` names the schema of string fields, by path; other strings that
    hold one number or boolean only are left as they are, as a column has one type.
    """
    given = payloads or {}

    def visit(node: Node) -> str | Built:
        path = ".".join(s if s is not None else "*" for s in node.path)
        if isinstance(node.kind, T.StringType):
            if path in given:
                want = given[path] if isinstance(given[path], T.DataType) else T.StructType.fromDDL(given[path])
                return Built(safe_parse_typed(node.col, want), want)
            return KEEP
        return DESCEND

    return rewrite(df, visit)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines in a declared schema; nothing is read to find one."""
    return configure(spark).read.schema(schema).json(path)
