"""Column helpers for JavaScript value semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Names that documents may not carry.
UNSAFE_KEYS = ("__proto__", "prototype", "constructor")
MAX_DEPTH = 20
DELIMITER = "."


def is_unsafe(key: str) -> bool:
    return key in UNSAFE_KEYS


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_object(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.MapType))


def is_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType)


def is_nested(kind: T.DataType) -> bool:
    return is_object(kind) or is_array(kind) or isinstance(kind, T.VariantType)


def finite(col: Column) -> Column:
    """The number as a double; null unless finite."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number_text(col: Column, kind: T.DataType) -> Column:
    """A number's text as JavaScript writes it: no trailing zeros, exponents from 1e21 and below 1e-6."""
    if isinstance(kind, T.IntegralType):
        return col.cast("string")
    x = col.cast("double")
    s = x.cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    whole = F.regexp_extract(s, r"(\d+)\.\d+E", 1)
    tail = F.regexp_replace(F.regexp_extract(s, r"\d+\.(\d+)E", 1), r"^0$", "")
    digits = F.concat(whole, tail)
    e = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    n = F.length(digits)
    big = F.when(n > e + 1, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n))).otherwise(F.rpad(digits, e + 1, F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    power = F.concat(whole, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), F.when(e >= 0, "+").otherwise(""), e.cast("string"))
    scaled = F.concat(sign, F.when((e >= 0) & (e < 21), big).when((e < 0) & (e >= -6), small).otherwise(power))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string"))
        .when(s.contains("E"), scaled)
        .otherwise(s)
    )


def text_of(col: Column, kind: T.DataType) -> Column:
    """A value's text: scalars as String() writes them, nested values as JSON; null stays null."""
    if isinstance(kind, T.StringType):
        return col
    if is_number(kind):
        return number_text(col, kind)
    if is_nested(kind):
        return F.to_json(col)
    return col.cast("string")


def json_of(col: Column, kind: T.DataType) -> Column:
    """A value's JSON text; null is ``null``."""
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        quoted = F.to_json(F.struct(col.cast("string").alias("v")))
        return F.when(col.isNull(), "null").otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))
    return F.coalesce(text_of(col, kind), F.lit("null"))


def canonical(col: Column, kind: T.DataType) -> Column:
    """The text by which group and distinct keys are told apart; 1 and "1" are one key."""
    return F.coalesce(text_of(col, kind), F.lit("null"))
