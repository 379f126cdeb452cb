"""Masks and hashes of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .detect import EMAIL

_WORD = 4294967295
#: Fixed value: the start of each of the four 32-bit hashes.
_START = 5381


def _hash32(text: Column) -> Column:
    """A multiply-by-33 and xor hash over UTF-16 code units."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4 - 1).cast("int")), lambda i: F.conv(F.substring(raw, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(raw) > 0, units).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(_START).cast("long"), lambda a, u: (a * 33).bitwiseXOR(u).bitwiseAND(F.lit(_WORD)))


def quick_hash(text: Column) -> Column:
    """Four 32-bit hashes in hexadecimal; not cryptographic."""
    parts = [F.lpad(F.lower(F.hex(_hash32(F.concat(text, F.lit(s))))), 8, "0") for s in "abcd"]
    return F.concat(*parts)


def sha_prefix(text: Column) -> Column:
    """The first 40 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 40)


def partial_mask(text: Column, mark: str = "*") -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    n = F.length(text)
    return (
        F.when(text.rlike(EMAIL), F.concat(F.substring(text, 1, 1), F.lit(mark * 3 + "@"), F.element_at(F.split(text, "@"), 2)))
        .when(F.length(digits) >= 7, F.concat(F.lit(f"{mark * 3}-{mark * 3}-"), F.right(digits, F.lit(4))))
        .when(n <= 2, F.lit(mark * 4))
        .otherwise(F.concat(F.substring(text, 1, 1), F.repeat(F.lit(mark), F.least(n - 2, F.lit(6))), F.right(text, F.lit(1))))
    )


def apply_mask(text: Column, mode: str = "full", mark: str = "*", custom: Callable[[Column], Column] | None = None) -> Column:
    """full, partial, hash or custom; empty text, and null, give empty text."""
    full = F.repeat(F.lit(mark), F.least(F.length(text), F.lit(8)))
    if mode == "partial":
        out = partial_mask(text, mark)
    elif mode == "hash":
        out = quick_hash(text)
    elif mode == "custom":
        out = F.coalesce(custom(text).cast("string"), F.lit(mark * 8)) if custom else F.lit(mark * 8)
    else:
        out = full
    return F.when(text.isNull() | (text == ""), "").otherwise(out)
