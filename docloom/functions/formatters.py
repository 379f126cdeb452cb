"""Display formats of dates, numbers, money, booleans and enums; en-US."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from .semantics import is_number, text_of

DASH = "—"
# Format tokens, longest first, and Spark's patterns for them.
DATE_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss", "A": "a", "a": "a"}
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹", "CNY": "CN¥", "KRW": "₩", "CAD": "CA$", "AUD": "A$", "NZD": "NZ$", "MXN": "MX$", "BRL": "R$", "ILS": "₪", "VND": "₫", "TWD": "NT$", "HKD": "HK$", "PHP": "₱"}
_PARSE = ["yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd MMM yyyy", "d MMM yyyy", "MMM d, yyyy"]


def date_pieces(pattern: str) -> list[tuple[str | None, str]]:
    """``(Spark pattern or None, text)`` of each piece of a format."""
    found = re.findall(r"YYYY|YY|MMMM|MMM|MM|\bM\b|DD|\bD\b|HH|hh|mm|ss|A|a|.", pattern, re.DOTALL)
    return [(DATE_TOKENS.get(x), x) for x in found]


def as_timestamp(col: Column, kind: T.DataType, milliseconds: bool = True) -> Column:
    """An instant from dates, epoch numbers or text in one of the known forms; null if none fits."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    if is_number(kind):
        return F.timestamp_millis(col.cast("long")) if milliseconds else F.timestamp_seconds(col)
    if isinstance(kind, T.StringType):
        return F.coalesce(*[F.try_to_timestamp(F.trim(col), F.lit(p)) for p in _PARSE])
    return F.lit(None).cast("timestamp")


def format_date(col: Column, kind: T.DataType, pattern: str = "DD MMM YYYY", fallback: str = DASH, milliseconds: bool = True) -> Column:
    """Tokens YYYY YY MMMM MMM MM M DD D HH hh mm ss A a; anything else stands for itself."""
    t = as_timestamp(col, kind, milliseconds)
    parts = []
    for spark, text in date_pieces(pattern):
        if spark is None:
            parts.append(F.lit(text))
        else:
            part = F.date_format(t, spark)
            parts.append(F.lower(part) if text == "a" else F.upper(part) if text == "A" else part)
    return F.coalesce(F.concat(*parts) if parts else F.lit(""), F.lit(fallback))


def _half_up(x: Column, digits: int) -> Column:
    """Grouped text of a number, rounded half away from zero on its decimal form."""
    return F.format_number(F.round(F.abs(x).cast("decimal(38,12)"), digits), digits)


def _number_of(col: Column, kind: T.DataType, clean: str) -> Column:
    if is_number(kind):
        x = col.cast("double")
    elif isinstance(kind, T.StringType):
        text = F.regexp_replace(col, clean, "") if clean else F.trim(col)
        x = text.try_cast("double") if clean else F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    else:
        x = F.lit(None).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def format_currency(col: Column, kind: T.DataType, currency: str = "USD", decimals: int = 2, fallback: str = DASH, show_symbol: bool = True) -> Column:
    """Symbol or code before the grouped number, the sign first; text is freed of all but digits and signs."""
    x = _number_of(col, kind, r"[^0-9.\-+eE]")
    code = currency.upper() if re.fullmatch(r"[A-Za-z]{3}", currency) else "USD"
    lead = SYMBOLS.get(code, code + " ") if show_symbol else code + " "
    return F.coalesce(F.concat(F.when(x < 0, "-").otherwise(""), F.lit(lead), _half_up(x, decimals)), F.lit(fallback))


def format_number(col: Column, kind: T.DataType, least: int = 0, most: int = 2, fallback: str = DASH) -> Column:
    """Grouped, with ``least`` to ``most`` fraction digits; blank text counts as 0."""
    x = _number_of(col, kind, "")
    text = _half_up(x, most)
    if most > least:
        text = F.regexp_replace(text, rf"(\.\d{{{least}}}\d*?)0+$", "$1")
        text = F.regexp_replace(text, r"\.$", "")
    return F.coalesce(F.concat(F.when((x < 0) & text.rlike("[1-9]"), "-").otherwise(F.when(x < 0, "-").otherwise("")), text), F.lit(fallback))


def format_boolean(col: Column, kind: T.DataType, true: str = "Yes", false: str = "No", null: str = DASH) -> Column:
    """true, yes, 1 and on; false, no, 0 and off; anything else is the null label."""
    s = F.lower(F.trim(text_of(col, kind)))
    return F.when(s.isin("true", "yes", "1", "on"), true).when(s.isin("false", "no", "0", "off"), false).otherwise(null)


def format_enum(col: Column, kind: T.DataType, names: dict[str, str], fallback: str | None = None, ignore_case: bool = False) -> Column:
    """The name's label; unknown names give the fallback or themselves, nulls the fallback or a dash."""
    s = text_of(col, kind)
    out = F.lit(fallback) if fallback is not None else s
    test = None
    for k, v in names.items():
        hit = F.lower(s) == k.lower() if ignore_case else s == k
        test = F.when(hit, v) if test is None else test.when(hit, v)
    out = out if test is None else test.otherwise(out)
    return F.when(s.isNull(), F.lit(fallback if fallback is not None else DASH)).otherwise(out)


def _bound(f: Callable) -> Callable:
    return lambda **options: lambda col, kind: f(col, kind, **options)


create_date_formatter, create_currency_formatter, create_number_formatter, create_boolean_formatter, create_enum_formatter = map(_bound, (format_date, format_currency, format_number, format_boolean, format_enum))
