"""Kinds of values and sensitive data, as CASE expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .semantics import is_array, is_number, is_object

# Patterns of value kinds.
ISO_DATE = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
HUMAN_DATE = r"(?i)^(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
PHONE = r"^(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{1,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}(?:[-.\s]?\d{1,9})?$"
NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^0[xX][0-9a-fA-F]+$|^[+-]?Infinity$"

# Patterns of sensitive values.
PII_PHONE = r"^\+?[\d\s\-().]{7,20}$"
CREDIT_CARD = r"^(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})$"
SSN = r"^\d{3}-?\d{2}-?\d{4}$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
JWT = r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"
TOKEN = r"^[A-Za-z0-9_\-/+]{20,}={0,2}$"

# Key names without separators, by category, with their confidence.
KEY_NAMES = [
    ("email", 0.95, ["email", "emailaddress", "useremail", "contactemail", "primaryemail"]),
    ("phone", 0.95, ["phone", "phonenumber", "mobile", "mobilenumber", "cell", "cellphone", "telephone", "tel", "fax"]),
    ("password", 0.97, ["password", "passwd", "pass", "secret", "credential", "credentials", "passphrase", "pin", "hash", "encrypted"]),
    ("token", 0.95, ["token", "apikey", "accesstoken", "refreshtoken", "authtoken", "bearertoken", "bearer", "jwt", "sessiontoken", "privatekey", "secretkey", "clientsecret"]),
    ("ssn", 0.95, ["ssn", "socialsecuritynumber", "nationalid", "taxid", "ein"]),
    ("creditCard", 0.95, ["creditcard", "cardnumber", "ccnumber", "cc", "pan", "cvv", "cvc", "expiry"]),
    ("ipAddress", 0.90, ["ip", "ipaddress", "remoteip", "clientip"]),
]
KEY_PARTS = [("email", 0.80, ["email"]), ("phone", 0.80, ["phone", "mobile"]), ("password", 0.85, ["password", "secret"]), ("token", 0.85, ["token", "apikey"])]


def _digits(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"\D", ""))


def detect_type(col: Column, kind: T.DataType) -> Column:
    """``struct<type, confidence, normalised>`` of a value."""

    def said(name: str, confidence: float, normalised: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"), (F.lit(None).cast("string") if normalised is None else normalised).alias("normalised"))

    null = said("null", 1.0)
    if isinstance(kind, T.NullType):
        return null
    for test, name in ((isinstance(kind, T.BooleanType), "boolean"), (is_number(kind), "number"), (is_array(kind), "array"), (is_object(kind), "object")):
        if test:
            return F.when(col.isNull(), null).otherwise(said(name, 1.0))
    s = F.trim(col.cast("string"))
    return (
        F.when(col.isNull(), null)
        .when(s == "", said("string", 1.0))
        .when(s.rlike(ISO_DATE), said("date", 0.95, s))
        .when(s.rlike(HUMAN_DATE), said("date", 0.75, s))
        .when(s.rlike(EMAIL), said("email", 0.9))
        .when(s.rlike(URL), said("url", 0.95))
        .when(s.rlike(NUMERIC), said("number", 0.8))
        .when(s.rlike(PHONE) & (_digits(s) >= 7), said("phone", 0.65))
        .otherwise(said("string", 1.0))
    )


def is_date_like(col: Column, kind: T.DataType, least: float = 0.7) -> Column:
    """Dates, and any positive number as a time stamp."""
    if is_number(kind):
        return F.coalesce(col > 0, F.lit(False))
    found = detect_type(col, kind)
    return (found["type"] == "date") & (found["confidence"] >= least)


def is_numeric_like(col: Column, kind: T.DataType) -> Column:
    if is_number(kind):
        return col.isNotNull() & ~F.isnan(col.cast("double"))
    if isinstance(kind, T.StringType):
        return F.coalesce((F.trim(col) != "") & F.trim(col).rlike(NUMERIC), F.lit(False))
    return F.lit(False)


def key_category(key: str) -> tuple[str, float] | None:
    """What a key's name says, decided at plan time."""
    bare = re.sub(r"[_\-. ]", "", key).lower()
    for category, confidence, names in KEY_NAMES:
        if bare in names:
            return category, confidence
    return next(((c, p) for c, p, parts in KEY_PARTS if any(x in bare for x in parts)), None)


def is_sensitive_key(key: str) -> bool:
    bare = re.sub(r"[_\-. ]", "", key).lower()
    return any(bare in names for _, _, names in KEY_NAMES)


def value_category(col: Column) -> Column:
    """``struct<category, confidence>`` of a text, or null."""

    def said(category: str, confidence: float) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))

    return (
        F.when(col.rlike("(?i)" + EMAIL), said("email", 0.90))
        .when(col.rlike(UUID), said("uuid", 0.88))
        .when(col.rlike(JWT) & (F.length(col) > 40), said("token", 0.85))
        .when(col.rlike(TOKEN) & (F.length(col) >= 24), said("token", 0.75))
        .when(col.rlike(SSN), said("ssn", 0.90))
        .when(col.rlike(CREDIT_CARD), said("creditCard", 0.90))
        .when(col.rlike(IPV4), said("ipAddress", 0.88))
        .when(col.rlike(PII_PHONE) & (_digits(col) >= 7), said("phone", 0.70))
    )


def detect_pii(key: str, col: Column, kind: T.DataType) -> Column:
    """``struct<sensitive, category, confidence, by_key, by_value>``.

    Where name and value agree that something is sensitive the name's category
    counts and confidence rises by 0.05, to 0.99 at most.
    """
    by_key = key_category(key)
    value = value_category(col) if isinstance(kind, T.StringType) else F.lit(None).cast("struct<category:string,confidence:double>")
    hit = value.isNotNull()
    if by_key:
        category = F.lit(by_key[0])
        confidence = F.when(hit, F.least(F.lit(0.99), F.greatest(F.lit(by_key[1]), value["confidence"]) + 0.05)).otherwise(by_key[1])
        sensitive = F.lit(True)
    else:
        category, confidence, sensitive = value["category"], F.coalesce(value["confidence"], F.lit(0.0)), hit
    return F.struct(sensitive.alias("sensitive"), category.alias("category"), confidence.alias("confidence"), F.lit(by_key is not None).alias("by_key"), hit.alias("by_value"))
