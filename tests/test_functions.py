"""Value semantics, labels, paths, formats, masks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from docloom.functions import detect, formatters as fmt, labels, masks, paths, semantics


def values(spark, col_of, rows, kind):
    df = spark.createDataFrame([(x,) for x in rows], T.StructType([T.StructField("v", kind)])).coalesce(1)
    return [r[0] for r in df.select(col_of(F.col("v"))).collect()]


def test_number_text(spark):
    rows = [1.0, 1.5, -0.25, 1e21, 123456789.125, 1e-7, 2.5e-5, 0.001, 12345678901234.5, -3e7, float("nan"), float("inf"), None]
    got = values(spark, lambda c: semantics.number_text(c, T.DoubleType()), rows, T.DoubleType())
    assert got == ["1", "1.5", "-0.25", "1e+21", "123456789.125", "1e-7", "0.000025", "0.001", "12345678901234.5", "-30000000", "NaN", "Infinity", None]


def test_labels():
    want = {"firstName": "First Name", "user_id": "User ID", "dob": "Date of Birth", "XMLParser": "XML Parser", "user.address.city": "City", "THE_END": "THE END", "": "", "__proto__": ""}
    for k, v in want.items():
        assert labels.display_label(k) == v
    assert labels.display_label("firstName", dictionary={"firstname": "Given Name"}) == "Given Name"
    assert labels.display_label("userHTTPEndpoint", case_style="sentence") == "User HTTP endpoint"
    assert labels.merge_letters(["U", "S", "A", "Name"]) == ["USA", "Name"]


@pytest.mark.parametrize(("key", "case", "want"), [("firstName", "snake", "first_name"), ("user_id", "camel", "userId"), ("UserAge", "kebab", "user-age"), ("API_KEY", "camel", "apiKey"), ("XMLParser", "pascal", "XmlParser"), ("address1", "snake", "address_1"), ("constructor", "snake", "constructor")])
def test_key_case(key, case, want):
    assert labels.convert_key_case(key, case) == want


def test_paths():
    assert paths.parse_extract('a.b[0]["c.d"]') == ["a", "b", paths.Index(0), "c.d"]
    assert paths.split_path("a.[b.c].d") == ["a", "b.c", "d"]
    assert paths.join_path("a", "b.c") == "a.[b.c]"
    assert paths.parent_path("a.b.c") == "a.b" and paths.leaf_key("a.b.c") == "c"
    assert not paths.is_valid("a.__proto__") and paths.is_valid("a.b")
    with pytest.raises(ValueError, match="unclosed"):
        paths.parse_query("a[0")
    assert paths.parse_query("a.__proto__[*].**") == ["a", paths.Star(), paths.Deep()]


@pytest.mark.parametrize(("pattern", "path", "want"), [("a.b", "a.b", True), ("a.*", "a.b", True), ("a.*", "a.b.c", False), ("**.c", "a.b.c", True), ("**.c", "c", True), ("a.**", "a", True), ("a.**.d", "a.b.c.d", True), ("A.b", "a.b", False)])
def test_globs(pattern, path, want):
    assert paths.glob(pattern).matches(tuple(paths.split_path(path))) is want


def test_bad_globs_are_passed_over():
    with pytest.warns(UserWarning):
        assert len(paths.globs(["a", "", "x.__proto__"])) == 1


def test_numbers_and_money(spark):
    got = values(spark, lambda c: fmt.format_number(c, T.DoubleType()), [0.125, 1234.5, -2.0, 1e6, None], T.DoubleType())
    assert got == ["0.13", "1,234.5", "-2", "1,000,000", "—"]
    got = values(spark, lambda c: fmt.format_currency(c, T.StringType()), ["$1,500", "-3.5", "abc", "EUR 12", None], T.StringType())
    assert got == ["$1,500.00", "-$3.50", "—", "—", "—"]
    assert values(spark, lambda c: fmt.format_currency(c, T.LongType(), "EUR", show_symbol=False), [5], T.LongType()) == ["EUR\xa05.00"]


def test_dates(spark):
    got = values(spark, lambda c: fmt.format_date(c, T.StringType()), ["2024-01-05", "2024-01-05T10:30:00Z", "nonsense", None], T.StringType())
    assert got == ["05 Jan 2024", "05 Jan 2024", "—", "—"]
    assert values(spark, lambda c: fmt.format_date(c, T.LongType(), "YYYY-MM-DD hh:mm A"), [0], T.LongType()) == ["1970-01-01 12:00 AM"]


def test_booleans_and_enums(spark):
    assert values(spark, lambda c: fmt.format_boolean(c, T.StringType()), ["YES", "0", "x", None], T.StringType()) == ["Yes", "No", "—", "—"]
    assert values(spark, lambda c: fmt.format_enum(c, T.StringType(), {"a": "A!"}), ["a", "b", None], T.StringType()) == ["A!", "b", "—"]


def test_detect_type(spark):
    rows = ["2024-01-15", "15/01/2024", "a@b.co", "https://x.y", "12.5", "+91-98765-43210", "word", "", None]
    got = values(spark, lambda c: detect.detect_type(c, T.StringType())["type"], rows, T.StringType())
    assert got == ["date", "date", "email", "url", "number", "phone", "string", "string", "null"]


def test_pii(spark):
    rows = ["a@b.co", "123-45-6789", "4111111111111111", "10.0.0.1", "plain", None]
    got = values(spark, lambda c: detect.value_category(c)["category"], rows, T.StringType())
    assert got == ["email", "ssn", "creditCard", "ipAddress", None, None]
    assert detect.key_category("my_email_x") == ("email", 0.8) and detect.key_category("API-key") == ("token", 0.95)
    assert detect.is_sensitive_key("passwd") and not detect.is_sensitive_key("my_email_x")
    both = values(spark, lambda c: detect.detect_pii("email", c, T.StringType())["confidence"], ["a@b.co", "no"], T.StringType())
    assert both == [pytest.approx(0.99), pytest.approx(0.95)]


def test_masks(spark):
    rows = ["alice@example.com", "+1 555 123 4567", "ab", "secret123", "", None]
    got = values(spark, lambda c: masks.apply_mask(c, "partial"), rows, T.StringType())
    assert got == ["a***@example.com", "***-***-4567", "****", "s******3", "", ""]
    assert values(spark, masks.apply_mask, ["abcdefghijk", "abc"], T.StringType()) == ["********", "***"]


def plain_hash(text):
    def one(s):
        h = 5381
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h * 33) ^ (raw[i] << 8 | raw[i + 1])) & 0xFFFFFFFF
        return f"{h:08x}"

    return "".join(one(text + x) for x in "abcd")


def test_hashes(spark):
    rows = ["hello", "", "ünï\U0001f600"]
    assert values(spark, masks.quick_hash, rows, T.StringType()) == [plain_hash(x) for x in rows]
    assert values(spark, masks.sha_prefix, ["x"], T.StringType()) == [hashlib.sha256(b"x").hexdigest()[:40]]


def test_public_names():
    import docloom.api as api

    for n in ("from_", "flatten", "safe_parse", "mask_sensitive", "to_csv", "json_schema", "Sections", "exclude_keys_direct"):
        assert n in api.__all__
