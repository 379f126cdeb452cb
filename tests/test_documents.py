"""Operators on typed documents, against small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import csv_export, documents, extract, filters, json_schema, query as q, search, sections, security, structure, values
from docloom.functions import labels
from docloom.plans.nodes import variant_nodes
from docloom.sources import parse


@pytest.fixture(scope="module")
def users(spark):
    schema = "users array<struct<id: bigint, name: string, address: struct<city: string>>>, meta struct<id: bigint, active: boolean>"
    return spark.createDataFrame([([(1, "Ann", ("Rome",)), (2, "Bob", None)], (7, True))], schema)


def as_json(df):
    return [json.loads(r[0]) for r in df.select(documents.document_json(df)).collect()]


def people(spark):
    rows = [(1, "Ann", 30, "IT", 100.0), (2, "Bob", None, "DE", 200.0), (3, "Cyd", 25, "IT", float("nan")), (4, None, 25, None, float("inf"))]
    return spark.createDataFrame(rows, "id bigint, name string, age bigint, country string, salary double")


def test_where(spark):
    base = q.from_(people(spark), "id")
    ids = lambda x: [r["id"] for r in x.to_list()]
    assert ids(base.where("country", "ne", "IT")) == [2, 4]
    assert ids(base.where("name", "gt", 1)) == []
    assert ids(base.where("salary", "gt", 50)) == [1, 2, 4]
    assert ids(base.where("country", "in", ["IT", None])) == [1, 3, 4]
    assert ids(base.where("name", "contains", "B")) == [2]
    assert ids(base.where("age", "eq", "25")) == []
    assert ids(base.where("__proto__.x", "eq", 1)) == []
    assert ids(base.where_indexed(lambda d, i: i >= 2)) == [3, 4]
    with pytest.warns(UserWarning):
        assert ids(base.where("id", "weird", 3)) == [3]


def test_order(spark):
    base = q.from_(people(spark), "id")
    ids = lambda x: [r["id"] for r in x.to_list()]
    assert ids(base.order_by("age")) == [3, 4, 1, 2] and ids(base.order_by_desc("age")) == [1, 3, 4, 2]
    assert ids(base.order_by("id", True).order_by("age")) == [4, 3, 1, 2]
    assert ids(base.order_by("age").take(2).skip(1)) == [4]
    assert base.order_by("age").first()["id"] == 3 and base.order_by("age").last()["id"] == 2
    assert [r["age"] for r in base.order_by("name").select(["age"]).to_list()] == [30, None, 25, 25]
    with pytest.raises(ValueError, match="0 or more"):
        base.take(-1)


def test_aggregates(spark):
    base = q.from_(people(spark), "id")
    assert base.sum("salary") == 300 and base.avg("salary") == 75 and base.max("salary") == 200
    assert base.where("id", "lt", 0).max("salary") == float("-inf")
    groups = base.group_by("country", items=True).collect()
    assert [(r["key"], r["count"], [i["id"] for i in r["items"]]) for r in groups] == [("IT", 2, [1, 3]), ("DE", 1, [2]), (None, 1, [4])]
    assert [r["value"] for r in base.distinct("age").collect()] == [30, None, 25]
    assert base.any() and base.all(lambda d: d["id"] > 0) and base.where("id", "lt", 0).all(lambda d: F.lit(False))


def test_search(spark, users):
    assert [tuple(r) for r in search.search(users, ["rome", "ann"], []).collect()] == [("users.0.name", "Ann", "name", "ann"), ("users.0.address.city", "Rome", "city", "rome")]
    assert search.search(users, "true", [], strings_only=True).count() == 0
    assert search.search(users, "o", [], limit=1).count() == 1
    assert users.select(search.search_any(users, "BOB", whole_word=True)).first()[0]


@pytest.mark.parametrize(("path", "want"), [
    ("users[*].name", [("users.0.name", '"Ann"'), ("users.1.name", '"Bob"')]),
    ("users[1].id", [("users.1.id", "2")]),
    ("users[5].id", []),
    ("**.city", [("users.0.address.city", '"Rome"')]),
    ("meta.*", [("meta.id", "7"), ("meta.active", "true")]),
])
def test_query_path(users, path, want):
    assert [(r["path"], r["value"]) for r in search.query_rows(users, path, []).collect()] == want


def test_extract(users):
    got = users.select(extract.extract_field(users, "users[0].address.city"), extract.extract_field(users, "users.0.name", "none"), extract.has_field(users, "users[1].address"), extract.has_field(users, "users[9]"), extract.has_field(users, "meta.nope")).first()
    assert tuple(got) == ("Rome", "none", True, False, False)


def test_tiers_agree(spark, users):
    text = users.select(documents.document_json(users).alias("j"))
    rows = variant_nodes(text.select(F.parse_json("j").alias("v")), "v", [], 4)
    variant = {(r["path"], r["txt"]) for r in rows.collect() if r["kind"] not in ("NULL",) and not r["kind"].startswith(("OBJECT", "ARRAY"))}
    typed = {(r["path"], r["txt"]) for r in documents.leaf_rows(users, []).collect() if r["txt"] is not None}
    assert variant == typed


def test_flatten_and_back(spark):
    df = spark.createDataFrame([(1, ("a", (True,)), ["x", None], [(1,)], [])], "id int, u struct<n: string, `d.e`: struct<f: boolean>>, tags array<string>, objs array<struct<z: int>>, none array<string>")
    flat = documents.flatten(df)
    assert flat.keys == ["id", "u.n", "u.[d.e].f", "tags", "objs", "none"] and flat.array_object_paths == ["objs"]
    assert tuple(flat.df.first()) == (1, "a", True, "x, null", '[{"z":1}]', None)
    back = structure.unflatten(flat.df.select("id", "`u.n`", "`u.[d.e].f`"))
    assert back.first().asDict(True) == {"id": 1, "u": {"n": "a", "d.e": {"f": True}}}
    with pytest.raises(ValueError, match="value"):
        structure.unflatten(spark.createDataFrame([(1, 2)], "a int, `a.b` int"))
    arr = spark.createDataFrame([(1, 2)], "`m[0].a` int, `m[1].a` int")
    assert structure.unflatten(arr).first().asDict(True) == {"m": [{"a": 1}, {"a": 2}]}


def test_filters(spark):
    df = spark.createDataFrame([(("Al", "pw", 3), ("t",), [(1, "n", "p")])], "user struct<name: string, password: string, age: int>, internal struct<token: string>, list array<struct<id: int, name: string, password: string>>")
    out, removed = filters.exclude_keys(df, ["**.password"])
    assert as_json(out) == [{"user": {"name": "Al", "age": 3}, "internal": {"token": "t"}, "list": [{"id": 1, "name": "n"}]}]
    assert removed == ["user.password", "list.*.password"]
    assert as_json(filters.exclude_keys(df, ["PASSWORD"], case_insensitive=True)[0])[0]["user"] == {"name": "Al", "age": 3}
    assert as_json(filters.include_keys(df, ["user.name", "internal"])) == [{"user": {"name": "Al"}, "internal": {"token": "t"}}]
    assert as_json(filters.include_keys(df, ["list[*].id"])) == [{"list": [{"id": 1}]}]
    hidden = filters.hide_if(df, lambda c, k, key, path: c == "t" if k.simpleString() == "string" else None)
    assert "internal" not in as_json(hidden)[0]


def test_cleaning(spark):
    df = spark.createDataFrame([(None, "", (None,), [None, "x", ""], False, 0)], "a int, b string, c struct<d: int>, e array<string>, f boolean, g int")
    assert as_json(documents.remove_nulls(df)) == [{"e": ["x"], "f": False, "g": 0}]
    assert as_json(documents.strip_empty(df, preserve_false=False, preserve_zero=False)) == [{"e": ["x"]}]


def test_structure(spark):
    df = spark.createDataFrame([(1, (2, [1, 2]), (None, [2, 3], "z"))], "userId int, a struct<x: int, l array<int>>, b struct<x: int, l array<int>, q: string>")
    assert structure.normalize_keys(df, "snake").columns == ["user_id", "a", "b"]
    for how, want in (("replace", [2, 3]), ("concat", [1, 2, 2, 3]), ("unique", [1, 2, 3])):
        m = df.select(structure.merge_deep("a", "b", df=df, arrays=how).alias("m")).first()["m"].asDict()
        assert m == {"x": None, "l": want, "q": "z"}
    arr = spark.createDataFrame([([(1, "a"), (None, "b"), (1, "c")],)], "xs array<struct<id: int, v: string>>")
    assert {k: v.asDict() for k, v in arr.select(structure.pivot_structure(arr, "xs", "arrayToObject")).first()[0].items()} == {"1": {"v": "c"}}
    with pytest.raises(TypeError):
        structure.pivot_structure(arr, "xs", "objectToArray")
    assert structure.remap(df, {"a.x": "p.q", "nope": "r"}, default=None).first().asDict(True) == {"p": {"q": 2}}
    sparse = spark.sql("select map('0', 1, '2', 3) m")
    assert sparse.select(structure.compact_sparse(F.col("m"))).first()[0] == [1, None, 3]


def test_values(spark):
    df = spark.createDataFrame([(("2024-01-05", None), 5)], "user struct<dob: string, nick: string>, amount int")
    out, done = values.transform_values(df, {"dob": {"type": "date"}, "amount": {"type": "currency"}}, {"user.tag": lambda d: F.lit("t"), "loud": lambda d: F.concat(d["amount"], F.lit("!"))}, {"nick": "none", "user.age": 1, "top": "x"})
    assert out.first().asDict(True) == {"user": {"dob": "05 Jan 2024", "nick": "none", "age": 1, "tag": "t"}, "amount": "$5.00", "nick": "none", "top": "x", "loud": "$5.00!"}
    assert done == ["user.dob", "amount"]


def test_security(spark):
    df = spark.createDataFrame([("a@b.co", "pw", "Al", [("x@y.zz",)])], "email string, password string, name string, users array<struct<email: string>>")
    masked = security.mask_sensitive(df, auto_detect=True, mode="partial")
    row = masked.df.first()
    assert (row["email"], row["password"], row["name"], row["users"][0]["email"]) == ("a***@b.co", "****", "Al", "x***@y.zz")
    assert as_json(security.redact_keys(df, ["password"], auto_detect=True).df) == [{"name": "Al", "users": [{}]}]
    text = spark.createDataFrame([("card 1234-5678 and 99-11", ["1234-5678"])], "t string, a array<string>")
    out = security.mask_by_pattern(text, [r"\d{4}-\d{4}"], match_only=True).first()
    assert out["t"] == "card ******** and 99-11" and out["a"] == ["1234-5678"]


def test_csv(spark):
    df = spark.createDataFrame([(1, "=1+1", 'a,"b"', "x\ny"), (2, None, "", "-5")], "id int, f string, q string, n string")
    got = csv_export.to_csv(df, keep=["id"])
    assert got.header == "id,f,q,n"
    assert got.text(["id"]).split("\n") == ["id,f,q,n", "1,'=1+1,\"a,\"\"b\"\"\",x y", "2,,,'-5"]
    assert csv_export.to_csv(df.where("id > 5"), keep=["id"]).text(["id"]) == ""
    assert csv_export.to_csv(df, humanize_headers=True).header == "ID,F,Q,N"


def test_json_schema(spark):
    df = spark.createDataFrame([(1, "a@b.co", [1.0, 2.5], None), (2, None, [], ("x",))], "id int, email string, xs array<double>, o struct<k: string>").coalesce(1)
    got = json_schema.json_schema(df, required=True)
    assert got["properties"]["id"] == {"type": "integer"} and got["properties"]["email"] == {"type": ["string", "null"]}
    assert set(got["properties"]["xs"]["items"]["type"]) == {"integer", "number"} and got["properties"]["o"] == {"type": ["null", "object"]}
    assert got["required"] == ["id", "xs"]
    one = json_schema.json_schema(df.where("id = 1"), strict=True, required=True)
    assert one["properties"]["email"] == {"type": "string", "format": "email"} and one["additionalProperties"] is False


def test_sections(spark, users):
    rows = sections.Sections().fields(users, [])
    assert [(r["title"], r["label"], r["value"]) for r in sections.flatten_sections(rows, []).collect()][-2:] == [("Meta", "ID", "7"), ("Meta", "Active", "true")]
    merged = sections.merge_sections(rows, rows).where("title = 'Meta'").first()
    assert len(merged["fields"]) == 4
    assert sections.humanize(users).columns == ["Users", "Meta"]


def test_safe_parse(spark):
    rows = ['{"a":1}', '"{\\"a\\":1}"', "{bad", "42", "5", "-5", "word", "true", '{"a":1,"a":2}', None]
    df = spark.createDataFrame([(x,) for x in rows], "t string").coalesce(1)
    got = [r[0] for r in df.select(F.when(F.col("t").isNotNull(), F.to_json(parse.safe_parse(F.col("t"))))).collect()]
    assert got == ['{"a":1}', '{"a":1}', '"{bad"', "42", '"5"', '"-5"', '"word"', "true", '{"a":2}', None]
    with pytest.raises(Exception, match="unsafe"):
        spark.createDataFrame([('{"__proto__":1}',)], "t string").select(F.to_json(parse.safe_parse(F.col("t"), throw_on_pollution=True))).collect()


def test_filters_reach_the_scan(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "p"))
    df = q.from_(spark.read.parquet(str(tmp_path / "p"))).where("country", "eq", "IT").select(["id"]).to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(country,IT)]" in plan and "ReadSchema: struct<id:bigint,country:string>" in plan and "Python" not in plan


def test_pattern_masks_where_it_matches(spark):
    df = spark.createDataFrame([(1, "cat concat 12 a12b"), (2, None), (3, "")], "id int, t string")
    got = [r["t"] for r in security.mask_by_pattern(df, [r"\bcat\b", r"(?<=a)1"], match_only=True).orderBy("id").collect()]
    assert got == ["*** concat 12 a*2b", None, ""]
    assert [r["t"] for r in security.mask_by_pattern(df, [r"x*"], match_only=True).orderBy("id").collect()] == ["cat concat 12 a12b", None, ""]
    told = security.mask_by_pattern_audited(df, ["^cat"]).audited().orderBy("id").collect()
    assert [(r["t"], len(r["audit"])) for r in told] == [("********", 1), (None, 0), ("", 0)]


def test_csv_files_begin_with_the_header(spark, tmp_path):
    out = csv_export.to_csv(spark.range(10).repartition(3).withColumn("name", F.lit("a,b")), line_break="\n")
    out.write(str(tmp_path / "csv"))
    files = [p.read_text().splitlines() for p in (tmp_path / "csv").glob("part-*")]
    files = [f for f in files if f]
    assert files and all(f[0] == "id,name" and "id,name" not in f[1:] for f in files)
    assert sorted(line for f in files for line in f[1:]) == sorted(f'{i},"a,b"' for i in range(10))


def test_wraps_up_to_the_limit(spark):
    import json

    text = '{"a": 1}'
    for _ in range(8):
        text = json.dumps(text)
    df = spark.createDataFrame([(text,), (None,), ("plain",), (json.dumps("x y"),)], "t string")
    got = [r[0] for r in df.select(F.to_json(parse.safe_parse(F.col("t")))).collect()]
    assert got == ['{"a":1}', 'null', '"plain"', '"x y"']
    assert df.limit(1).select(F.to_json(parse.safe_parse(F.col("t"), 3))).first()[0].startswith('"\\"')


def test_remap_keeps_what_is_left(spark):
    df = spark.createDataFrame([(("Alice", 30), (1,)), (None, None)], "user struct<name:string,age:int>, meta struct<id:int>")
    got = structure.remap(df, {"user.name": "fullName"}, keep_unmapped=True).collect()
    assert [r.asDict(True) for r in got] == [{"fullName": "Alice", "user": {"age": 30}, "meta": {"id": 1}}, {"fullName": None, "user": None, "meta": None}]
    into = structure.remap(df, {"user.name": "meta.name", "id": "gone"}, keep_unmapped=True).first().asDict(True)
    assert into == {"meta": {"name": "Alice"}, "user": {"age": 30}}


def test_schema_options(spark):
    df = spark.createDataFrame([([("a",), (None,)], "2024-01-02")], "xs array<struct<k:string>>, d string")
    first = json_schema.json_schema(df, merge_array_items=False)["properties"]
    assert first["xs"]["items"]["properties"]["k"] == {"type": "string"} and first["d"]["format"] == "date"
    assert json_schema.json_schema(df)["properties"]["xs"]["items"]["properties"]["k"]["type"] == ["string", "null"]
    assert json_schema.json_schema(df, max_depth=1, infer_formats=False)["properties"] == {"xs": {"type": "array", "items": {}}, "d": {"type": "string"}}
    assert json_schema.json_schema_from_samples(df.limit(0))["properties"] == {}


def test_tokens_by_column(spark):
    keys = ["userID", "HTTPServer2Go", "a_b-c.d e", "XMLHttpRequest", "größeX", "v2", "__x__", "", "ABC", "fooBAR9baz"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).select(labels.tokens_column(F.col("k"))).collect()]
    assert got == [labels.tokenize(k) for k in keys]
    assert got[:5] == [["user", "ID"], ["HTTP", "Server", "2", "Go"], ["a", "b", "c", "d", "e"], ["XML", "Http", "Request"], ["größe", "X"]]
