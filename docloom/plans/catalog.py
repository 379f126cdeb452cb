"""Named queries over the star-schema tables, with the SQL each must equal."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import formatters as fmt, masks
from ..functions.detect import detect_pii, detect_type, is_date_like, is_numeric_like
from ..functions.labels import convert_key_case, display_label, tokens_column
from ..operators import csv_export, documents, extract, filters, json_schema, query as q, search as s, sections, security, structure, values
from ..sources import parse
from .nodes import variant_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parse.configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested documents; balances below zero and every third segment are missing."""
    c = _table(spark, sf_dir, "customer")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(18,2)"))
    segment = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("fullName"), F.struct(F.col("c_nationkey").alias("nationKey")).alias("homeAddress"), segment.alias("marketSegment")).alias("user"), F.struct(balance.alias("accountBalance"), F.lit("s3cret").alias("apiToken")).alias("billing"))


_CUSTOMERS = """
    c AS (SELECT c_custkey AS id, c_name AS full_name, c_nationkey AS nation,
                 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment,
                 CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS balance FROM customer)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of objects."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("items"))
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"))
    return o.join(lines, o["id"] == lines["l_orderkey"]).select("id", "customer", "items")


# fluent queries


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def linq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "orders"), "o_orderkey").where("o_totalprice", "gt", 100000).order_by_desc("o_totalprice").take(10).select(["o_orderkey", "o_totalprice"]).to_df()


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'")
def where_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "orders")).where("o_orderstatus", "eq", "F").select(["o_orderkey", "o_orderstatus"]).to_df()


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def where_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "orders")).where("o_orderstatus", "!=", "F").select(["o_orderkey", "o_orderstatus"]).to_df()


def _where_number(op: str, value: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.from_(_table(spark, sf_dir, "lineitem")).where("l_quantity", op, value).select(["l_orderkey", "l_linenumber", "l_quantity"]).to_df()

    return run


for _name, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    QUERIES[f"where_{_name}"] = _where_number(_name, 25)
    SQL[f"where_{_name}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 25"


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "customer")).where("c_mktsegment", "in", ["BUILDING", "MACHINERY", 7]).select(["c_custkey"]).to_df()


@_query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a1')")
def where_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "part")).where("p_name", "contains", "A1").select(["p_partkey", "p_name"]).to_df()


@_query("SELECT o_orderkey FROM orders WHERE false")
def where_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "orders")).where("o_orderstatus", "gt", 5).select(["o_orderkey"]).to_df()


@_query("SELECT o_orderkey AS id, o_custkey AS \"customer.key\", (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber, l_partkey LIMIT 1) AS \"items[0].part\" FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def select_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_orders(spark, sf_dir)).select(["id", "customer.key", "items[0].part"]).to_df()


@_query("SELECT l_linenumber AS line, l_partkey AS part, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def select_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_orders(spark, sf_dir), "id").select_many("items").to_df()


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 20 OFFSET 5")
def order_take_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"])
    return rows.order_by_desc("l_extendedprice").take(25).skip(5).select(["l_orderkey", "l_linenumber", "l_extendedprice"]).to_df()


@_query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem ORDER BY l_discount, l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 15")
def order_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"])
    return rows.order_by_desc("l_quantity").order_by("l_discount").take(15).select(["l_orderkey", "l_linenumber", "l_tax"]).to_df()


@_query("SELECT round(sum(l_quantity), 2) AS sum_q, round(sum(l_quantity) / count(*), 6) AS avg_q, min(l_quantity) AS min_q, max(l_quantity) AS max_q FROM lineitem")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "lineitem")).aggregates(("sum", "l_quantity"), ("avg", "l_quantity"), ("min", "l_quantity"), ("max", "l_quantity"))
    return rows.select(F.round("sum_l_quantity", 2).alias("sum_q"), F.round("avg_l_quantity", 6).alias("avg_q"), F.col("min_l_quantity").alias("min_q"), F.col("max_l_quantity").alias("max_q"))


@_query("SELECT round(sum(coalesce(o_custkey, 0)) / count(*), 4) AS avg_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def avg_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    rows = q.from_(c.join(o, c["c_custkey"] == o["o_custkey"], "left")).aggregates(("avg", "o_custkey"))
    return rows.select(F.round("avg_o_custkey", 4).alias("avg_key"))


@_query("SELECT 0.0::DOUBLE AS sum_x, 'NaN' AS avg_x, 'Infinity' AS min_x, '-Infinity' AS max_x")
def aggregates_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "orders")).where("o_orderkey", "lt", -1).aggregates(("sum", "o_totalprice"), ("avg", "o_totalprice"), ("min", "o_totalprice"), ("max", "o_totalprice"))
    return rows.select(F.col("sum_o_totalprice").alias("sum_x"), *[F.col(f"{f}_o_totalprice").cast("string").alias(f"{f}_x") for f in ("avg", "min", "max")])


@_query("SELECT event_type AS key, count(*) AS count, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "events"), "event_id").group_by("event_type", [("sum", "value")])
    return rows.select("key", "count", F.round("sum_value", 3).alias("total"))


@_query("SELECT n_regionkey AS key, count(*) AS count, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def group_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "nation"), "n_nationkey").group_by("n_regionkey", items=True)
    return rows.select("key", "count", F.array_join(F.transform("items", lambda x: x["n_name"]), ",").alias("names"))


@_query("SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place FROM orders GROUP BY o_orderpriority")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "orders"), "o_orderkey").distinct("o_orderpriority")
    listed = rows.agg(F.collect_list("value").alias("v"))  # the distinct priorities, in order
    return listed.select(F.posexplode("v").alias("place", "value")).select("value", F.col("place").cast("long").alias("place"))


@_query("SELECT count(*) AS n, count(*) FILTER (o_totalprice > 400000) > 0 AS some, bool_and(o_totalprice > 0) AS every FROM orders")
def any_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.from_(_table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(rows.count(), rows.where("o_totalprice", ">", 400000).any(), rows.all(lambda d: d["o_totalprice"] > 0))], "n long, some boolean, every boolean")


@_query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey DESC LIMIT 1")
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = q.from_(_table(spark, sf_dir, "region"), "r_regionkey").last()
    return spark.createDataFrame([row], "r_regionkey int, r_name string")


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licen') OR contains(lower(source), 'licen') OR contains(lower(lang), 'licen')")
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).search("licen").to_df().select("doc_id")


@_query(r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(^|[^a-zA-Z0-9_])(?i:the)($|[^a-zA-Z0-9_])')")
def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return s.search(rows, "the", ["conv_id", "turn"], whole_word=True).select("conv_id", "turn")


# paths


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def path_extract_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("props"))
    return rows.select("event_id", extract.extract_field(rows, "props.k").cast("string").alias("k"))


@_query("SELECT event_id, json_exists(props, '$.k') AS has_k, false AS has_z FROM events")
def path_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("props"))
    return rows.select("event_id", extract.has_field(rows, "props.k").alias("has_k"), extract.has_field(rows, "props.z").alias("has_z"))


_LINES = "l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS pos FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"


@_query(f"WITH {_LINES} SELECT l_orderkey AS id, pos::INT AS pos, 'items.' || pos || '.part' AS path, l_partkey::VARCHAR AS value FROM l")
def path_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.query_rows(_orders(spark, sf_dir), "items[*].part", ["id"])


@_query(f"WITH {_LINES} SELECT l_orderkey AS id, 'items.' || pos || '.part' AS path, l_partkey::VARCHAR AS value FROM l")
def path_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.query_rows(_orders(spark, sf_dir), "**.part", ["id"]).select("id", "path", "value")


@_query("SELECT event_id, 'k' AS path, 'k' AS key, json_extract_string(props, '$.k') AS txt FROM events WHERE json_exists(props, '$.k')")
def variant_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return variant_nodes(rows, "v", ["event_id"], 2).select("event_id", "path", "key", "txt")


@_query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def collect_keys_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return variant_nodes(rows, "v", ["event_id"], 1).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))


@_query("SELECT unnest(['id', 'user', 'user.fullName', 'user.homeAddress', 'user.homeAddress.nationKey', 'user.marketSegment', 'billing', 'billing.accountBalance', 'billing.apiToken']) AS key, 9 AS total")
def collect_keys_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, n = documents.collect_keys(_customers(spark, sf_dir), dot_notation=True)
    return spark.createDataFrame([(k, n) for k in keys], "key string, total int")


# documents


@_query(f"""WITH {_CUSTOMERS} SELECT id, full_name AS "user.fullName", nation AS "user.homeAddress.nationKey", segment AS "user.marketSegment", balance::VARCHAR AS "billing.accountBalance", 's3cret' AS "billing.apiToken" FROM c""")
def flatten_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.flatten(_customers(spark, sf_dir)).df
    return out.withColumn("billing.accountBalance", F.col("`billing.accountBalance`").cast("string"))


@_query(f"""WITH {_CUSTOMERS} SELECT id, full_name, nation, balance::VARCHAR AS balance FROM c""")
def unflatten_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = structure.unflatten(documents.flatten(_customers(spark, sf_dir)).df)
    return back.select("id", F.col("user.fullName").alias("full_name"), F.col("user.homeAddress.nationKey").alias("nation"), F.col("billing.accountBalance").cast("string").alias("balance"))


@_query(f"""WITH {_CUSTOMERS} SELECT id, full_name AS name, nation, balance::VARCHAR AS balance FROM c""")
def remap_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.remap(_customers(spark, sf_dir), {"id": "id", "user.fullName": "who.name", "user.homeAddress.nationKey": "who.nation", "billing.accountBalance": "balance"})
    return out.select("id", "who.name", "who.nation", F.col("balance").cast("string").alias("balance"))


@_query(f"""WITH {_CUSTOMERS} SELECT id, full_name, nation AS nation_key, segment AS market_segment, balance::VARCHAR AS account_balance FROM c""")
def normalize_keys_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.normalize_keys(_customers(spark, sf_dir), "snake")
    return out.select("id", "user.full_name", "user.home_address.nation_key", "user.market_segment", F.col("billing.account_balance").cast("string").alias("account_balance"))


@_query("SELECT r_regionkey, n_nationkey::VARCHAR AS key, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def pivot_array_to_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    pivoted = n.select(F.col("n_regionkey").alias("r_regionkey"), structure.pivot_structure(n, "nations", "arrayToObject", key_field="n_nationkey").alias("m"))
    return pivoted.select("r_regionkey", F.explode("m").alias("key", "v")).select("r_regionkey", "key", "v.n_name")


@_query(f"""WITH {_CUSTOMERS} SELECT id, 'accountBalance' AS key, balance::VARCHAR AS value FROM c UNION ALL SELECT id, 'apiToken', 's3cret' FROM c""")
def pivot_object_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).select("id", F.struct(F.col("billing.accountBalance").cast("string").alias("accountBalance"), F.col("billing.apiToken").alias("apiToken")).alias("b"))
    return rows.select("id", F.explode(structure.pivot_structure(rows, "b", "objectToArray")).alias("e")).select("id", "e.key", "e.value")


@_query("SELECT c_custkey AS id, 'new' AS name, c_nationkey AS nation, NULL::VARCHAR AS segment, 'x' AS extra FROM customer")
def merge_deep_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).withColumn("patch", F.struct(F.lit("new").alias("fullName"), F.lit(None).cast("string").alias("marketSegment"), F.lit("x").alias("extra")))
    m = rows.select("id", structure.merge_deep("user", "patch", df=rows).alias("m"))
    return m.select("id", F.col("m.fullName").alias("name"), F.col("m.homeAddress.nationKey").alias("nation"), F.col("m.marketSegment").alias("segment"), F.col("m.extra").alias("extra"))


def _as_json(df: DataFrame) -> DataFrame:
    return df.select("id", documents.document_json(df).alias("doc"))


def _json_sql(user: str, billing: str) -> str:
    return f"WITH {_CUSTOMERS} SELECT id, '{{\"id\":' || id || {user} || {billing} || '}}' AS doc FROM c"


_NAME = """',"user":{"fullName":"' || full_name || '","homeAddress":{"nationKey":' || nation || '}'"""
_NO_BLANK = """CASE WHEN segment = '' THEN '' ELSE ',"marketSegment":"' || segment || '"' END || '}'"""
_SEGMENT = """',"marketSegment":"' || segment || '"}'"""
_BALANCE = """CASE WHEN balance IS NULL THEN '' ELSE '"accountBalance":' || balance || ',' END"""


@_query(_json_sql(f"{_NAME} || {_SEGMENT}", "CASE WHEN balance IS NULL THEN ',\"billing\":{}' ELSE ',\"billing\":{\"accountBalance\":' || balance || '}' END"))
def exclude_keys_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(filters.exclude_keys(_customers(spark, sf_dir), ["**.apiToken"])[0])


@_query(_json_sql("""',"user":{"fullName":"' || full_name || '"}'""", f"""',"billing":{{' || {_BALANCE} || '"apiToken":"s3cret"}}'"""))
def include_keys_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(filters.include_keys(_customers(spark, sf_dir), ["id", "user.fullName", "billing"]))


@_query(_json_sql(f"{_NAME} || {_NO_BLANK}", f"""',"billing":{{' || {_BALANCE} || '"apiToken":"s3cret"}}'"""))
def hide_if_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(filters.hide_if(_customers(spark, sf_dir), filters.is_empty_string))


@_query(_json_sql(f"{_NAME} || {_NO_BLANK}", f"""',"billing":{{' || {_BALANCE} || '"apiToken":"s3cret"}}'"""))
def strip_empty_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(documents.strip_empty(_customers(spark, sf_dir)))


@_query(_json_sql(f"{_NAME} || {_NO_BLANK}", "CASE WHEN balance IS NULL THEN '' ELSE ',\"billing\":{\"accountBalance\":' || balance || '}' END"))
def remove_nulls_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = filters.exclude_keys(_customers(spark, sf_dir), ["apiToken"])
    return _as_json(documents.remove_nulls(rows))


# values


@_query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS shown, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS full_time FROM orders")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    kind = o.schema["o_orderdate"].dataType
    return o.select("o_orderkey", fmt.format_date(F.col("o_orderdate"), kind).alias("shown"), fmt.format_date(F.col("o_orderdate"), kind, "YYYY/MM/DD HH:mm:ss").alias("full_time"))


@_query("SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(round(o_totalprice::DECIMAL(38,12), 2)::DECIMAL(18,2))) AS money FROM orders")
def format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.format_currency(F.col("o_totalprice"), T.DoubleType()).alias("money"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, rtrim(rtrim(format('{:,.2f}', round(l_extendedprice::DECIMAL(38,12), 2)::DECIMAL(18,2)), '0'), '.') AS shown FROM lineitem")
def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fmt.format_number(F.col("l_extendedprice"), T.DoubleType()).alias("shown"))


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 2 = 1 THEN 'Yes' ELSE 'No' END AS odd FROM orders")
def format_enum_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fmt.format_enum(F.col("o_orderstatus"), T.StringType(), {"F": "Done", "O": "Open"}).alias("status"), fmt.format_boolean(F.col("o_custkey") % 2 == 1, T.BooleanType()).alias("odd"))


@_query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^ \\t\\n\\r/$.?#].[^ \\t\\n\\r]*$') THEN 'url' ELSE 'string' END AS kind, false AS numeric FROM pages")
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", detect_type(F.col("url"), T.StringType())["type"].alias("kind"), is_numeric_like(F.col("url"), T.StringType()).alias("numeric"))


@_query(f"WITH {_CUSTOMERS} SELECT id, coalesce(balance, 0)::DECIMAL(18,2)::VARCHAR AS balance, 'n/a' AS note FROM c")
def defaults_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = values.apply_defaults(_customers(spark, sf_dir), {"accountBalance": 0, "note": "n/a"})
    return out.select("id", F.col("billing.accountBalance").cast("string").alias("balance"), "note")


@_query(f"WITH {_CUSTOMERS} SELECT id, id * 2 AS twice, full_name || '!' AS loud FROM c")
def computed_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = values.inject_computed(_customers(spark, sf_dir), {"twice": lambda d: d["id"] * 2, "user.loud": lambda d: F.concat(d["user.fullName"], F.lit("!"))})
    return out.select("id", "twice", F.col("user.loud").alias("loud"))


@_query(f"WITH {_CUSTOMERS} SELECT id, upper(full_name) AS name, CASE WHEN balance IS NULL THEN '—' ELSE '$' || format('{{:,.2f}}', balance) END AS balance FROM c")
def transform_values_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = values.transform_values(_customers(spark, sf_dir), {"accountBalance": {"type": "currency"}, "user.fullName": lambda c, k: F.upper(c)})
    return out.select("id", F.col("user.fullName").alias("name"), F.col("billing.accountBalance").alias("balance"))


# security


@_query(f"""WITH {_CUSTOMERS} SELECT id, left(full_name, 1) || repeat('*', least(length(full_name) - 2, 6)) || right(full_name, 1) AS name, '******' AS token, 1 AS entries FROM c WHERE length(regexp_replace(full_name, '[^0-9]', '', 'g')) < 7
    UNION ALL SELECT id, '***-***-' || right(regexp_replace(full_name, '[^0-9]', '', 'g'), 4), '******', 1 FROM c WHERE length(regexp_replace(full_name, '[^0-9]', '', 'g')) >= 7""")
def mask_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = security.mask_sensitive(_customers(spark, sf_dir), ["user.fullName"], "partial")
    full = security.mask_sensitive(partial.df, ["**.apiToken"])
    return full.df.select("id", F.col("user.fullName").alias("name"), F.col("billing.apiToken").alias("token"), F.size(full.audit).alias("entries"))


@_query("SELECT c_custkey AS id, left(sha256(c_name), 40) AS sha FROM customer")
def mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), masks.sha_prefix(F.col("c_name")).alias("sha"))


_HASH = "format('{{:08x}}', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0} || '{1}', ''), lambda x: unicode(x)::BIGINT)), lambda a, u: xor(a * 33, u) & 4294967295))"


@_query("SELECT c_custkey, " + " || ".join(_HASH.format("c_name", x) for x in "abcd") + " AS hash FROM customer")
def quick_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", masks.quick_hash(F.col("c_name")).alias("hash"))


@_query(_json_sql(f"{_NAME} || {_SEGMENT}", "CASE WHEN balance IS NULL THEN ',\"billing\":{}' ELSE ',\"billing\":{\"accountBalance\":' || balance || '}' END"))
def redact_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(security.redact_keys(_customers(spark, sf_dir), auto_detect=True, categories=["token"]).df)


@_query("SELECT doc_id, regexp_replace(text, '[0-9]{9,}', '********', 'g') AS text FROM documents")
def mask_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.mask_by_pattern(_table(spark, sf_dir, "documents").select("doc_id", "text"), [r"[0-9]{9,}"], match_only=True)


_SAMPLES = ["lower(replace(c_name, '#', '.')) || '@example.com'", "'10.0.0.' || (c_custkey % 250)", "'plain words'", "'123-45-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')", "'2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0')", "'https://example.com/' || c_custkey", "' ' || c_custkey || '.5 '"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with texts of seven kinds in turn."""
    key = F.col("c_custkey").cast("string")
    texts = [F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")), F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 250).cast("string")), F.lit("plain words"), F.concat(F.lit("123-45-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")), F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")), F.concat(F.lit("https://example.com/"), key), F.concat(F.lit(" "), key, F.lit(".5 "))]
    return _table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*texts), (F.col("c_custkey") % 7 + 1).cast("int")).alias("note"))


_SAMPLED = "s AS (SELECT c_custkey, c_custkey % 7 AS k, [" + ", ".join(_SAMPLES) + "][c_custkey % 7 + 1] AS note FROM customer)"


@_query(f"WITH {_SAMPLED} SELECT c_custkey, k IN (0, 1, 3, 4) AS sensitive, CASE k WHEN 0 THEN 'email' WHEN 1 THEN 'ipAddress' WHEN 3 THEN 'ssn' WHEN 4 THEN 'phone' END AS category FROM s")
def detect_pii_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir)
    found = detect_pii("note", F.col("note"), T.StringType())
    return rows.select("c_custkey", found["sensitive"].alias("sensitive"), found["category"].alias("category"))


@_query(f"WITH {_SAMPLED} SELECT c_custkey, CASE k WHEN 0 THEN 'email' WHEN 4 THEN 'date' WHEN 5 THEN 'url' WHEN 6 THEN 'number' ELSE 'string' END AS kind, k = 6 AS numeric, k = 4 AS dated FROM s")
def detect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.StringType()
    return _samples(spark, sf_dir).select("c_custkey", detect_type(F.col("note"), text)["type"].alias("kind"), is_numeric_like(F.col("note"), text).alias("numeric"), is_date_like(F.col("note"), text).alias("dated"))


@_query(f"WITH {_SAMPLED} SELECT c_custkey, CASE WHEN k IN (0, 1, 3) THEN repeat('*', least(length(note), 8)) ELSE note END AS note, (k IN (0, 1, 3))::INT AS entries FROM s")
def mask_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = security.mask_sensitive(_samples(spark, sf_dir), auto_detect=True).audited()
    return out.select("c_custkey", "note", F.size("audit").alias("entries"))


@_query("SELECT c_custkey, reverse(c_name) AS custom, " + " || ".join(_HASH.format("c_mktsegment", x) for x in "abcd") + " AS hashed, left(c_mktsegment, 1) || repeat('*', least(length(c_mktsegment) - 2, 6)) || right(c_mktsegment, 1) AS part FROM customer")
def mask_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("a"), F.col("c_mktsegment").alias("b"))
    out = security.mask_sensitive(c, ["c_name"], "custom", custom=F.reverse).df
    out = security.mask_sensitive(out, ["a"], "hash").df
    out = security.mask_sensitive(out, ["b"], "partial").df
    return out.select("c_custkey", F.col("c_name").alias("custom"), F.col("a").alias("hashed"), F.col("b").alias("part"))


@_query("SELECT conv_id, turn, repeat('*', least(length(regexp_extract(text, '^[A-Za-z]+')), 8)) || substr(text, length(regexp_extract(text, '^[A-Za-z]+')) + 1) AS text, regexp_matches(text, '^[A-Za-z]') AS changed FROM conversations")
def mask_pattern_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = security.mask_by_pattern_audited(rows, [r"^[A-Za-z]+"], match_only=True).audited()
    return out.select("conv_id", "turn", "text", (F.size("audit") > 0).alias("changed"))


@_query(_json_sql("""',"user":{"fullName":"********","homeAddress":{"nationKey":' || nation || '}' || """ + _SEGMENT, "CASE WHEN balance IS NULL THEN ',\"billing\":{}' ELSE ',\"billing\":{\"accountBalance\":' || balance || '}' END"))
def safe_clone_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(security.safe_clone(_customers(spark, sf_dir), ["fullName"], ["apiToken"]))


# export, labels, sections, parsing


@_query("""SELECT c_custkey, c_custkey || ',' || c_name || ',' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(c_acctbal AS DECIMAL(18,2)) || ',"a ""b"", c"' AS line FROM customer""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"), F.lit('a "b",\nc').alias("note"))
    c = c.withColumn("note", F.replace("note", F.lit("\n"), F.lit(" ")))
    return csv_export.to_csv(c, keep=["c_custkey"]).lines


@_query("SELECT '$' AS path, 'object' AS type, count(*) AS n FROM customer UNION ALL SELECT '$.c_custkey', 'integer', count(*) FROM customer UNION ALL SELECT '$.bal', 'null', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT '$.bal', CASE WHEN c_acctbal = floor(c_acctbal) THEN 'integer' ELSE 'number' END AS t, count(*) FROM customer WHERE c_acctbal >= 0 GROUP BY t")
def json_schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return json_schema.type_counts(c)


_SCHEMA = """'{"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": {"id": {"type": "integer"}, "customer": {"type": "object", "properties": {"key": {"type": "integer"}, "status": {"type": "string"}}{0}}, "items": {"type": "array", "items": {"type": "object", "properties": {"line": {"type": "integer"}, "part": {"type": "integer"}, "flag": {"type": "string"}}{1}}}}{2}}'"""
_NEED = """, "required": [{0}]"""
_NEEDED = [_NEED.replace("{0}", x) for x in ('"key", "status"', '"line", "part", "flag"', '"id", "customer", "items"')]


@_query("SELECT " + _SCHEMA.replace("{0}", _NEEDED[0]).replace("{1}", _NEEDED[1]).replace("{2}", _NEEDED[2]) + " AS schema")
def json_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(json_schema.json_schema_text(_orders(spark, sf_dir), required=True),)], "schema string")


@_query("SELECT " + _SCHEMA.replace("{0}", "").replace("{1}", "").replace("{2}", "") + """ AS merged, '{"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": {}}' AS nothing, count(*) FILTER (r_name IS NULL) AS empty_names FROM region""")
def json_schema_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    shown = [json.dumps(json_schema.json_schema_from_samples(x)) for x in (orders, orders.where("id < 0"))]
    return _table(spark, sf_dir, "region").agg(F.lit(shown[0]).alias("merged"), F.lit(shown[1]).alias("nothing"), F.count_if(F.col("r_name").isNull()).alias("empty_names"))


@_query("SELECT * FROM (VALUES ('o_orderkey', 'O Orderkey', 'oOrderkey'), ('o_custkey', 'O Custkey', 'oCustkey'), ('o_orderstatus', 'O Orderstatus', 'oOrderstatus'), ('o_totalprice', 'O Totalprice', 'oTotalprice'), ('o_orderdate', 'O Orderdate', 'oOrderdate'), ('o_orderpriority', 'O Orderpriority', 'oOrderpriority')) t(key, label, camel)")
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "orders").columns
    return spark.createDataFrame([(n, display_label(n), convert_key_case(n, "camel")) for n in names], "key string, label string, camel string")


@_query(f"""WITH {_CUSTOMERS} SELECT id, full_name, nation, segment, balance::VARCHAR AS balance FROM c""")
def humanize_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.humanize(_customers(spark, sf_dir))
    return out.select(F.col("ID").alias("id"), F.col("User.`Full Name`").alias("full_name"), F.col("User.`Home Address`.`Nation Key`").alias("nation"), F.col("User.`Market Segment`").alias("segment"), F.col("Billing.`Account Balance`").cast("string").alias("balance"))


@_query(f"""WITH {_CUSTOMERS} SELECT id, 'user' AS section, 'User' AS title, 'Full Name' AS label, full_name AS value FROM c
    UNION ALL SELECT id, 'user', 'User', 'Market Segment', segment FROM c
    UNION ALL SELECT id, 'user.homeAddress', 'Home Address', 'Nation Key', nation::VARCHAR FROM c
    UNION ALL SELECT id, 'billing', 'Billing', 'API Token', 's3cret' FROM c""")
def sections_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.Sections(exclude=["accountBalance"]).fields(_customers(spark, sf_dir), ["id"])
    return out.select("id", "section", "title", "label", "value")


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def safe_parse_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.array("props")).alias("wrapped"))
    rows = rows.withColumn("wrapped", F.substring("wrapped", F.lit(2), F.length("wrapped") - 2))  # JSON text of JSON text
    rows = rows.select("event_id", parse.safe_parse(F.col("wrapped")).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def deep_safe_parse_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "props")
    out = parse.deep_safe_parse(rows, {"props": "k string"})
    return out.select("event_id", F.col("props.k").alias("k"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def safe_parse_wrapped_often(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("w"))
    for _ in range(5):  # JSON text of JSON text, five times
        rows = rows.withColumn("w", F.to_json(F.array("w"))).withColumn("w", F.substring("w", F.lit(2), F.length("w") - 2))
    return rows.select("event_id", F.try_variant_get(parse.safe_parse(F.col("w")), "$.k", "string").alias("k"))


# further forms of the same operators


@_query(f"WITH {_CUSTOMERS} SELECT id, full_name AS name, nation, segment, balance::VARCHAR AS balance, 's3cret' AS token FROM c")
def remap_keep_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.remap(_customers(spark, sf_dir), {"user.fullName": "name"}, keep_unmapped=True)
    return out.select("id", "name", F.col("user.homeAddress.nationKey").alias("nation"), F.col("user.marketSegment").alias("segment"), F.col("billing.accountBalance").cast("string").alias("balance"), F.col("billing.apiToken").alias("token"))


@_query(f"WITH {_CUSTOMERS} SELECT id FROM c WHERE NOT coalesce(balance > 100, false)")
def where_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    return rows.where(~q.path_predicate(rows, "billing.accountBalance", "gt", 100)).select("id")


@_query(f"WITH {_CUSTOMERS} SELECT id FROM c WHERE balance >= 100 AND segment = 'BUILDING'")
def where_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    return rows.where(q.all_of(q.path_predicate(rows, "billing.accountBalance", ">=", 100), q.path_predicate(rows, "user.marketSegment", "==", "BUILDING"))).select("id")


@_query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = q.from_(_table(spark, sf_dir, "region"), "r_regionkey").first()
    return spark.createDataFrame([row], "r_regionkey int, r_name string")


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3 AND n_name < 'P' AND n_regionkey * 2 < 7")
def where_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "nation")).where(lambda d: (d["n_nationkey"] >= 3) & (d["n_name"] < "P")).where(lambda d: d["n_regionkey"] * 2 < 7).select(["n_nationkey", "n_name"]).to_df()


@_query("SELECT n_nationkey + 1 AS next, upper(n_name) || '!' AS loud FROM nation")
def select_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.from_(_table(spark, sf_dir, "nation")).select(lambda d: [(d["n_nationkey"] + 1).alias("next"), F.concat(F.upper(d["n_name"]), F.lit("!")).alias("loud")]).to_df()


@_query(f"WITH {_LINES} SELECT l_orderkey AS id, max(l_partkey) FILTER (pos = 0)::VARCHAR AS first_part, count(*)::INT AS parts FROM l GROUP BY l_orderkey")
def get_first_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return rows.select("id", s.get_first(rows, "items[*].part").alias("first_part"), F.size(s.get_all(rows, "items[*].part")).alias("parts"))


@_query("SELECT doc_id, contains(lower(coalesce(text, '')), 'licen') OR contains(lower(coalesce(text, '')), 'password') AS found FROM documents")
def search_any_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", s.search_any(rows.select("text"), ["licen", "password"]).alias("found"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pick_and_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").withColumns({"more": F.lit(1), "less": F.lit(2)})
    return extract.omit_keys(extract.pick_keys(n, ["n_name", "n_nationkey", "n_regionkey", "more"]), ["more"])


@_query("SELECT n_nationkey AS k, n_nationkey || ',' || n_regionkey || ',' || n_regionkey || ',99' AS joined, CASE WHEN n_nationkey = n_regionkey THEN n_nationkey || ',99' ELSE n_nationkey || ',' || n_regionkey || ',99' END AS once, n_regionkey || ',99' AS plain FROM nation")
def merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.array("n_nationkey", "n_regionkey").alias("xs")).alias("a"), F.struct(F.array(F.col("n_regionkey"), F.lit(99)).alias("xs")).alias("b"))
    text = lambda c: F.array_join(F.transform(c["xs"], lambda x: x.cast("string")), ",")
    return n.select(F.col("n_nationkey").alias("k"), text(structure.merge_deep("a", "b", df=n, arrays="concat")).alias("joined"), text(structure.merge_deep("a", "b", df=n, arrays="unique")).alias("once"), text(structure.deep_merge("a", "b", n)).alias("plain"))


@_query("SELECT n_nationkey, true AS same, n_nationkey = n_regionkey AS swapped FROM nation")
def deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.struct(F.col("n_nationkey").alias("x"), F.array("n_regionkey", "n_nationkey").alias("y"))
    b = F.struct(F.array(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long")).alias("y"), F.col("n_nationkey").cast("double").alias("x"))
    c = F.struct(F.array("n_nationkey", "n_regionkey").alias("y"), F.col("n_nationkey").alias("x"))
    n = _table(spark, sf_dir, "nation").select("n_nationkey", a.alias("a"), b.alias("b"), c.alias("c"))
    kind = {x: n.schema[x].dataType for x in "abc"}
    return n.select("n_nationkey", structure.deep_equal(F.col("a"), F.col("b"), kind["a"], kind["b"]).alias("same"), structure.deep_equal(F.col("a"), F.col("c"), kind["a"], kind["c"]).alias("swapped"))


@_query(f"WITH {_CUSTOMERS} SELECT id AS row, id || '.' || k AS key, v AS value FROM c, LATERAL (VALUES ('id', id::VARCHAR), ('user.fullName', full_name), ('user.homeAddress.nationKey', nation::VARCHAR), ('user.marketSegment', segment), ('billing.accountBalance', regexp_replace(balance::VARCHAR, '\\.?0+$', '')), ('billing.apiToken', 's3cret')) t(k, v)")
def flatten_array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flatten_rows(_customers(spark, sf_dir), "id")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, CASE o_orderstatus WHEN 'F' THEN 'Done' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 2 = 1 THEN 'Yes' ELSE 'No' END AS odd, 'none' AS note FROM orders")
def transform_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 2 == 1).alias("odd"), F.lit(None).cast("string").alias("note"))
    return values.transform_values(o, {"year": {"type": "date", "pattern": "YYYY"}, "status": {"type": "enum", "names": {"F": "Done"}}, "odd": {"type": "boolean"}, "note": {"type": "default", "value": "none"}})[0]


@_query(_json_sql(f"{_NAME} || {_SEGMENT}", f"""',"billing":{{' || {_BALANCE} || '"apiToken":"s3cret"}}'"""))
def hide_nulls_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(filters.hide_if(_customers(spark, sf_dir), filters.is_null))


@_query(_json_sql("""',"user":{"fullName":"' || full_name || '"' || CASE WHEN nation = 0 THEN '' ELSE ',"homeAddress":{"nationKey":' || nation || '}' END""" + f" || {_NO_BLANK}", """',"billing":{' || CASE WHEN coalesce(balance, 0) = 0 THEN '' ELSE '"accountBalance":' || balance || ',' END || '"apiToken":"s3cret"}'""").replace("c_custkey AS id", "c_custkey + 1 AS id"))
def hide_falsy_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_json(filters.hide_if(_customers(spark, sf_dir).withColumn("id", F.col("id") + 1), filters.is_falsy))


@_query("SELECT 'Top' AS title, 2 AS n, count(*) AS docs FROM customer")
def merge_sections_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    parts = [sections.Sections(root_title="Top").fields(c.select("c_custkey", F.col(x).cast("string").alias(x)), ["c_custkey"]).where(F.col("c_custkey") == 1) for x in ("c_name", "c_mktsegment")]
    merged = sections.merge_sections(*parts)
    return merged.select("title", F.size("fields").alias("n")).crossJoin(F.broadcast(c.agg(F.count("*").alias("docs"))))  # one row


@_query(r"SELECT event_id, array_to_string(string_split(event_type || 'Item', ' '), ' ') AS words, length(event_type) > 0 AS some FROM events")
def key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.select("event_id", F.array_join(tokens_column(F.concat(F.col("event_type"), F.lit("Item"))), "").alias("words"), (F.size(tokens_column(F.col("event_type"))) > 0).alias("some"))
