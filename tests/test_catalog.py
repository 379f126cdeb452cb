"""Every catalog query against its SQL on the smallest tables, and streams."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.plans.catalog import QUERIES, SQL
from docloom.streaming import documents as streams

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def shown(v):
    if v is None or v != v:
        return "~"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert cols == sorted(rel.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(shown(x) for x in r) for r in duck.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({SQL[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{DATA}/events.parquet").repartition(2).write.parquet(str(src))
    events = streams.stream_table(spark, str(src), spark.read.parquet(str(src)).schema)
    nodes = streams.stream_nodes(events, "props", ["event_id"], 1)
    streams.run_once(nodes.select("event_id", "path", "txt"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 1000 and out.where(F.col("path") == "k").count() == 1000
