"""Archive, raking, search, and the pipeline."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.inner_topk import InnerProductTopK
from docloom.llm import raking
from docloom.llm.raking import Raking, topic_of
from docloom.llm.storage import Scratch
from docloom.llm.warc_store import WarcArchive, round_trip


def test_archive(spark):
    big, other = "é" * 600, "y" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", "x" * 200_000), (9, "u", "x" * 200_000), (None, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {}
    for r in round_trip(spark, pages).collect():
        got.setdefault(r["page_id"], r)
    assert round_trip(spark, pages).count() == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None), None: ("revisit", 8)}
    archive = WarcArchive(Scratch(spark, "t")).write(pages)
    assert archive.payloads().count() == 5
    for r in archive.records().select("head", "payload", WarcArchive.warc_bytes().alias("warc")).collect():
        head = bytes(r["head"]).decode()
        size = int(re.search(r"\r\nContent-Length: (\d+)\r\n\r\nHTTP", head)[1])
        body = bytes(r["warc"])[head.index("\r\n\r\n") + 4 : -4] if head.isascii() else None
        assert head.startswith("WARC/1.1\r\nWARC-Type: ") and (body is None or len(body) == size)
    assert round_trip(spark, pages.where("page_id > 99")).count() == 0


def test_records_are_parsed_from_bytes(spark):
    """Whole records come back by their own lengths, whatever bytes they hold; cut or longer ones stop the query."""
    from docloom.llm.warc_store import parse_records

    pages = spark.createDataFrame([(1, "http://a/é b", "one\r\n\r\ntwo é"), (2, None, "")], "page_id long, url string, html string")
    made = WarcArchive(Scratch(spark, "t")).write(pages).records().select("page_id", "payload", WarcArchive.warc_bytes().alias("record"))
    got = {r["page_id"]: r for r in parse_records(made, "record").collect()}
    assert bytes(got[1]["body"]).decode() == "one\r\n\r\ntwo é" and bytes(got[2]["body"]) == b""
    assert "WARC-Target-URI: http://a/é%20b\r\n" in got[1]["head"]
    for broken in (F.substring("record", 1, 300), F.concat("record", F.lit(b"x")), F.lit(b"")):
        with pytest.raises(Exception, match="damaged record"):
            parse_records(made.withColumn("record", broken), "record").collect()


def test_damage_is_seen(spark, tmp_path):
    scratch = Scratch(spark, "t")
    archive = WarcArchive(scratch).write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    bad = scratch.read("payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(bad, scratch.read("payloads").schema).write.mode("overwrite").parquet(scratch.path("payloads"))
    with pytest.raises(Exception, match="damaged"):
        archive.records().collect()


def test_topk(spark):
    r = np.random.default_rng(7)
    rows = [(i, (r.normal(size=12) * r.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(700, 760)] + [(800, None), (810, [1.0, None]), (820, [float("nan")] * 12), (830, [float("inf")] * 12), (840, [1.0, 2.0]), (850, []), (None, rows[0][1])]
    rows += [rows[3], rows[10]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    ok = {i: np.pad(np.floor(np.array(x, np.float64) * 1024), (0, 12 - len(x))) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    want = set()
    for q in ok:
        if q % 10 == 0:
            best = sorted((-int(ok[q] @ ok[v]), v) for v in ok if v != q)[:10]
            want |= {(q, k, v, -s) for k, (s, v) in enumerate(best, 1)}
    search = InnerProductTopK(k=10, every=10, block=64, query_block=16, seeds=50, lead=4)
    assert {tuple(x) for x in search.search(df).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert search.search(df.where("vec_id > 9999")).count() == 0
    assert search.search(df.where("vec_id in (10, 20, 30)")).count() == 6


def test_topk_passes_over_blocks(spark, monkeypatch):
    """Short vectors' blocks meet no query once the long ones have set the floors; results are those of all pairs."""
    from docloom.llm import inner_topk

    r = np.random.default_rng(3)
    x = r.integers(-50, 50, (600, 6))
    x[:40] *= 40
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scratch = Scratch(spark, "t")
    monkeypatch.setattr(scratch, "keep", lambda *names: None)
    got = InnerProductTopK(k=3, every=50, scale=1, block=16, query_block=4, seeds=4, lead=2).search(df, scratch).collect()
    want = set()
    for q in range(0, 600, 50):
        best = sorted((-int(x[q] @ x[v]), v) for v in range(600) if v != q)[:3]
        want |= {(q, k, v, -s) for k, (s, v) in enumerate(best, 1)}
    assert {tuple(g) for g in got} == want
    names = [n for n in scratch._schemas if n.startswith("pairs-")]
    met = sum(scratch.read(n).count() for n in names)
    assert len(names) == 3 and met < scratch.read("blocks").count() * scratch.read("queries-0").count() / 2


def test_raking_meets_targets(spark, docs, empty):
    rows = [(i, "word " * (1 + i % 7), ("en", "de", None)[i % 3], ("big", "s1", "s2")[0 if i % 5 < 3 else i % 2 + 1], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tokens", F.lit("clash"))
    want = {"source": {"big": 0.4, "s1": 0.3, "s2": 0.3, "absent": 5.0}, "lang": {"en": 0.4, "de": 0.3, "(null)": 0.3}}
    rake = Raking(fraction=0.2, targets=want)
    scratch = Scratch(spark, "t")
    out = rake.draw(df, scratch).toPandas()
    cells = out.assign(lang=out.lang.fillna("(null)")).groupby(["source", "lang", "topic"]).agg(tokens=("tokens", "sum"), p=("probability", "first")).reset_index()
    # brute force on the cells: nothing is exhausted, so plain raking
    x = cells.tokens.to_numpy(float)
    topic = cells.groupby("topic").tokens.sum() ** 0.5
    goals = [("source", {"big": 0.4, "s1": 0.3, "s2": 0.3}), ("lang", want["lang"]), ("topic", (topic / topic.sum()).to_dict())]
    for _ in range(300):
        for col, goal in goals:
            for k, g in goal.items():
                at = (cells[col] == k).to_numpy()
                x[at] *= 0.2 * cells.tokens.sum() * g / x[at].sum()
    assert (x < cells.tokens).all()
    assert (cells.tokens * cells.p).to_numpy() == pytest.approx(x, rel=1e-4)
    told = rake.margins(scratch).toPandas()
    assert told.expected.to_numpy() == pytest.approx(told.target.to_numpy(), rel=1e-5)
    assert (out.tokens * out.probability).sum() == pytest.approx(0.2 * out.tokens.sum(), rel=1e-6)
    got = (out.tokens * out.probability).groupby(out.source).sum()
    assert (got / got.sum())["big"] == pytest.approx(0.4 / 1.0, abs=0.02)
    assert abs(out.sampled.mean() - out.probability.mean()) < 0.03
    plan = rake.draw(df.limit(9))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rake.draw(empty).count() == 0
    drawn = Raking(rounds=2).draw(docs)
    assert drawn.count() == docs.count() and drawn.where("tokens = 0 and sampled").count() == 0 and set(drawn.columns) == set(docs.columns) | {"tokens", "topic", "probability", "sampled"}


def test_raking_where_cells_are_exhausted(spark):
    """A source with less than its share gives all it has, cells that are full are raked around, and a topic column is used."""
    rows = [(i, "w " * 5, "en" if i % 4 else "de", "rare" if i < 30 else ("a", "b")[i % 2], "t1" if i % 3 else None) for i in range(1200)] + [(None, "x y", "en", "a", "t1"), (None, "z", "xx", "a", "t1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    rake = Raking(fraction=0.5, targets={"source": {"rare": 0.4, "a": 0.3, "b": 0.3}, "lang": {"en": 0.6, "de": 0.4}}, topic="topic", rounds=60)
    scratch = Scratch(spark, "t")
    out = rake.draw(df, scratch).toPandas()
    assert (out[out.source == "rare"].probability > 0.99).all() and (out[out.lang == "xx"].probability == 0).all()
    told = rake.margins(scratch).toPandas()
    assert told.expected.to_numpy() == pytest.approx(told.target.to_numpy(), rel=1e-3)
    budget = 0.5 * out.tokens.sum()
    assert told.groupby("margin").target.sum().to_numpy() == pytest.approx([budget] * 3, rel=1e-6)
    side = told.set_index("name").target
    assert side["rare"] == 150 and side["a"] == pytest.approx(side["b"]) and set(out.topic) == {"t1", "(null)"}
    assert (out.tokens * out.probability).sum() == pytest.approx(budget, rel=1e-2) and len(out) == len(rows)


def test_factors_kept_or_joined_agree(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 5), ("en", "de")[i % 4 == 0], ("a", "b", "c")[i % 3], f"t{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    rake, got = Raking(fraction=0.4, targets={"source": {"a": 0.6, "b": 0.2, "c": 0.2}}, topic="topic", rounds=3), []
    for names in (1000, 0):
        monkeypatch.setattr(raking, "NAMES", names)
        got.append({r["doc_id"]: r["probability"] for r in rake.draw(df).collect()})
    assert got[0] == pytest.approx(got[1], rel=1e-9) and len(set(got[0].values())) > 4


def test_topics(spark):
    rows = [("",), ("a | b | c | d",), ("x** y&& z##",), ("LOUD WORDS",), ("short note",), ("long prose " * 60,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(topic_of(F.col("t"))).collect()]
    assert got == ["empty", "tables", "marks", "capitals", "notes", "prose"]


def test_pipeline(spark, docs, documents, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    leak = "The benchmark asks which of the seventeen lighthouses was painted blue in the year of the great storm."
    extra = spark.createDataFrame([(7001, f"some leading words {leak} and trailing words", "en", "s", 1), (7002, 'the of and to in is token = "04debebab91ab85687d33eeaaf9ac699e1188f962" the of', "en", "s", 1)], base.schema)
    folder = str(tmp_path)
    base.union(extra).union(extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, sizes = spark.read.parquet(f"{folder}/documents.parquet"), {}
    scratch = Scratch(spark, "t")
    for name, stage in pipeline.STAGES:
        before, at = at, scratch.write(stage(spark, at, folder), name)
        sizes[name] = at.count()
        if name != "mix":
            assert at.columns == before.columns
        if name == "near_duplicates":
            ids = {r["doc_id"] for r in at.collect()}
            assert 100 not in ids and 10 in ids and 450 not in ids
            assert at.count() == at.select("doc_id").distinct().count()  # a repeated row stays once
        if name == "decontaminate":
            assert at.where("doc_id = 7001").count() == 0 and before.count() - sizes[name] == 1  # its copy went before
        if name == "hide_secrets":
            row = at.where("doc_id = 7002").first()
            assert "[SECRET]" in row["text"] and row["n_chars"] == len(row["text"]) and sizes[name] == before.count()
    assert sizes["language_id"] < base.count() + 4 and 0 < sizes["mix"] < sizes["hide_secrets"]
    nothing = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0").withColumn("h", F.lit(1))
    for name, stage in pipeline.STAGES:
        out = stage(spark, nothing, folder)
        assert out.count() == 0 and (name == "mix" or out.columns == nothing.columns)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "hide_secrets", "mix"]


def test_queries_against_sql(spark):
    from docloom.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in SQL.items():
        df = QUERIES[name](spark, folder)
        cols = sorted(df.columns)
        want = con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
