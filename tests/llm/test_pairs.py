"""Jaccard join and decontamination against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import jaccard_join as jj
from docloom.llm.components import components
from docloom.llm.decontaminate import Decontaminator, fold, locate, window_edits
from docloom.llm.storage import Scratch

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(docs, documents, k, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.JaccardJoin(k, num, 100).classes(docs).collect()}
    assert got == classes([(r[0], r[1]) for r in documents], k, num, 100)


def test_blocks_find_what_lists_find(docs, documents, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    monkeypatch.setattr(jj, "LISTED", 2)
    got = {r["doc_id"]: r["component_id"] for r in jj.JaccardJoin(3, 90, 100).classes(docs).collect()}
    assert got == {i: c for i, (_, c) in classes([(r[0], r[1]) for r in documents], 3, 90, 100).items()}


def test_blocks_give_links_and_not_pairs(spark, monkeypatch):
    """Forty texts that nearly link with each of forty linked ones: rows follow the texts, not their pairs."""
    rows = []
    for i in range(80):
        w, r = [f"w{k}" for k in range(200)], random.Random(i)
        for k in r.sample(range(5, 195), 2 if i % 2 else 3):
            w[k] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    made, write = {}, Scratch.write

    def counted(self, df, name, *more, **named):
        out = write(self, df, name, *more, **named)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jj, "LISTED", 2)
    monkeypatch.setattr(Scratch, "write", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.JaccardJoin(5, 80, 100).classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows, 5, 80, 100)
    assert made["tested-3"] + made.get("block-links", 0) < len(rows)


def test_join_of_nested_sets(spark):
    """The largest id meets a smaller hub that it does not link with; its link shares pieces with it alone."""
    rows = []
    for f in range(12):
        w = [f"f{f}w{i}" for i in range(112)]
        rows += [(3 * f + k, " ".join(w[: n + 2])) for k, n in ((1, 85), (2, 110), (3, 100))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.JaccardJoin(3, 90, 100).classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows, 3, 90, 100) and got[3] == (100, 2)


def test_split_pieces_lose_nothing(docs, documents, monkeypatch):
    """Pieces of more than a few members are regrouped by a further cut."""
    monkeypatch.setattr(jj, "SPLIT", 3)
    monkeypatch.setattr(jj, "LISTED", 2)
    monkeypatch.setattr(jj, "LEVELS", 1)
    monkeypatch.setattr(jj, "GAIN", 0.0)
    got = {r["doc_id"]: r["component_id"] for r in jj.JaccardJoin(5, 80, 100).classes(docs).collect()}
    assert got == {i: c for i, (_, c) in classes([(r[0], r[1]) for r in documents], 5, 80, 100).items()}


@pytest.mark.parametrize("seed", range(2))
def test_join_of_shared_passages(spark, seed):
    """Random texts, many with one passage, some nested, some edited: pieces are shared by chance."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    rows, k = [], 0
    for i in range(50):
        w = [f"v{r.randrange(9)}" for _ in range(r.randrange(4, 90))]
        for _ in range(r.randrange(1, 5)):
            x = list(w)
            for _ in range(r.randrange(0, 4)):
                x[r.randrange(len(x))] = f"e{r.randrange(99)}"
            x = x[: len(x) - r.randrange(0, 1 + len(x) // 12)]
            if r.random() < 0.4:
                x = [*x, passage]
            rows.append((k, " ".join(x)))
            k += 1
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, num in ((3, 90), (2, 60)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jj.JaccardJoin(width, num, 100).classes(df).collect()}
        assert got == classes(rows, width, num, 100)


def test_folded_sketches_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 2000, int(r.integers(1, 1500))).astype(np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(jj._sketch(jj.mix(s)), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        assert int(np.bitwise_count(jj._folded(x, w) ^ jj._folded(y, w)).sum()) <= len(np.setxor1d(a, b))


def test_lookup_splits_hot_keys(spark, monkeypatch):
    from docloom.llm import lookups

    monkeypatch.setattr(lookups, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(200)], "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k2", 3)], "k string, v int")
    want = sorted(map(str, rows.join(table, "k", "left").select("i", "k", "v").collect()))
    for most in (1 << 20, 0):
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", most)
        assert sorted(map(str, lookups.lookup(rows, table, ["k"], 10, "left").select("i", "k", "v").collect())) == want


def test_join_of_nothing(empty):
    assert jj.JaccardJoin().classes(empty).count() == 0


def test_linked_sets_share_a_key():
    """The pigeonhole argument, over random pairs at and above the threshold."""
    import numpy as np

    r = np.random.default_rng(5)
    for num in (80, 90):
        t = jj.Threshold(num, 100)
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            cut = int(r.integers(0, t.difference(len(a)) + 1))
            gone = int(r.integers(0, cut + 1))
            b = np.unique(np.concatenate([a[: len(a) - gone], r.integers(0, 2**63, cut - gone).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common and t.linked(len(a), len(b), common):
                assert len(np.intersect1d(jj._keys(a, t), jj._keys(b, t)))


def test_sketch_distance_bounds_difference():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 300, 200).astype(np.uint64)) for _ in range(2))
        x, y = (jj._words(s, 16, 0)[0] for s in (jj.mix(a), jj.mix(b)))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["vertex"]: r["component"] for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def edits_within(a, b):
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_locate():
    import numpy as np

    r = random.Random(4)
    array = lambda x: np.frombuffer(x, np.uint8)
    for _ in range(300):
        a = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12)))
        b = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 14)))
        cost, lo, hi = locate(array(a), array(b), -20, 20, 5)
        want = edits_within(a, b)
        assert cost == min(want, 6)
        if cost < 6:  # the piece told is one of that many edits
            row = list(range(hi - lo + 1))
            for i, c in enumerate(a, 1):
                new = [i]
                for j, d in enumerate(b[lo:hi], 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
                row = new
            assert row[-1] == cost


def test_leaks_equal_brute_force(monkeypatch):
    """Random texts side by side, with pieces of items in them, whole, cut, edited and run over by repeats: every window against every text."""
    from docloom.llm import decontaminate
    from docloom.llm.decontaminate import _Index

    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    r = random.Random(21)
    some = lambda n, of=b"abcdefgh ": bytes(r.choice(of) for _ in range(n))
    items = [(1, some(60)), (2, some(45)), (3, b"z" * 50), (4, (b"xyxy" * 20)[:64])]
    d = Decontaminator(q=8, window=30, rate=0.07)
    index = _Index.build(items, 8)
    texts = []
    for i in range(60):
        _, item = items[r.randrange(4)]
        n = r.randrange(20, 46)
        s = r.randrange(0, max(1, len(item) - n))
        piece = bytearray(item[s : s + n])
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(len(piece))
            piece[at : at + r.randrange(2)] = some(r.randrange(2))
        texts.append(some(r.randrange(0, 50)) + bytes(piece) + some(r.randrange(0, 50)))
    texts += [b"", b"z" * 3000, b"xy" * 900, b" ".join(texts[:3])]
    for text, found in zip(texts, d._leaks(texts, index), strict=True):
        plain = fold(text)[0].tobytes()
        want = {}
        for it, t in enumerate(index.texts):
            best = min(edits_within(t[s : s + 30], plain) for s in range(len(t) - 29))
            if best <= 2:
                want[it] = best
        assert {x[0] for x in found} == set(want)
        for it, edits, lo, hi in found:
            inner = fold(b"#" + text[lo:hi] + b"#")[0].tobytes()[1:-1]  # blanks at the ends count
            assert edits <= 2 and min(edits_within(index.texts[it][s : s + 30], inner) for s in range(len(index.texts[it]) - 29)) <= 2


def test_decontaminate(spark, docs, documents, empty):
    item = "A rather particular question about forty-two green lanterns, whose answer nobody at the harbour could recall before noon."
    short = "tiny item"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, short), (5, "Another wholly different benchmark passage, never planted anywhere at all in these texts.")], "item_id long, text string")
    near = item.replace("green", "grean").replace("harbour", "harbor").upper()
    part = item[:90]
    planted = [(900, f"before. {item} after", "en", "s", 1), (901, "x " * 3000 + near + " y" * 3000, "en", "s", 1), (902, part, "en", "s", 1), (903, item.replace(" ", "  \n"), None, None, None), (904, "about forty-two green lanterns", "en", "s", 1)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(planted, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    d = Decontaminator()
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(both, items).collect()}
    assert got == {(900, 1), (901, 1), (902, 1), (903, 1)}
    assert d.clean(both, items).count() == len(documents) + 1 + 1
    assert d.clean(both, items.where("item_id > 99")).count() == both.count()
    assert d.leaks(empty, items).count() == 0 and d.clean(docs, items).columns == docs.columns


def test_window_edits():
    import numpy as np

    r = random.Random(9)
    for _ in range(100):
        item, text = (bytes(r.choice(b"ab") for _ in range(n)) for n in (r.randrange(6, 20), r.randrange(0, 20)))
        got = window_edits(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), np.arange(len(item) - 5), 6, -40, 40, 3)
        assert got.tolist() == [min(edits_within(item[s : s + 6], text), 4) for s in range(len(item) - 5)]


def test_passages_begin_anywhere():
    """Every 80 bytes of an item, as they are and with five edits, and 74 that are none."""
    from docloom.llm.decontaminate import _Index

    r = random.Random(11)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)).encode()
    index, other = _Index.build([(1, item)], 10), b"0123456789 " * 9
    for change in (0, 5):
        texts = []
        for s in range(121):
            part = bytearray(item[s : s + 80])
            for at in range(change):
                part[16 * at + 8] = 48
            texts.append(other + bytes(part) + other)
        found = Decontaminator()._leaks(texts, index)
        assert [[x[:2] for x in f] for f in found] == [[(0, change)]] * 121
    assert Decontaminator()._leaks([other + item[33:107] + other], index) == [[]]


def test_neighbours_do_not_hide_a_leak():
    """A document that begins with the middle of an item, behind one that shares a chance gram on the same diagonals."""
    from docloom.llm.decontaminate import _Index

    r = random.Random(12)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)).encode()
    index, leak = _Index.build([(1, item)], 10), item[150:260] + b" 0123456789"
    # the gap of 18 bytes counts: on the leak's diagonal stands, so far before it, what the item has there
    chance = b"0123456789 " * 4 + item[150 - 18 - 20 : 150 - 18 - 10] + b"#" * 10
    alone = Decontaminator()._leaks([leak], index)[0]
    assert alone and Decontaminator()._leaks([chance, leak], index) == [[], alone]


def test_many_item_blocks(spark, docs, monkeypatch):
    from docloom.llm import decontaminate

    items = docs.where("doc_id between 10 and 13").select(F.col("doc_id").alias("item_id"), "text")
    want = {tuple(r) for r in Decontaminator().leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert {tuple(r) for r in Decontaminator().leaks(docs, items).collect()} == want and want
    few = Decontaminator().clean(docs, items)
    assert few.columns == docs.columns and few.count() == docs.count() - docs.join(spark.createDataFrame([(x[0],) for x in want], "doc_id long").distinct(), "doc_id").count()


def test_fold():
    assert fold(b"  A\t\n b ")[0].tobytes() == b"a b" and len(fold(b"")[0]) == 0
