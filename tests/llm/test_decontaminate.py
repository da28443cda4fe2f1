import hashlib
import random
import re

import pytest
from pyspark.sql import functions

from lattica.llm import decontaminate

from .oracle import compare

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(t):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(texts, items, size=10):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    prose = lambda n: [f"w{rnd.randint(0, 30)}" for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(0, 25)))) for i in range(12)] + [(20, None), (21, "École é"), (22, "one"), (None, "null item words here"), (23, "a a a a a a a a a a a")]
    texts = [None, "", "école É ÉCOLE É", "École,é", "ONE one", "null-item WORDS here", "a " * 30, "K one", " ".join(prose(3000))]
    for _, t in items[:12]:
        w = t.split()
        texts.append(" ".join(prose(5) + w + prose(5)).upper())
        texts.append("; ".join(w[1:12] + prose(3) + w[:9]))
    texts += texts[-2:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, x in enumerate(want) if not x[-1]]


@pytest.mark.parametrize("limits", [{"LITERALS": 300}, {"LITERALS": 300, "BROADCAST_WINDOWS": 500}, {"BROADCAST_WINDOWS": 1}])
def test_large_benchmarks_give_the_same(spark, monkeypatch, limits):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    if limits.get("BROADCAST_WINDOWS") == 1:
        items = items.where("item_id < 40").orderBy(functions.length("text")).limit(2)
        whole = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect())) == whole


def test_hot_words_and_long_texts(spark):
    """A one-word item that is every other word of a long text, and of many texts."""
    items = [(1, "the"), (2, "a b"), (3, " ".join(["the"] * 12))]
    texts = ["the x " * 20_000, "the " * 5000, *(["the a b the"] * 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in rows}
    assert got[0] == (40_000, 20_000, 1) and got[1] == (5000, 5000, 2) and got[2] == got[301] == (4, 4, 2)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = compare(decontaminate.op5_decontaminate(spark, sf), decontaminate.OP5_SQL, sf)
    assert any(r[0] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).collect()[0].n_hit == 0
    assert decontaminate.clean(docs, none).count() == 1
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
