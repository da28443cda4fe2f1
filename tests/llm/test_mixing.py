import re
from collections import Counter, defaultdict, namedtuple
from math import floor, isqrt

import pytest
from pyspark.sql import functions

from lattica.llm import mixing


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == pytest.approx({"a": 187.5, "b": 75, "c": 37.5})
    got = mixing.targets([("b", 1000), (None, 500), ("a", 10)])
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(1510) and got["b"] == pytest.approx(1480 * 2 / 3)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def sizes_of(docs):
    return [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]


def brute(rows):
    """Copies of each row (id, source, size, hash, order) by one prefix sum for each source."""
    by, out = defaultdict(list), {}
    for r in rows:
        by[r.source].append(r)
    goal = mixing.targets([(s, sum(r.n for r in x)) for s, x in by.items()])
    for s, x in by.items():
        total = sum(r.n for r in x)
        rate, crossed, upto = goal[s] / total if total else 0, floor(x[0].offset), x[0].offset
        for at, r in enumerate(sorted(x, key=lambda r: (r.n, r.bucket, r.mix, r.doc_id)), 1):
            upto = at * rate + r.offset
            out[r.doc_id] = floor(upto) - crossed
            crossed = floor(upto)
    return out, goal


def checked(docs):
    """Compares the copies of every document with the brute-force prefix sum, and the words with the targets."""
    F = functions
    rows = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("n"), F.xxhash64("text").alias("h")).withColumn("mix", F.xxhash64(F.lit(mixing.SEED), "doc_id", "n", "h")).collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    spark = docs.sparkSession
    offsets = [r[0] for r in spark.range(len(names)).orderBy("id").select(mixing._unit(F.lit(mixing.SEED), F.col("id").cast("int"))).collect()]
    size, bucket = Counter((r.source, r.n) for r in rows), max(mixing.LEAST_BUCKET, isqrt(len(rows)))
    Own = namedtuple("Own", "doc_id source n mix offset bucket")
    own = [Own(r.doc_id, r.source, r.n, r.mix, offsets[names.index(r.source)], r.mix % -(-size[r.source, r.n] // bucket)) for r in rows]
    want, goal = brute(own)
    got = mixing.mixed_sizes(docs).collect()
    assert {r.doc_id: r.copies for r in got} == want and len(got) == len(rows)
    source, taken = {r.doc_id: r.source for r in rows}, Counter()
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size and r.target == pytest.approx(goal[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s, target in goal.items():
        sizes = [r.n for r in rows if r.source == s]
        assert abs(taken[s] - target) <= max(sizes) + 1
    return got


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = checked(docs)
    want = {i: n for i, _, n in sizes_of(docs)}
    assert {r.doc_id: r.size for r in got} == want
    assert sorted(map(tuple, mixing.mixed_sizes(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_copies_cross_the_integers_once_each(spark, monkeypatch):
    """Whatever the buckets: many sizes, one hot size, a source without words and one whose target is capped."""
    monkeypatch.setattr(mixing, "LEAST_BUCKET", 20)
    rows = [(i, "w " * (1 + i % 50 if i % 4 else 7), ["s", "t", "u", None][min(i % 7, 3)] if i > 20 else "tiny") for i in range(3000)]
    rows += [(9000 + i, "" if i % 2 else None, "mute") for i in range(5)]
    checked(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mixed_rows_agree_with_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 AS size", "2 AS _k")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mixed_sizes(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in got.collect()) == want


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed_sizes(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b", None), (1, "a b", None), (None, None, None), (2, "", "x"), (3, "c", "x"), (None, "d e f", "")]
    got = mixing.mixed_sizes(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 2, 3]
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixed_sizes(spark.createDataFrame([(1, None, "a")], schema)).collect()[0].taken == 0
