import hashlib
import random
import re
from collections import Counter

from lattica.llm import substrings


def brute(texts, window=35):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def check(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.deduplicated(docs, **more).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, x in enumerate(want):
        assert got[i] == x, (i, got[i], x)


def test_made_up_texts(spark):
    rnd = random.Random(3)
    prose = lambda n: [f"w{rnd.randint(0, 400)}é" for _ in range(n)]
    a, passage, edge = prose(200), prose(50), prose(35)
    texts = [None, "", " \n", "short text", " ".join(a), "\n".join(a), " ".join(a)]
    for _ in range(12):
        near = list(a)
        for _ in range(rnd.randint(1, 5)):
            near[rnd.randrange(len(near))] = f"x{rnd.random()}"
        texts.append(" ".join(near))
        texts.append(" ".join(prose(rnd.randint(0, 60)) + passage + prose(rnd.randint(0, 60))))
    texts += [" ".join(edge), " ".join(prose(3) + edge + prose(2)), " ".join(edge[:-1]), " ".join(prose(30) * 4), "same " * 80, "same " * 34, " ".join(a[40:120]), "short text"]
    texts += [" ".join(prose(100)) for _ in range(3)] + ["  " + " ".join(a[:60]) + "\t"]
    check(spark, texts)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    check(spark, [r.text for r in rows])


def test_runs_are_merged_and_empty(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    contents = substrings._contents(docs, "text", 35, 8)
    index = substrings.FingerprintIndex(spark, fanout=2)
    for b in range(5):
        index.add(contents.where(f"pmod(k1, 5) = {b}"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    whole = substrings._occurrences(contents).groupBy("anchor", "whole").agg({"m": "sum"}).collect()
    again = substrings.FingerprintIndex(spark, index.path)
    assert again.levels == index.levels and again.buckets == index.buckets
    merged = again.compact()
    assert sorted((r.anchor, bytes(r.whole), r.n) for r in merged.collect()) == sorted((a, bytes(w), n) for a, w, n in whole)
    assert sum(map(len, again.levels)) == 1
    with substrings.settings(spark, substrings.BUCKETED):
        plan = merged.groupBy("anchor").count().join(merged, "anchor")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def incremental(batches, window=35):
    """Removal by brute force: windows that start in an earlier batch or anywhere else in the own one."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    past, out = Counter(), []
    for texts in batches:
        ws = [split(t) for t in texts]
        now = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
        for w in ws:
            gone = set()
            for i in range(len(w) - window + 1):
                if now[tuple(w[i : i + window])] > 1 or past[tuple(w[i : i + window])]:
                    gone.update(range(i, i + window))
            out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
        past += now
    return out


def test_batches_of_two_sessions(spark, tmp_path):
    rnd = random.Random(5)
    prose = lambda n: [f"w{rnd.randint(0, 300)}" for _ in range(n)]
    a, passage, other = prose(150), prose(50), prose(60)
    first = [" ".join(a), " ".join(prose(20) + passage + prose(20)), " ".join(prose(90)), None, " ".join(prose(5) + other)]
    second = [" ".join(a), " ".join(prose(30) + passage + prose(10)), " ".join(a[:70] + prose(40)), " ".join(prose(100)), "x", " ".join(prose(9) + other[:40])]
    third = [second[3], " ".join(second[2].split()[20:]), " ".join(prose(80)), " ".join(prose(80)), " ".join(["same"] * 50)]
    batches, got = [first, second, third, [third[2], third[2]]], []
    for i, texts in enumerate(batches):
        # each batch in a session of its own: the index is known by its path alone
        session = spark.newSession()
        for name in [t.name for t in session.catalog.listTables() if t.name.startswith("fingerprints_")]:
            session.sql(f"DROP TABLE {name}")
        docs = session.createDataFrame([(100 * i + j, t) for j, t in enumerate(texts)], "doc_id long, text string")
        index = substrings.FingerprintIndex(session, str(tmp_path / "index"))
        rows = substrings.deduplicate_batch(docs, index).collect()
        got += [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == incremental(batches)
