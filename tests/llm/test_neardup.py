import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import neardup


def brute_classes(texts):
    """Components of the pairs that share a shingle and are similar by weight, over all pairs."""
    bags = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter())
    df = Counter(s for b in bags for s in b)
    n = len(texts)
    idf = lambda s: 0.9 + 0.1 * np.log(n / df[s]) / np.log(1000) if df[s] > max(1, n / 1000) else 1.0
    bags = [{s: (1 + np.log(c)) * idf(s) for s, c in b.items()} for b in bags]
    by = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            by[s].append(i)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = {}
    for i, t in enumerate(texts):
        if bags[i]:
            parent[root(i)] = root(first.setdefault(t, i))
    reps = [i for i in range(n) if bags[i] and first[texts[i]] == i]
    for i in reps:
        for j in {j for s in bags[i] for j in by[s] if j < i and first.get(texts[j]) == j}:
            a, b = bags[i], bags[j]
            common = a.keys() & b.keys()
            least = sum(min(a[s], b[s]) for s in common)
            weighted = least / (sum(a.values()) + sum(b.values()) - least)
            if weighted >= 0.8:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, k int").repartition(3)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()}
    want = brute_classes(texts)
    assert len(got) == len(texts)
    assert {i: x for i, x in got.items() if want[i] != x} == {}
    kept = neardup.unique(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


@pytest.mark.parametrize("size", [60, 20_000, 100_000])
def test_sampler_estimates_weighted_jaccard(size):
    rnd = np.random.default_rng(size)
    draw = neardup.Sampler(samples=1500, seed=5)
    ids = np.unique(rnd.integers(0, 1 << 48, size, dtype=np.uint64))
    wa = rnd.choice([0.5, 1, 1, 1, 2, 3.5], size)
    wb = np.where(rnd.random(size) < 0.3, rnd.choice([0.5, 1, 2], size), wa)
    wa[: size // 6] = 0
    a = draw(ids[wa > 0], wa[wa > 0], np.array([0]))[0]
    b = draw(ids[wb > 0], wb[wb > 0], np.array([0]))[0]
    assert (a == b).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)


def test_made_up_texts(spark):
    rnd = random.Random(9)
    prose = lambda n: [f"w{rnd.randint(0, 5000)}é" for _ in range(n)]
    texts = [None, "", " ", "", "one two", "one  two", "one two three", "a " * 50, "a " * 51]
    for _ in range(4):
        a = prose(rnd.randint(60, 300))
        for _ in range(rnd.randint(1, 25)):
            b = list(a)
            for _ in range(rnd.randint(0, 2)):
                b[rnd.randrange(len(b))] = f"x{rnd.random()}"
            texts.append(" ".join(b))
    passage = prose(40)
    texts += [" ".join(prose(25) + passage + prose(25)) for _ in range(12)] + [" ".join(passage)]
    check(spark, texts)


def test_table(spark):
    check(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()])


def test_common_shingles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CANDIDATES", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids, idf = neardup.common_shingles(docs, "text", share=0.02)
    seen = Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        seen.update({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    want = [c for c in seen.values() if c > 4]
    assert len(ids) == len(want)
    assert sorted(idf) == pytest.approx(sorted(0.9 + 0.1 * np.log(200 / np.array(want)) / np.log(50)))


def test_common_shingles_in_sorted_blocks(spark, monkeypatch):
    """Copies that lie side by side are proposed by their blocks but are no candidates unless they are common."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 100)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1)
    monkeypatch.setattr(neardup, "PARTITION_DOCS", 100)
    asked = []
    keep = neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name: asked.append(keep(df, name)) or asked[-1])
    rows = [(i, " ".join(f"h{i // 20}-{j}" for j in range(20)) + (" every one of these has it" if i % 4 == 0 else f" e{i} f{i}")) for i in range(1000)]
    ids, _ = neardup.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"), "text", share=0.05)
    assert len(ids) == 2 and asked[0].count() <= 20


def test_ties_in_other_columns(spark):
    rows = [(7, "one two three four five six", x) for x in "abcdefgh"] + [(8, "one two three four five six", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = {tuple(neardup.unique(docs.repartition(n)).collect()[0]) for n in (1, 2, 5)}
    assert len(first) == 1 and first.pop()[0] == 7


def test_empty_and_null_ids(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.unique(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "x")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5, 3, 3), (5, 5, 3, 3), (None, 5, 3, 3), (None, None, 1, 1)]
    assert sorted(map(tuple, neardup.unique(docs).collect()), key=str) == [(5, "a b c"), (None, "x")]


def test_long_texts_with_equal_short_ids(spark):
    """Ids of 32 bits collide within texts of very many shingles."""
    rnd = random.Random(8)
    a = [str(rnd.random()) for _ in range(200_000)]
    b = list(a)
    b[5] = b[77_777] = "x"
    docs = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b))], "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == [(0, 0, 2, 200_000), (1, 0, 2, 200_000)]


def hot_group(texts=2000, pairs=100):
    """Texts that share a large template, below the threshold, and copies above it of some; the classes."""
    template, out = " ".join(f"t{i}" for i in range(92)), []
    for i in range(texts):
        own = [f"u{i}-{j}" for j in range(13)]
        out.append((i, " ".join([template, *own])))
        if i < pairs:
            out.append((i, " ".join([template, *own[:5], *(f"e{i}-{j}" for j in range(8))])))
    random.Random(21).shuffle(out)
    groups = defaultdict(list)
    for at, (i, _) in enumerate(out):
        groups[i].append(at)
    return [t for _, t in out], {at: (min(g), len(g)) for g in groups.values() for at in g}


def test_pairs_in_hot_buckets(spark):
    texts, want = hot_group()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()}
    assert {i: x for i, x in got.items() if want[i] != x} == {}


def test_pairs_that_meet_in_one_band(spark):
    """The leader of their only common band, the last, resembles neither."""
    key = lambda i: bytes([i]) * 16
    bands = {i: [100 * i + b for b in range(16)] for i in (1, 2, 3, 4)}
    for i in (1, 2, 3):
        bands[i][15] = 7
    bands[1][0] = bands[4][0] = 8
    ids = {1: range(0, 50), 2: range(100, 150), 3: range(101, 151), 4: range(200, 250)}
    vectors = [(key(i), np.array(x, np.uint32).tobytes(), np.ones(50, np.float32).tobytes()) for i, x in ids.items()]
    texts = spark.createDataFrame([(key(i), b) for i, b in bands.items()], "k binary, bands array<long>")
    linked = neardup._linked(texts, lambda _: spark.createDataFrame(vectors, "k binary, ids binary, weights binary"))
    assert {bytes(r.k)[0]: bytes(r.c)[0] for r in linked.collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_every_repeated_shingle_is_counted(spark, monkeypatch):
    """Common or not, in blocks and pieces however small; copies count."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 5000)
    monkeypatch.setattr(neardup, "SMALL_PIECE_BYTES", 1 << 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.orderBy("doc_id").limit(3)).unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"), allowMissingColumns=True)
    known = neardup.frequencies(docs.repartition(3), "text", share=0.02)
    rows = [(r.p, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.select("text", known.piece(docs.text).alias("p")).collect()]
    bags = [(p, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()) for p, w in rows]
    seen = Counter(s for _, b in bags for s in b)
    assert known.n == len(bags) == 204 and known.pieces > 1
    assert sorted(known.common[1]) == sorted(c for c in seen.values() if c > 0.02 * 204)
    got, want = defaultdict(list), defaultdict(set)
    for r in known.rest.collect():
        got[r.piece] += np.frombuffer(bytes(r.seen), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel().tolist()
    for p, b in bags:
        want[p] |= {s for s in b if 1 < seen[s] <= 0.02 * 204}
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(seen[s] for s in x) for p, x in want.items() if x}


def test_shingles_of_few_documents_weigh_by_their_number(spark):
    """Of 3,000 documents two or three are far below the share that is common. Pairs at a plain similarity of 0.8 that
    share what two have are below it; those at 0.7996 that differ in what three have are above."""
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [text("a", 44) + " " + text("x", 5), text("a", 44) + " " + text("y", 5)]
    thrice = [text("p", 50), text("q", 50)]
    rows += [f"{text('b', 403)} {t}" for t in thrice]
    rows += [f"{text(f'{t[0]}{i}-', 200)} {t}" for t in thrice for i in range(2)]
    rows += [text(f"r{i}-", 12) for i in range(3000 - len(rows))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: 2 if i == 3 else i for i in range(3000)}


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_"))


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    """Whether or not the JVM collects its garbage."""
    left, keep = [], neardup.stored

    def stored(df, name):
        before, out = shuffled_bytes(spark), keep(df, name)
        for _ in range(20):  # they are deleted in the background
            if shuffled_bytes(spark) <= before:
                return out
            time.sleep(0.1)
        left.append(name)
        return out

    monkeypatch.setattr(neardup, "stored", stored)
    neardup.unique(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert left == []


def test_unique_shuffles_texts_once(spark):
    """For the first of each class; texts without words stay where they are."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "\t\x0b \r\n\f", " a\x1fb", "\xa0", "\xa0", "\x1c", "a b c"])], "doc_id long, text string")
    kept = neardup.unique(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
