import random

import numpy as np

from lattica.llm import packing


def test_best_fit_decreasing_against_linear_search():
    rnd = random.Random(1)
    for _ in range(100):
        length = rnd.choice([7, 16, 100])
        sizes = [rnd.randint(1, length) for _ in range(rnd.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= length for r in rows)
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [k for k, room in enumerate(rooms) if room >= s]
            k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
            if not fit:
                rooms.append(length)
            rooms[k] -= s
        assert sorted(rooms) == sorted(length - sum(sizes[i] for i in r) for r in rows)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (-4, "<|endoftext|> é\U0001f600")], docs.schema)
    docs = docs.union(extra)
    rows = packing.packed(docs, length=512, block=20000).collect()
    assert len({(r.part, r.row) for r in rows}) == len(rows)
    for r in rows:
        assert len(r.ids) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 512
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.pieces) == len(r.position_resets)
    got = dict(packing.unpacked(rows))
    encode = packing.encoder(packing.VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for k, pieces in got.items():
        assert sum(pieces, []) == [*encode(texts[k]), packing.END_TOKEN]
        assert all(len(p) == 512 for p in pieces[:-1])
    assert sum(r.n_tokens for r in rows) > 0.95 * 512 * len(rows)


def test_long_runs_of_blanks(spark):
    """Runs encoded as one piece give what the whole pattern gives, and a run too long for its matcher does no harm."""
    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        content = f.read()
    plain, runs = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=packing.ranks_of(content), special_tokens={}) for p in (packing.PATTERN, r"\s+"))
    rnd = random.Random(4)
    for limit in (2, 3, 7):
        encode = packing.whole_runs(plain.encode_ordinary, runs.encode_ordinary, limit)
        for _ in range(2000):
            text = "".join(rnd.choice(["a", "it's", "7", "!", "é"]) if rnd.random() < 0.3 else rnd.choice("  \n\t\r\x1c\x85\xa0\u2003\u3000\u200b") * rnd.randint(1, 9) for _ in range(rnd.randint(0, 8)))
            assert encode(text) == plain.encode_ordinary(text), repr(text)
    long = ["a" + " " * 2_000_000 + "b", "\n" * 1_500_000, "x" * 1_000_000 + "\t " * 700_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for doc, pieces in packing.unpacked(packing.packed(docs).collect()):
        *ids, end = sum(pieces, [])
        assert end == packing.END_TOKEN and plain.decode(ids) == long[doc]


def test_empty_and_repeated(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string, ids string")).count() == 0
    rows = packing.packed(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted(rows[0].doc_ids, key=str) == [1, 1, None]


def test_wide_ranks(spark, tmp_path):
    """A vocabulary with ranks beyond 16 bits is stored in 32, whatever the end token."""
    import base64

    lines = [base64.b64encode(bytes([i])) + b" " + str(i + (70_000 if i >= 97 else 0)).encode() for i in range(256)]
    (tmp_path / "v.tiktoken").write_bytes(b"\n".join(lines))
    docs = spark.createDataFrame([(1, "ab Z")], "doc_id long, text string")
    (row,) = packing.packed(docs, length=8, vocabulary=str(tmp_path / "v.tiktoken"), end=300).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [70_097, 70_098, 32, 90, 300, 300, 300, 300]
