import re
from collections import Counter

from lattica.llm import quality

WORD = r"[^\x20\x09-\x0D]+"

TEXTS = [
    None, "", " \n\t ", "one", "a b a b a b a b", "x\nx\n\nx \nx", "é ü z ñ\nq\n", "a b c\n" * 40, "the cat sat. " * 30,
    "\n\nlead\nlead\n", "a#$ |b <c>\x0bd\x0ce\x1cf", "Ça va bien.\nÇa va bien.\nNon.", "\n", "w\n", "\nw", "a b c a b c d", "ab c\nab c",
    " ".join(f"word{i}" for i in range(300)) + ".",
]


def brute(text):
    text = text or ""
    ws = re.findall(WORD, text)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    hit = set()
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (3, "one", "x")], "doc_id long, text string, n_words string")
    got = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute("a b" if r.doc_id is None else TEXTS[r.doc_id])
        assert tuple(r)[1:7] == want, r.doc_id
        assert not (r.kept and r.base_failed)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(r.text)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    judged = [(x.quality, got[x.doc_id].kept) for x in labels if not got[x.doc_id].base_failed]
    assert sum(bool(q) == k for q, k in judged) >= 0.97 * len(judged)
    assert all(k for q, k in judged if q)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(docs).count() == 0
    assert quality.filtered(docs).count() == 0


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(60)) + ".", "k") for i in range(5)] + [(9, "bad", "k")], "doc_id long, text string, kept string")
    got = quality.filtered(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == list(range(5))


def test_no_votes_keep(spark):
    """The tie at one half: no rule speaks, for or against."""
    text = " ".join(f"AB{chr(97 + i % 26)}{chr(97 + i // 26)}ef" for i in range(60))
    (row,) = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.p_good == 0.5 and row.kept
    assert quality.filtered(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
