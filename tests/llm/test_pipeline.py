from collections import Counter, defaultdict

import corpus_pipeline
from lattica.llm import packing, quality
from lattica.llm.common import stored

from .test_decontaminate import brute as contaminated
from .test_mixing import sizes_of
from .test_neardup import brute_classes, hot_group
from .test_quality import brute as counts

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, out = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name.replace(' ', '-')}"))
    assert names == ["quality rules", "near-duplicates", "decontamination", "mixing", "token ids"]
    assert all(x.columns == docs.columns for x in out[:-1])
    rows = [sorted(x.collect(), key=lambda r: r.doc_id) for x in out[:-1]]
    # quality: what the base rule fails goes, good labels stay
    kept = {r.doc_id for r in rows[1]}
    failed = {r.doc_id for r in rows[0] if counts(r.text)[-1]}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert not kept & failed and good - failed <= kept
    judged = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert kept == judged
    # near-duplicates: the first of each class
    classes = brute_classes([r.text for r in rows[1]])
    assert [r.doc_id for r in rows[2]] == [rows[1][i].doc_id for i in sorted({c for c, _ in classes.values()})]
    # decontamination
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [r for r in rows[3]] == [r for r, x in zip(rows[2], contaminated([r.text for r in rows[2]], items), strict=True) if not x[-1]]
    # mixing: whole documents, as often as the sizes' query says
    from lattica.llm import mixing

    assert Counter(r.doc_id for r in rows[4]) == {r.doc_id: r.copies for r in mixing.mixed_sizes(out[3]).collect() if r.copies}
    total, taken = defaultdict(int), defaultdict(int)
    for _, s, n in sizes_of(out[3]):
        total[s] += n
    for _, s, n in sizes_of(out[4]):
        taken[s] += n
    goal = mixing.targets(list(total.items()))
    largest = max(n for _, _, n in sizes_of(out[3]))
    assert all(abs(taken[s] - goal[s]) <= largest for s in goal)
    # token ids: every copy of every document, once
    encode = packing.encoder(packing.VOCABULARY)
    packed = out[5].collect()
    assert sum(r.n_tokens for r in packed) == sum(len(encode(r.text)) + 1 for r in rows[4])
    assert Counter(d for r in packed for d, p in zip(r.doc_ids, r.pieces, strict=True) if p == 0) == Counter(r.doc_id for r in rows[4])


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_a_hot_group(spark):
    """Texts that share a large template, with planted copies: the stage keeps the first of each pair."""
    texts, classes = hot_group()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in classes.values()})


def test_edges_from_end_to_end(spark, tmp_path):
    """Nulls in any column, repeated rows, a very long text, rows of one id and text, and columns with clashing names."""
    good = lambda k: f"Page {k}. " + " ".join(f"word{k}x{j}" for j in range(80)) + "."
    rows = [(1, good(1), "en", "a", 9), (1, good(1), "en", "a", 9), (1, good(1), "de", "b", None), (2, good(2), None, None, 9), (None, good(3), "en", "a", 9),
            (4, None, "en", "a", 9), (5, "", "en", "a", 9), (6, "\n".join(good(f"6-{i}") for i in range(3000)), "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS kept", "2 AS _row", "3 AS k", "4 AS _n", "5 AS tie", "6 AS id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "word2x3 word2x4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    again = []
    for _ in range(2):
        seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stored(stage(spark, seen, str(tmp_path)), f"test-{name.replace(' ', '-')}")
            assert seen.columns == docs.columns
        again.append(sorted(map(str, seen.collect())))
        ids = {r.doc_id for r in seen.collect()}
        assert ids <= {1, None, 6} and 6 in ids
    assert again[0] == again[1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {d for r in packed for d in r.doc_ids} == ids
