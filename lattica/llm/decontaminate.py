"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every item is cut into windows of ``WINDOW`` words (a shorter item is one window). A window occurs in a text
only if all its words do, so one of them, the rarest in the corpus, is a sufficient prefix: only texts' words
equal to the rarest word of some window are joined with the windows. The word's place in the window gives the
only place where the window can start; a start before the text or an end after it is ruled out; what is left is
verified word by word.

Words are compared with A-Z lower-cased and all else unchanged; the prefix uses the full lower case, which only
adds candidates. Up to ``LITERALS`` prefix words are literals of the scan; more are joined, in parts of
``BROADCAST_WINDOWS`` windows, so a larger benchmark costs more scans of the corpus and not more memory. A hit
carries the words around it that its windows can cover, not its text.

Null and empty texts have no words. Items without words match nothing; items with a null id mark words but
cannot be listed. Repeated rows get equal results, each as a row. Empty tables on either side work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW, LITERALS = 10, 20_000
#: Windows, or texts with hits, are broadcast up to so many rows (of a few hundred bytes each), else shuffled.
BROADCAST_WINDOWS = 200_000
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` as it reads before A-Z are lower-cased.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _plain(words: Column) -> Column:
    return F.transform(words, lambda x: F.translate(x, _UPPER, _LOWER))


def item_windows(items: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """item, window (array of words): every window of every item, once."""
    words = items.select(items[id_column].alias("item"), _plain(_words(items[text])).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return words.select("item", "w", length.alias("length"), F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.col("length")).alias("window")).distinct()


def _key(text: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(body), "k2": F.xxhash64(F.lit(7), body)}


def _literals(words: DataFrame) -> list[str] | None:
    """The distinct words if they are few: part of the benchmark's own vocabulary, which does not grow with the corpus."""
    found = words.distinct().limit(LITERALS + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= LITERALS else None


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def rarity(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """word, seen: how often the words of the vocabulary occur in the corpus."""
    known, exploded = _literals(vocabulary), docs.select(F.explode(_words(docs[text])).alias("x")).select(F.lower("x").alias("word"))
    if known is not None:
        exploded = exploded.where(F.col("word").isin(known))
    counted = exploded.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    return counted if known is not None else counted.join(vocabulary.distinct(), "word", "left_semi")


def _hits(docs: DataFrame, text: str, size: int, known: list[str] | None) -> DataFrame:
    """k1, k2 and a row for each word of a text, or for each known one: p (its place), word, n (the text's words) and
    near (the words around it that a window of ``size`` can cover, from place ``at`` on)."""
    first = lambda i: F.greatest(i - (size - 1), F.lit(0))

    def found(w: Column) -> Column:
        one = lambda x, i: F.struct(i.alias("p"), F.lower(x).alias("word"), F.size(w).alias("n"), first(i).alias("at"), F.slice(w, first(i) + 1, F.lit(2 * size - 1)).alias("near"))
        return F.transform(w, one) if known is None else F.filter(F.transform(w, lambda x, i: F.when(F.lower(x).isin(known), one(x, i))), lambda x: x.isNotNull())

    # the text is split once: a column of words would be split again for each use in the lambda
    texts = docs.select(docs[text].alias("text")).withColumns(_key(F.col("text")))
    return texts.select("k1", "k2", F.inline(F.transform(F.array(_words(F.col("text"))), found)[0]))


def occurrences(docs: DataFrame, windows: DataFrame, text: str, size: int = WINDOW) -> DataFrame:
    """k1, k2, start, length, item: every place where a window occurs in a text. ``windows`` has id, item and window."""
    placed = windows.select("id", F.posexplode("window").alias("offset", "x")).select("id", "offset", F.lower("x").alias("word"))
    seen = stored(rarity(docs, text, placed.select("word")), "decontaminate-rarity")
    # the rarest word of each window and its first place: windows are the benchmark's, not the corpus's
    ranked = placed.join(seen, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "offset")).alias("rarest"))
    prefixes = stored(windows.join(ranked, "id").select("item", "window", F.size("window").alias("length"), "rarest.word", "rarest.offset", "rarest.seen").where("seen > 0"), "decontaminate-prefixes")
    known, total = _literals(prefixes.select("word")), prefixes.count()
    parts, hits = max(1, -(-total // BROADCAST_WINDOWS)), _hits(docs, text, size, known)
    found = []
    for part in range(parts):  # one, unless the benchmark has very many windows
        own = prefixes.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part) if parts > 1 else prefixes
        start = F.col("p") - F.col("offset")
        joined = hits.join(F.broadcast(own) if parts == 1 else _small(own, own.count()), "word").withColumn("start", start)
        bounded = joined.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
        same = _plain(F.slice("near", F.col("start") - F.col("at") + 1, F.col("length"))) == F.col("window")
        found.append(bounded.where(same).select("k1", "k2", "start", "length", "item"))
    return reduce(DataFrame.unionByName, found)


def _windows(items: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """The windows with an id each, fixed by being written."""
    return stored(item_windows(items, item_id, item_text, size).withColumn("id", F.monotonically_increasing_id()), "decontaminate-windows")


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each document."""
    found = occurrences(docs, _windows(items, item_id, item_text, size), text, size)
    by_text = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item").alias("found"))
    # words under the union of the spans, which are sorted by start
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(so_far: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(end - F.greatest(so_far["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(so_far["end"], end).alias("end"), (so_far["n"] + more).alias("n"))

    hit = F.aggregate(F.array_sort("spans"), none, step)["n"]
    listed = F.array_join(F.array_sort(F.transform("found", lambda x: x.cast("string"))), ",")
    marked = stored(by_text.select("k1", "k2", hit.alias("hit"), F.size("found").cast("long").alias("listed"), F.sha2(listed, 256).alias("digest")), "decontaminate-marked")
    n_words = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    rows = docs.select(docs[id_column].alias("id"), n_words, *(c.alias(k) for k, c in _key(docs[text]).items()))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return rows.join(_small(marked, marked.count()), ["k1", "k2"], "left").select(
        F.col("id").alias(id_column), "n_words", n_hit.alias("n_hit"), F.coalesce("listed", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    found = occurrences(docs, _windows(items, item_id, item_text, size), text, size)
    bad = stored(found.select("k1", "k2").distinct(), "decontaminate-found")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *(c.alias(k) for k, c in _key(docs[text]).items()))
    return own.join(_small(bad, bad.count()), ["k1", "k2"], "left_anti").select("_row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents),
it AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
