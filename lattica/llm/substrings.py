"""Exact substring deduplication with a log-structured fingerprint index.

Repeated windows of ``WINDOW`` words are found without shuffling every window. The least hash of a window's
``GRAM``-word pieces depends on its words alone, so equal windows have equal least pieces; consecutive windows
that share one form a *stretch*, fingerprinted by the piece (``anchor``) and by 128 bits of the SHA-256 of all its
words (``whole``). The index holds one row for each distinct fingerprint with its count and one text that has it,
in immutable runs that are bucketed by anchor and sorted; a manifest names the runs, so that a later job can open
the index again. Every batch becomes a run; two runs of a level are merge-joined, bucket by bucket and without a
shuffle, into one of the next level.

A batch is looked up by its anchors: a stretch that occurs twice is repeated as a whole; one whose anchor occurs
only in other stretches is a candidate, whose windows are verified one by one by the SHA-256 of their words
(128 bits of it) against those of the other stretches, of which history's come from the index's own copy of the
texts; the rest is unique. ``deduplicated`` judges a whole table, every copy of a window included;
``deduplicate_batch`` judges a new batch against history and itself, and adds it.

Exact copies are collapsed first (128-bit hash of the text), so that a large group is one content with a
multiplicity; counts are summed before each shuffle, and joins on hot fingerprints are split by the adaptive
skew join. Texts are shuffled only for contents that hold something to verify or to cut.

Null and empty texts have no words. Texts shorter than a window lose nothing. Repeated rows are copies, and
equal ids do not matter: rows are told apart by their text alone. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import delete_path, exists
from .common import BLOOM, forget_shuffles, map_arrow, session_dir, settings, stored, table, with_columns
from .textcore import BLANK_WORDS, covered, hash_ranges, hash_windows, text_slices, window_starts, words

WINDOW, GRAM, FANOUT, BATCHES = 35, 8, 2, 3
#: Joins of runs read their buckets side by side, in their stored order.
BUCKETED = {
    "spark.sql.sources.bucketing.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def least_pieces(word_hash: np.ndarray, start: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of the gram-word pieces of each window and its leftmost place, by doubling the span of a
    running minimum."""
    at = np.arange(max(len(word_hash) - gram + 1, 0))
    piece, least, span, want = hash_windows(word_hash, at, at + gram), at.astype(np.int32), 1, window - gram + 1

    def joined(step: int) -> np.ndarray:
        left, right = least[:-step], least[step:]
        return np.where(piece[left] <= piece[right], left, right)

    while 2 * span <= want:
        least, span = joined(span), 2 * span
    if want > span:
        least = joined(want - span)
    return piece[least[start]], least[start]


def stretches(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple:
    """Words, word hashes, first word and row of each window, first window of each stretch and its anchor."""
    w = words(data, off, BLANK_WORDS)
    h = hash_ranges(data, w.start, w.end)
    start, row = window_starts(w.first, window)
    if not len(start):
        return w, h, start, row, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, place = least_pieces(h, start, window, gram)
    opens = np.ones(len(start), bool)
    opens[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(opens)
    return w, h, start, row, at, least[at]


def spelled(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """128 bits of the SHA-256 of words start[i] .. end[i] - 1 of ``raw``, joined by one blank."""
    body = raw.split()
    ends = np.cumsum([len(w) + 1 for w in body])
    begins, line = np.append(0, ends), b" ".join(body)
    sha = hashlib.sha256
    return [sha(line[a:b]).digest()[:16] for a, b in zip(begins[start].tolist(), (begins[end] - 1).tolist(), strict=True)]


def key_columns(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text."""
    body = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(body), "k2": F.xxhash64(F.lit(7), body)}


def _contents(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """A row for each distinct text: key, multiplicity, n_words, the digest of all words and its stretches."""

    def measure(column: pa.Array) -> list:
        n_words, digest, anchors, wholes, firsts = [], [], [], [], []
        sizes: list[np.ndarray] = []
        for _, _, data, off in text_slices(column):
            w, h, start, row, at, anchor = stretches(data, off, window, gram)
            ends = np.append(at[1:], len(start)) - 1
            cut = np.searchsorted(row[at], np.arange(len(off)))
            first, last = start[at] - w.first[row[at]], start[ends] + window - w.first[row[at]]
            n_words.append(np.diff(w.first))
            sizes.append(np.bincount(row[at], minlength=len(off) - 1))
            anchors.append(anchor.view(np.int64)), firsts.append(first.astype(np.int32))
            raw = data.tobytes()
            for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                digest.append(hashlib.sha256(b" ".join(raw[a:b].split())).digest())
                if cut[r] < cut[r + 1]:
                    wholes += spelled(raw[a:b], first[cut[r] : cut[r + 1]], last[cut[r] : cut[r + 1]])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        cuts = pa.array(np.concatenate(([0], np.cumsum(cat(sizes, np.int64)))), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(cat(x, k))) for x, k in ((anchors, np.int64), (firsts, np.int32))]
        lists.insert(1, pa.ListArray.from_arrays(cuts, pa.array(wholes, pa.binary())))
        return [cat(n_words, np.int64), pa.array(digest, pa.binary()), *lists]

    keyed = docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).withColumns(key_columns(F.col("text")))
    rows = with_columns(keyed, "text", measure, "n_words long, digest binary, anchors array<long>, wholes array<binary>, firsts array<int>", ["k1", "k2"])
    one = F.first(F.struct("n_words", "digest", "anchors", "wholes", "firsts")).alias("one")
    return stored(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m"), one).select("k1", "k2", "m", "one.*"), "substring-contents")


def _occurrences(contents: DataFrame) -> DataFrame:
    """A row for each stretch; ``last``: its last window."""
    lasts = F.transform(F.col("firsts"), lambda x, i: F.coalesce(F.try_element_at(F.col("firsts"), i + 2) - 1, (F.col("n_words") - F.lit(WINDOW)).cast("int")))
    zipped = F.arrays_zip(F.col("anchors").alias("anchor"), F.col("wholes").alias("whole"), F.col("firsts").alias("first"), lasts.alias("last"))
    return contents.select("k1", "k2", "m", F.inline(zipped)).toDF("k1", "k2", "m", "anchor", "whole", "first", "last")


def _counted(contents: DataFrame) -> DataFrame:
    """A row for each fingerprint of the contents: n occurrences, and half the key of one text that has it. Another
    text with the same half would only be verified too."""
    return _occurrences(contents).groupBy("anchor", "whole").agg(F.sum("m").alias("n"), F.min("k1").alias("own"))


class FingerprintIndex:
    """Runs of fingerprints (anchor, whole, n, own) and the texts they came from, under ``path``.

    A run is a folder of Parquet files, bucketed by anchor and sorted, and is never changed: a merge writes a new
    one, a new manifest then names it, and only then its inputs are deleted. A lost executor or a failed merge so
    costs a rerun and no data. Opening a path with a manifest goes on where the last job ended. One writer at a time.
    """

    SCHEMA, ROW = "anchor BIGINT, whole BINARY, n BIGINT, own BIGINT", ["anchor", "whole", "n", "own"]

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = (path or f"{session_dir(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.texts: list[str] = []
        if exists(spark, self.path):
            found = [json.loads(r[0]) for r in spark.read.text(f"{self.path}/manifest-*.json", wholetext=True).collect()]  # the last two
            last = max(found, key=lambda m: m["version"])
            self.version, self.buckets, self.levels, self.texts = (last[k] for k in ("version", "buckets", "levels", "texts"))

    def _save(self, gone: list[str]) -> None:
        """Names the present runs, then deletes those that are gone and the manifest before the last."""
        self.version += 1
        body = json.dumps({"version": self.version, "buckets": self.buckets, "levels": self.levels, "texts": self.texts})
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{self.version:08d}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        out.write(bytearray(body.encode()))
        out.close()
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, f"{self.path}/{name}")
        delete_path(self.spark, f"{self.path}/manifest-{self.version - 2:08d}.json")
        forget_shuffles(self.spark)

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows.select(*self.ROW).write.bucketBy(self.buckets, "anchor").sortBy("anchor", "whole").format("parquet").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, whole) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _merged(self, a: str, b: str) -> str:
        """One run from two, by a merge join of their buckets."""
        x, y = self._run(a).alias("x"), self._run(b).alias("y")
        both = x.join(y, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.whole") == F.col("y.whole")), "full")
        n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
        with settings(self.spark, BUCKETED):
            return self._write(both.select(n.alias("n"), *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("anchor", "whole", "own"))))

    def add(self, contents: DataFrame, texts: DataFrame | None = None) -> None:
        """A batch becomes a run; full levels are merged. ``texts`` (k1, k2, text): needed for later batches."""
        names, gone = [self._write(_counted(contents).repartition(self.buckets, "anchor"))], []
        if texts is not None:
            self.texts.append(f"texts_{uuid.uuid4().hex}")
            texts.select("k1", "k2", "text").write.parquet(f"{self.path}/{self.texts[-1]}")
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level] += names
            if len(self.levels[level]) < self.fanout:
                break
            names, gone = [self._fold(self.levels[level])], gone + self.levels[level]
            self.levels[level] = []
            level += 1
        self._save(gone)

    def _fold(self, names: list[str]) -> str:
        out = names[0]
        for i, name in enumerate(names[1:]):
            merged = self._merged(out, name)
            if i:  # written between two merges
                self.spark.sql(f"DROP TABLE {out}")
                delete_path(self.spark, f"{self.path}/{out}")
            out = merged
        return out

    def compact(self) -> DataFrame:
        """All runs merged into one."""
        names = [n for level in self.levels for n in level]
        if len(names) > 1:
            self.levels = [[] for _ in self.levels] + [[self._fold(names)]]
            self._save(names)
        return self._run(next(n for level in self.levels for n in level))

    def drop(self) -> None:
        """Deletes the index with all its runs and texts."""
        for name in (n for level in self.levels for n in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.path)
        self.levels, self.texts, self.version = [], [], 0

    def near(self, anchors: DataFrame) -> DataFrame:
        """The rows of all runs with one of the (distinct) anchors: only the anchors are shuffled, to the runs' buckets."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        with settings(self.spark, BUCKETED):
            return stored(reduce(DataFrame.unionByName, (self._run(n).join(anchors, "anchor", "left_semi").select(*self.ROW) for n in names)), "substring-near")

    def text(self, keys: DataFrame) -> DataFrame:
        """k1, k2 and text of the texts with one of the (distinct) keys k1, once each."""
        if not self.texts:
            return self.spark.createDataFrame([], "k1 long, k2 long, text string")
        with settings(self.spark, BLOOM):
            rows = self.spark.read.parquet(*(f"{self.path}/{t}" for t in self.texts))
            return stored(rows.join(keys, "k1", "left_semi").dropDuplicates(["k1", "k2"]), "substring-history")


def _verdicts(index: DataFrame) -> DataFrame:
    """Fingerprints whose anchor occurs twice or more: n, a text's key, and whether other stretches share the anchor.
    A bucketed index is neither shuffled nor sorted."""
    by_anchor = index.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    verdicts = index.join(by_anchor, "anchor").select("anchor", "whole", "n", "own", (F.col("kinds") > 1).alias("mixed"))
    with settings(index.sparkSession, BUCKETED):
        return stored(verdicts, "substring-verdicts")


def _flags(contents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """For each content: stretches that are repeated as a whole, and those whose windows must be verified."""
    hit = _occurrences(contents).join(verdicts, ["anchor", "whole"])
    mine = F.col("own") == F.col("k1")
    stands = hit.select("k1", "k2", "m", "first", "last", (F.col("n") > 1).alias("sure"), (F.col("mixed") & ((F.col("n") == 1) | mine)).alias("verify"))
    rows = stands.where("sure OR verify").groupBy("k1", "k2").agg(F.first("m").alias("m"), F.collect_list(F.struct("first", "last", "sure", "verify")).alias("stretches"))
    # a text with copies is cut as a whole: it matters only for what others are verified against
    asked = F.exists("stretches", lambda x: x["verify"]).alias("asked")
    return stored(rows.select("*", asked, F.lit(1).alias("flag")).where("m = 1 OR asked"), "substring-flags")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2 and text of each content."""
    return docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).withColumns(key_columns(F.col("text"))).dropDuplicates(["k1", "k2"])


def _texts_of(docs: DataFrame, text: str, flags: DataFrame) -> DataFrame:
    """The texts of flagged contents, once each; the join is exact with or without the Bloom filter."""
    with settings(docs.sparkSession, BLOOM):
        return stored(_keyed(docs, text).join(flags.where("flag > 0"), ["k1", "k2"]), "substring-texts")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """The windows to verify: their words' digest, place, and weight 2 if their stretch is known to be repeated."""
    names = ["words", "k1", "k2", "at", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, cell, stretch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                spans = [(x["first"], x["last"] + 1, 1 + x["sure"]) for x in stretch if x["verify"]]
                at = np.concatenate([np.arange(a, b) for a, b, _ in spans])
                weight = np.repeat([w for _, _, w in spans], [b - a for a, b, _ in spans]).astype(np.int32)
                columns = [pa.array(spelled(cell.as_py().encode(), at, at + window), pa.binary()), pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2)), pa.array(at.astype(np.int32)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(texts.where("asked").select("k1", "k2", "text", "stretches"), run, "words binary, k1 long, k2 long, at int, weight int")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """n_removed and the digest of the kept words of each content, from its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest = [], []
            for cell, stretch, places in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                body = cell.as_py().encode().split()
                sure = [np.arange(x["first"], x["last"] + 1) for x in stretch if x["sure"]]
                start = np.concatenate([*sure, np.array(places or [], np.int64)]).astype(np.int64)
                gone = covered(start, window, len(body))
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join(x for x, g in zip(body, gone.tolist(), strict=True) if not g)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.binary())], names=["k1", "k2", "gone", "kept"])

    return map_arrow(texts.select("k1", "k2", "text", "stretches", "places"), run, "k1 long, k2 long, gone long, kept binary")


def _result(docs: DataFrame, id_column: str, text: str, contents: DataFrame, flags: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 from the flagged stretches; ``history``: more windows to verify against."""
    texts = _texts_of(docs, text, flags)
    asked = _windows(texts, WINDOW)
    asked = stored(asked if history is None else asked.unionByName(history), "substring-windows")
    forget_shuffles(docs.sparkSession)
    twice = asked.groupBy("words").agg(F.sum("weight").alias("seen")).where("seen > 1").select("words")
    places = asked.where("weight = 1").join(stored(twice, "substring-twice"), "words").groupBy("k1", "k2").agg(F.collect_list("at").alias("places"))
    cut = _cut(texts.where("m = 1").join(places, ["k1", "k2"], "left"), WINDOW)
    whole = (F.col("m") > 1) & (F.col("n_words") >= WINDOW)
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed")
    kept = F.lower(F.hex(F.when(whole, nothing).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256")
    results = contents.select("k1", "k2", "m", "n_words", "digest").join(cut, ["k1", "k2"], "left").select("k1", "k2", "n_words", removed, kept)
    results = stored(results, "substring-results")  # as only a join of two plain tables is split at a text of many copies
    keys = docs.select(docs[id_column].alias("id"), *(c.alias(k) for k, c in key_columns(docs[text]).items()))
    return keys.join(results, ["k1", "k2"]).select(F.col("id").alias(id_column), "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """id, n_words, n_removed and kept_sha256, a row for each document. The documents go to the index in batches, as
    from a growing corpus; all are then looked up in the compacted index, so that earlier ones see later ones too."""
    contents = _contents(docs, text, WINDOW, GRAM)
    forget_shuffles(docs.sparkSession)
    index = FingerprintIndex(docs.sparkSession)
    for b in range(batches):
        index.add(contents.where(F.pmod("k1", F.lit(batches)) == b))
    verdicts = _verdicts(index.compact())  # written, so the index has done its work
    index.drop()
    return _result(docs, id_column, text, contents, _flags(contents, verdicts))


def deduplicate_batch(docs: DataFrame, index: FingerprintIndex, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``deduplicated`` for a new batch, whose words also go where a window starts in an earlier batch of the
    index. The batch is then part of the index. Earlier results stay as they were."""
    contents = _contents(docs, text, WINDOW, GRAM)
    own = stored(_counted(contents), "substring-own")
    near = index.near(own.select("anchor").distinct())
    old = near.groupBy("anchor", "whole").agg(F.sum("n").alias("n"), F.min("own").alias("own"))
    here = own.withColumn("here", F.lit(True)).unionByName(old.withColumn("here", F.lit(False)))
    first = F.coalesce(F.min(F.when(F.col("here"), F.col("own"))), F.min("own")).alias("own")  # a text of the batch, where it has the stretch
    both = here.groupBy("anchor", "whole").agg(F.sum("n").alias("n"), F.bool_or("here").alias("here"), first)
    verdicts = _verdicts(both)
    # stretches that history alone has, by the texts that have them
    past = stored(both.where("NOT here").select("anchor", "whole", F.col("own").alias("k1")), "substring-past")
    texts = index.text(past.select("k1").distinct())
    spans = _occurrences(_contents(texts, "text", WINDOW, GRAM)).join(past, ["anchor", "whole", "k1"])
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", F.lit(False).alias("sure"), F.lit(True).alias("verify"))).alias("stretches"))
    history = _windows(texts.join(spans, ["k1", "k2"]).withColumn("asked", F.lit(True)), WINDOW)
    # an exact copy of an earlier text is a repeated content here too, by its stretches
    out = stored(_result(docs, id_column, text, contents, _flags(contents, verdicts), history), "substring-batch")
    index.add(contents, _keyed(docs, text))
    return out


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
