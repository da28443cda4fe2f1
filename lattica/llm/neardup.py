"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five words in a row (a shorter text is one shingle); its weight is one more than the logarithm of its
count in the text, times an inverse document frequency. That is 1 for a shingle of one document and falls with the
logarithm of the frequency to ``LEAST_IDF`` for a shingle of all documents: the floor is high so that a group of
near copies that holds a large part of all rows is not separated by its own weights. Every shingle's documents are
counted. Those of the rest are counted in a shuffle; common ones, in more than a thousandth of the documents, would
be its hot keys and are sent to all tasks. They number at most a thousand times the shingles of an average document
and are found exactly:
each is common, at a quarter of the share, in some blocks of the scan too; blocks propose, and as those that do
not can hold no more than a quarter of the share, the sum of the proposals leaves a bounded number of candidates
in whatever order the documents lie. A second scan counts them.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples a text; two texts agree in one with the
probability of their weighted Jaccard similarity, so a pair of similarity 0.8 shares a band with probability
0.9998. Texts with an equal band meet in a bucket, whose texts are compared with one leader; the texts of buckets
that this does not make one component are joined with each other by an exact prefix filter, so every pair that
shares a band is compared, linked already or too dissimilar. A link is a weighted Jaccard similarity of
``SIMILAR`` or more over the texts' whole shingle sets, whose ids are cut to 32 bits (two shingles of a text that
then agree count as one). Components of links are the classes.

Exact copies are collapsed first by a 128-bit digest, so a group of copies is one text. Texts without words
are a class each. A class is named by its least id; null ids count only for the size. Repeated rows are copies.
Ids must be numbers or cast to them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLOOM, SPENT, bounded_batches, map_arrow, release, settings, table
from .common import stored as written
from .textcore import BLANK_WORDS, hash_ranges, hash_windows, mix, text_slices, words

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
COMMON_SHARE, LEAST_IDF = 0.001, 0.9
#: A block of the frequency scan closes at so many shingles and documents, or at so many shingles alone; a scan's
#: partitions are joined to have about so many documents; candidates are counted in scans of so many at a time.
BLOCK_SHINGLES, BLOCK_DOCS, MOST_SHINGLES, PARTITION_DOCS, CANDIDATES = 1_000_000, 4000, 8_000_000, 8000, 2_000_000
#: A block proposes what is in more than this part of the share of its documents.
BLOCK_PART = 0.25
#: Texts are dealt to pieces of about so many bytes, and shingle ids to as many ranges; to more and smaller ones if
#: there would be few, and never to more than 2**16.
PIECE_BYTES, SMALL_PIECE_BYTES, FEW_PIECES, MOST_PIECES = 16 << 20, 1 << 20, 12, 1 << 16

#: What separates words.
BLANKS = " \t\n\x0b\f\r"

_ID = np.uint64((1 << 48) - 1)
_CELL_BITS = 14
_CELLS, _STEP = 1 << _CELL_BITS, np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder; the shuffle files it took, often as large as the texts, are deleted at once."""
    with settings(df.sparkSession, SPENT):
        return written(df, name)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit id and count of each distinct shingle of each row, sorted by row and id; words of each row.
    A slice has at most 2**16 rows."""
    w = words(data, off, BLANK_WORDS)
    h = hash_ranges(data, w.start, w.end)
    n = np.diff(w.first)
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + w.first[row]
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hash_windows(h, at, at + size[row]) >> np.uint64(16)))
    opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[opens] >> np.uint64(48)).astype(np.int64), key[opens] & _ID, np.diff(np.append(opens, len(key))), n


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i in range(0, len(column), 1 << 15):
        for a, b, data, off in text_slices(column.slice(i, 1 << 15)):
            yield a + i, b + i, data, off


def common_shingles(docs: DataFrame, text: str, share: float = COMMON_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Ids, sorted, and inverse document frequencies of the shingles in more than a share of the documents, where
    the latter is 1 at that share."""
    n = docs.count()
    ids, seen = common_counts(docs, text, n, share)
    return ids, idf(seen, n, share) if len(ids) else np.zeros(0)


def common_counts(docs: DataFrame, text: str, n: int, share: float = COMMON_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Ids, sorted, and numbers of documents of the shingles in more than a share of the n documents."""
    source = docs.select(docs[text].alias("text"))
    source = source.coalesce(max(1, min(source.rdd.getNumPartitions(), n // PARTITION_DOCS)))

    def blocks(batches: Iterator[pa.RecordBatch], count: Callable) -> Iterator[pa.RecordBatch]:
        """Counts block by block. The last block of a partition joins the one before if it has few documents,
        as a block of few documents would propose every shingle."""
        full: tuple[list[np.ndarray], int] | None = None
        held, docs_held, size = [], 0, 0

        def closed(arrays: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
            if arrays:
                ids, seen = count(np.concatenate(arrays), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(seen.astype(np.int64))], names=["id", "seen"])

        for batch in batches:
            for i, j, data, off in _slices(batch.column(0)):
                held.append(shingles(data, off)[1])
                docs_held, size = docs_held + j - i, size + len(held[-1])
                if size >= BLOCK_SHINGLES and docs_held >= BLOCK_DOCS or size >= MOST_SHINGLES:
                    if full:
                        yield from closed(*full)
                    full, held, docs_held, size = (held, docs_held), [], 0, 0
        if full and docs_held < BLOCK_DOCS:
            held, docs_held = full[0] + held, full[1] + docs_held
        elif full:
            yield from closed(*full)
        yield from closed(held, docs_held)

    def proposed(ids: np.ndarray, docs_held: int) -> tuple[np.ndarray, np.ndarray]:
        found, seen = np.unique(ids, return_counts=True)
        often = seen > docs_held * share * BLOCK_PART
        return found[often], seen[often]

    first = map_arrow(source, lambda b: blocks(b, proposed), "id long, seen long")
    # blocks that do not propose a shingle hold BLOCK_PART of the share at most, so the others hold the rest: no
    # more than 1 / (share * (1 - BLOCK_PART)) times the shingles of an average document can be candidates
    least = max(1.0, n * share) - n * share * BLOCK_PART
    candidates = stored(first.groupBy("id").agg(F.sum("seen").alias("seen")).where(F.col("seen") > least).select("id"), "neardup-candidates")
    total = candidates.count()
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0)
    parts = -(-total // CANDIDATES)
    kept: list[tuple[int, int]] = []
    for part in range(parts):
        own = np.sort(np.array([r[0] for r in candidates.where(F.pmod("id", F.lit(parts)) == part).collect()], np.int64).view(np.uint64))

        def counted(ids: np.ndarray, docs_held: int, own: np.ndarray = own) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            seen = np.bincount(at[own[at] == ids], minlength=len(own))
            return own[seen > 0], seen[seen > 0]

        exact = map_arrow(source, lambda b, c=counted: blocks(b, c), "id long, seen long").groupBy("id").agg(F.sum("seen").alias("seen"))
        kept += [(r.id, r.seen) for r in exact.where(F.col("seen") > max(1, n * share)).collect()]  # at most 1 / share times an average document
    kept.sort()
    return np.array([k[0] for k in kept], np.uint64), np.array([k[1] for k in kept], float)


def idf(seen: np.ndarray, n: int, share: float = COMMON_SHARE) -> np.ndarray:
    """1 for what is in a share of n documents, ``LEAST_IDF`` for what is in all of them."""
    return LEAST_IDF + (1 - LEAST_IDF) * np.log(n / seen) / np.log(1 / share)


class Frequencies(NamedTuple):
    """In how many of n documents each shingle is: common ones sorted by id; ``rest`` has, for each piece of the texts,
    those in two documents or more that occur in it. Shingles in neither are in one document."""

    n: int
    common: tuple[np.ndarray, np.ndarray]
    rest: DataFrame
    pieces: int

    @property
    def tasks(self) -> int:
        """By number, so that tasks do not grow with the input; twice the pieces, as several can fall to one task."""
        return 2 * self.pieces

    def piece(self, text: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(self.pieces)).cast("int")


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: those of sorted numbers compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(v.as_buffer(), np.uint8).reshape(width, -1).T for c in column.chunks for v in c]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.zeros(0, kind)


def frequencies(docs: DataFrame, text: str, share: float = COMMON_SHARE) -> Frequencies:
    """The document frequencies of all shingles. Blocks of the scan count by shingle and piece; ranges of ids add up."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(docs[text]))).first()
    size = size or 0
    pieces = min(MOST_PIECES, max(1, size // PIECE_BYTES, min(FEW_PIECES, size // SMALL_PIECE_BYTES)))
    common = common_counts(docs, text, n, share)
    out = Frequencies(n, common, docs, pieces)
    # the least key of each range: 48 bits of the shingle, 16 of the piece
    bounds = np.array([-(-(i << 48) // pieces) << 16 for i in range(pieces)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                keys, seen = np.unique(np.concatenate(held), return_counts=True)
                cut = np.append(np.searchsorted(keys, bounds), len(keys))
                rows = [(i, _planes(keys[a:b]), _planes(seen[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
                for i in range(0, len(rows), 500):
                    part = list(zip(*rows[i : i + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], names=["range", "keys", "seen"])

        for batch in batches:
            dealt = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            for i, _, data, off in _slices(batch.column(0)):
                row, ids, _, _ = shingles(data, off)
                if len(common[0]):
                    at = np.minimum(np.searchsorted(common[0], ids), len(common[0]) - 1)
                    rare = common[0][at] != ids
                    row, ids = row[rare], ids[rare]
                held.append((ids << np.uint64(16)) | dealt[i + row])
                size += len(ids)
                if size >= BLOCK_SHINGLES:
                    yield from closed()
                    held, size = [], 0
        yield from closed()

    def add_up(group: pa.Table) -> pa.Table:
        keys, seen = _unplaned(group["keys"], np.uint64), _unplaned(group["seen"], np.uint32)
        order = np.argsort(keys)
        keys, seen = keys[order], seen[order].astype(np.int64)
        ids = keys >> np.uint64(16)
        opens = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        seen = np.repeat(np.add.reduceat(seen, opens), np.diff(np.append(opens, len(ids))))
        once = np.append(True, keys[1:] != keys[:-1]) & (seen > 1)
        ids, seen, piece = ids[once], seen[once], (keys[once] & np.uint64(0xFFFF)).astype(np.int32)
        order = np.argsort(piece, kind="stable")
        ids, seen, piece = ids[order], seen[order], piece[order]
        cut = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(piece))
        result = pa.table(
            {
                "piece": pa.array(piece[cut], pa.int32()),
                "ids": pa.array([_planes(ids[a:b]) for a, b in zip(cut, ends, strict=False)], pa.binary()),
                "seen": pa.array([_planes(seen[a:b]) for a, b in zip(cut, ends, strict=False)], pa.binary()),
            }
        )
        release()
        return result

    blocks = map_arrow(docs.select(docs[text].alias("text"), out.piece(docs[text]).alias("piece")), count, "range int, keys binary, seen binary")
    return out._replace(rest=stored(blocks.repartition(out.tasks, "range").groupBy("range").applyInArrow(add_up, "piece int, ids binary, seen binary"), "neardup-frequencies"))


def _with_weights(rows: DataFrame, known: Frequencies, measure: Callable, added: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of the rows, whose texts are distinct, plus the columns ``added`` (a DDL string) that
    ``measure(texts, (ids, inverse document frequencies))`` returns as a list of arrays."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType([*(rows.schema[c] for c in keep), *T.StructType.fromDDL(added).fields])
    arrow = to_arrow_schema(schema)
    n, common = known.n, known.common

    def run(texts: pa.Table, rest: pa.Table) -> pa.Table:
        if not len(texts):
            return arrow.empty_table()
        ids = np.concatenate([common[0], _unplaned(rest["ids"], np.uint64)])
        seen = np.concatenate([common[1], _unplaned(rest["seen"], np.int64)])
        order = np.argsort(ids)
        pair = ids[order], idf(seen[order], n, min(COMMON_SHARE, 1 / n))
        parts = []
        for batch in texts.to_batches():
            columns = [*(batch.column(c) for c in keep), *measure(batch.column("text"), pair)]
            columns = [pa.array(c) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c in columns]
            parts.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        release()
        return pa.Table.from_batches(parts, arrow)

    dealt = rows.select(*keep, "text", known.piece(F.col("text")).alias("piece"))
    left, right = (df.repartition(known.tasks, "piece").groupBy("piece") for df in (dealt, known.rest))
    return left.cogroup(right).applyInArrow(run, schema)


def weights(ids: np.ndarray, count: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = 1 + np.log(count)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], ids), len(common[0]) - 1)
        hit = common[0][at] == ids
        out[hit] *= common[1][at[hit]]
    return out


class Sampler:
    """Improved consistent weighted sampling: sample j of a set is the element with the least
    ln a = ln c - r (t - b) - r with t = floor(ln weight / r + b), together with t.

    A hash of the element and j points to one of 2**14 draws of (r, b) and, by other bits, to one of 2**14 draws of
    ln c, so ln a has 2**28 values in one sample; among elements with the same one the least hash wins, which keeps
    the choice consistent. Weight 1 has t = 0.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        draw = np.random.default_rng(seed)
        r, c = draw.gamma(2, 1, (2, samples, _CELLS))
        self.r, self.b, self.ln_c = r, draw.random((samples, _CELLS)), np.log(c).astype(np.float32)
        self.odd = draw.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.one = (-self.r * (1 - self.b) + 64).astype(np.float32)  # above 0, where the bits of floats have their order

    def __call__(self, ids: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of samples for each set; ``first`` is where each set, none empty, begins."""
        spread = mix(ids + np.uint64(1))
        low = spread & np.uint64(0xFFFFFFFF)
        other = np.flatnonzero(weight != 1)
        ln_w = np.log(weight[other])
        out = np.empty((len(first), len(self.odd)), np.uint64)
        for j, odd in enumerate(self.odd):
            drawn = spread * odd
            cell = (drawn >> np.uint64(64 - _CELL_BITS)).astype(np.int32)
            ln_c = self.ln_c[j][((drawn >> np.uint64(64 - 2 * _CELL_BITS)) & np.uint64(_CELLS - 1)).astype(np.int32)]
            ln_a = self.one[j][cell] + ln_c
            if len(other):
                k = cell[other]
                r, b = self.r[j][k], self.b[j][k]
                t = np.floor(ln_w / r + b)
                ln_a[other] = ln_c[other] - r * (t - b) - r + 64
            value = (np.maximum(ln_a, 1).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
            if len(other):
                value[other] = (value[other] & ~np.uint64(0xFFFFFFFF)) | ((spread[other] + t.astype(np.int64).view(np.uint64) * _STEP) & np.uint64(0xFFFFFFFF))
            out[:, j] = np.minimum.reduceat(value, first)
        return out


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def bands_of(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    key = np.zeros((len(samples), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key ^ samples[:, i::ROWS][:, :BANDS]) + np.uint64(i)
    return key


def key_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _banded(docs: DataFrame, id_column: str, text: str, known: Frequencies) -> DataFrame:
    """k, m, id, n_words and bands of each distinct text."""

    def measure(column: pa.Array, common: tuple[np.ndarray, np.ndarray]) -> list:
        n_words, bands, cuts = [], [], [np.zeros(1, np.int64)]
        for _, _, data, off in _slices(column):
            row, ids, count, n = shingles(data, off)
            n_words.append(n)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            if len(first):
                bands.append(bands_of(sampler()(ids, weights(ids, count, common), first)).view(np.int64).ravel())
            cuts.append(np.where(n > 0, BANDS, 0))
        offsets = pa.array(np.cumsum(np.concatenate(cuts)), pa.int32())
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        return [np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.ListArray.from_arrays(offsets, flat)]

    keyed = docs.select(docs[id_column].cast("long").alias("id"), docs[text].alias("text"), key_of(docs[text]).alias("k"))
    rows = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id"), F.first("text").alias("text"))
    return stored(_with_weights(rows, known, measure, "n_words long, bands array<long>", ["k", "m", "id"]), "neardup-texts")


def _vectors(docs: DataFrame, text: str, wanted: DataFrame, known: Frequencies) -> DataFrame:
    """k, ids and weights, as bytes, of the wanted texts. The optimiser's runtime Bloom filter, of a bounded
    size, keeps most other texts out of the shuffle; the join is exact with or without it."""
    def measure(column: pa.Array, common: tuple[np.ndarray, np.ndarray]) -> list:
        ids_out, weights_out = [], []
        for i, j, data, off in _slices(column):
            row, ids, count, _ = shingles(data, off)
            # ids are cut to 32 bits; the rare two of one text that then agree are added up
            key = (row.astype(np.uint64) << np.uint64(32)) | (ids & np.uint64(0xFFFFFFFF))
            order = np.argsort(key)
            key = key[order]
            opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            w = (np.add.reduceat(weights(ids, count, common)[order], opens) if len(key) else np.zeros(0)).astype(np.float32)
            short, cut = key[opens].astype(np.uint32), np.searchsorted(key[opens] >> np.uint64(32), np.arange(j - i + 1))
            ids_out += [short[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            weights_out += [w[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [pa.array(ids_out, pa.binary()), pa.array(weights_out, pa.binary())]

    with settings(docs.sparkSession, BLOOM):
        keyed = docs.select(docs[text].alias("text"), key_of(docs[text]).alias("k")).dropDuplicates(["k"])
        texts = keyed.join(wanted.where("met > 1"), "k").select("k", "text")
        return stored(_with_weights(texts, known, measure, "ids binary, weights binary", ["k"]), "neardup-vectors")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The weighted Jaccard similarity of two sets of sorted distinct ids."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    both = b[at] == a if len(b) else np.zeros(len(a), bool)
    least = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
    return float(least / max(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - least, 1e-9))


def _verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                keep.append(similarity(*(np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.uint32, np.float32) * 2, strict=True))) >= SIMILAR)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left, right = vectors.toDF("a", "ids_a", "weights_a"), vectors.toDF("b", "ids_b", "weights_b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ids_a", "weights_a", "ids_b", "weights_b")
    return map_arrow(both, run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(k, c): the least key of its component for every key in an edge, by hash-min with pointer jumping."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("k", "n").distinct(), "neardup-edges")
    labels = stored(both.groupBy("k").agg(F.min("n").alias("n")).select("k", F.least("k", "n").alias("c")), "neardup-labels")
    while True:
        near = both.join(labels.toDF("n", "c"), "n").groupBy("k").agg(F.min("c").alias("near"))
        lower = labels.join(near, "k").select("k", F.least("c", "near").alias("c"), F.col("c").alias("old"))
        jump = stored(lower.join(labels.toDF("c", "further"), "c").select("k", F.least("c", "further").alias("c"), "old"), "neardup-labels")
        labels = jump.select("k", "c")
        if jump.where("c <> old").isEmpty():
            return labels


def _tokens(rest: DataFrame, vectors: DataFrame) -> DataFrame:
    """k, c, id and weight of each shingle of the texts (k, c), with the weight of all of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ws = ([np.frombuffer(v.as_buffer(), t) for v in batch.column(i)] for i, t in ((2, np.int32), (3, np.float32)))
            off = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((ids, np.int32), (ws, np.float32))]
            total = pa.array([float(w.sum(dtype=np.float64)) for w in ws], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, total], names=["k", "c", "ids", "weights", "heavy"])

    rows = rest.join(vectors, "k").select("k", "c", "ids", "weights")
    packed = map_arrow(rows, run, "k binary, c binary, ids array<int>, weights array<float>, heavy double")
    return packed.select("k", "c", "heavy", F.inline(F.arrays_zip("ids", "weights")).alias("id", "w"))


def _alike(rest: DataFrame, vectors: DataFrame) -> DataFrame:
    """All pairs (a, b) of the texts (k, c) in different components that can be similar, by a prefix-filtered join.

    Shingles are ordered by how many of these texts have them. What two similar texts share, from the rarest shared
    one on, weighs at least ``SIMILAR`` of the heavier text and 2 * SIMILAR / (1 + SIMILAR) of the lighter; so only a
    text's shingles with so much from them on need to meet, and only if that bounds the similarity of the pair by no
    less. Shingles of one text alone meet none.
    """
    least = SIMILAR * (1 - 1e-5)  # weights are rounded
    tokens = stored(_tokens(rest, vectors), "neardup-tokens")
    # tables of one row an id are written, as only a join of two plain tables is split at a hot id
    often = stored(tokens.groupBy("id").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "neardup-often")
    tail = Window.partitionBy("k").orderBy(F.desc("often"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = tokens.join(often, "id").withColumn("tail", F.sum(F.col("w").cast("double")).over(tail)).where(F.col("tail") >= least * F.col("heavy"))
    prefix = stored(prefix.select("id", "k", "c", "heavy", "tail"), "neardup-prefixes")
    # texts of a shingle's largest component need to meet only the others
    parts = prefix.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("id").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = stored(mixed.select("id", "main"), "neardup-mixed")
    met = stored(prefix.join(mixed, "id"), "neardup-met")
    light = met.where(F.col("tail") >= 2 * least / (1 + least) * F.col("heavy"))
    main, shared = F.col("c") == F.col("main"), F.least("x.tail", "y.tail")
    can = shared >= least * (F.col("x.heavy") + F.col("y.heavy") - shared)
    lighter = F.struct("x.heavy", "x.k") < F.struct("y.heavy", "y.k")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.alias("x").join(y.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & lighter & can)
        return both.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"))

    return meet(light.where(~main), met).unionByName(meet(light.where(main), met.where(~main))).distinct()


def _linked(texts: DataFrame, vectors_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(k, c) of the texts that are linked to another.

    The texts of a bucket are compared with its leader, the text that meets most others and so is likely the
    original of its copies. The texts of all buckets that are then still in several components are joined exactly.
    """
    rows = texts.select("k", F.explode("bands").alias("band"))
    sizes = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "neardup-sizes")
    buckets = stored(rows.join(sizes, "band"), "neardup-buckets")
    if buckets.isEmpty():
        return None
    wanted = stored(buckets.groupBy("k").agg(F.max("met").alias("met"), F.sum("met").alias("degree")), "neardup-wanted")
    vectors = vectors_of(wanted)
    labels = wanted.select("k", F.col("k").alias("c"), "degree")
    leaders = stored(buckets.join(labels, "k").groupBy("band").agg(F.min(F.struct(-F.col("degree"), "k"))["k"].alias("b")), "neardup-leaders")
    # leaders meet all of their buckets and leave them
    led = stored(buckets.select("band", "k").join(leaders, "band").where("k <> b"), "neardup-led")
    done = stored(led.select(F.least("k", "b").alias("a"), F.greatest("k", "b").alias("b")).distinct(), "neardup-pairs")
    labels = _joined(labels, stored(_verified(done, vectors), "neardup-links"))
    left = stored(led.select("band", "k").join(labels.select("k", "c"), "k"), "neardup-left")
    mixed = left.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
    rest = stored(left.join(mixed, "band").select("k", "c").distinct(), "neardup-rest")
    if rest.isEmpty():
        return labels
    pairs = stored(_alike(rest, vectors).join(done, ["a", "b"], "left_anti"), "neardup-pairs")
    return _joined(labels, stored(_verified(pairs, vectors), "neardup-links"))


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after linked components have become one."""
    if edges.isEmpty():
        return labels
    ends = edges.join(labels.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    merged = components(ends).toDF("c", "to")
    return stored(labels.join(merged, "c", "left").select("k", F.coalesce("to", "c").alias("c"), "degree"), "neardup-labels")


def _classes(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """k, m, id, n_words and class key c of each distinct text."""
    known = frequencies(docs, text)
    texts = _banded(docs, id_column, text, known)
    linked = _linked(texts, lambda wanted: _vectors(docs, text, wanted, known))
    if linked is None:
        return texts.select("k", "m", "id", "n_words", F.col("k").alias("c"))
    return texts.join(linked, "k", "left").select("k", "m", "id", "n_words", F.coalesce("c", "k").alias("c"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, class_id (the least id of the class), class_size and n_words, a row for each document."""
    classes = stored(_classes(docs, id_column, text), "neardup-classes")
    named = classes.groupBy("c").agg(F.min("id").alias("class_id"), F.sum("m").alias("class_size"))
    by_text = classes.join(named, "c").select("k", "n_words", "class_id", "class_size")
    alone = F.col("n_words") == 0
    own = docs.select(docs[id_column].cast("long").alias("id"), key_of(docs[text]).alias("k"))
    return own.join(by_text, "k").select(
        F.col("id").alias(id_column), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), "n_words",
    )


def unique(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least id (nulls last), with all its columns. Documents
    without words all stay."""
    classes = stored(_classes(docs, id_column, text), "neardup-classes")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    winners = classes.where("n_words > 0").groupBy("c").agg(F.min(first)["k"].alias("k")).select("k")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), key_of(docs[text]).alias("k"), docs[id_column].cast("long").alias("id"))
    hashed = [F.col("_row").getField(f.name) for f in docs.schema.fields if f.name != text and "map<" not in f.dataType.simpleString()]
    own = own.withColumn("tie", F.xxhash64(*hashed) if hashed else F.lit(0))  # rows that differ in other columns only
    one = own.groupBy("k").agg(F.min_by("_row", F.struct(F.col("id").isNull(), "id", "tie")).alias("_row")).join(winners, "k", "left_semi")
    # found by the text alone: a join would shuffle all texts a second time
    empty = docs.where(F.btrim(F.coalesce(docs[text], F.lit("")), F.lit(BLANKS)) == "")
    return one.select("_row.*").unionByName(empty)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
