"""Token ids packed into rows of a fixed length.

Best-fit-decreasing packing: the pieces of a block go, longest first, each into the open row with the least
room that still holds it; a segment tree over the rooms finds that row in O(log length). A document is its
token ids and the end token; one longer than a row is split into pieces without loss. Blocks are formed
inside the scan's own partitions, so nothing is shuffled, memory is bounded by the block and a lost task is
simply run again.

The vocabulary file is read by the driver alone and sent to the executors. Ids must be numbers or cast to them.
Null and empty texts become the end token alone. Repeated rows are packed as often as they occur; null ids
are carried as nulls. An empty table gives no rows. A very long text yields as many full rows as it needs; its
tokens are held as Python numbers while it is encoded. Blanks in a row, however many, are encoded as the pattern says.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_TOKEN, ROW_LENGTH, BLOCK_TOKENS = 50256, 2048, 1 << 20
#: The pre-tokeniser's pattern that belongs to the vocabulary file, as its readme gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What the pattern's ``\s`` means. Its last but one part tracks back over a run of these and fails on about a million.
BLANKS, LONG_RUN = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 100_000

PACKED = "part int, row long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, content.splitlines())}


@lru_cache(2)
def encoder_of(content: bytes) -> Callable[[str], list[int]]:
    import tiktoken

    ranks = ranks_of(content)
    own, blanks = (tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("own", PATTERN), ("blanks", r"\s+")))
    return whole_runs(own.encode_ordinary, blanks.encode_ordinary)


def whole_runs(encode_text: Callable[[str], list[int]], encode_run: Callable[[str], list[int]], limit: int = LONG_RUN) -> Callable[[str], list[int]]:
    """The encoding of any text. A run of ``limit`` blanks (2 or more) does not go through the pattern's matcher, as it is
    known to be one piece, without its last blank unless the text ends there."""
    run = re.compile(f"(?<![{BLANKS}])[{BLANKS}]{{{limit},}}")

    def encode(text: str) -> list[int]:
        out, done = [], 0
        for m in run.finditer(text) if len(text) >= limit else ():
            end = m.end() - (m.end() < len(text))
            out += encode_text(text[done : m.start()])
            out += encode_run(text[m.start() : end])
            done = end
        return out + encode_text(text[done:])

    return encode


def encoder(path: str) -> Callable[[str], list[int]]:
    with open(path, "rb") as f:
        return encoder_of(f.read())


class Rooms:
    """Open rows by the room they have left: a segment tree that finds the least room of at least n."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.used = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i and not self.used[i]:
            self.used[i] = 1
            i //= 2

    def take(self, n: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) of a row with the least room of at least n."""
        i = n + self.leaves
        while not self.used[i]:
            while i & 1:  # a right child: nothing further right under this parent
                i //= 2
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.used[i] = 0
            i //= 2
            while i and not (self.used[2 * i] or self.used[2 * i + 1]):
                self.used[i] = 0
                i //= 2
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; no row holds more than ``length``."""
    rooms, rows = Rooms(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[piece])
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.add(room - sizes[piece], row)
    return rows


def packed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = ROW_LENGTH, vocabulary: str = VOCABULARY, end: int = END_TOKEN, block: int = BLOCK_TOKENS) -> DataFrame:
    """A row of the id matrix each: ``ids`` are ``length`` little-endian numbers (16 bits, or 32 if a
    token of the vocabulary needs them), filled up with end tokens after ``n_tokens``. Segment i of the row lies between
    ``cu_seqlens[i]`` and ``cu_seqlens[i + 1]`` and is piece ``pieces[i]`` of ``doc_ids[i]``; positions restart
    at each of ``position_resets``."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    kind = np.dtype("<u2") if max(end, *ranks_of(content).values()) < 1 << 16 else np.dtype("<u4")
    shipped = docs.sparkSession.sparkContext.broadcast(content)  # a file of a few MB that executors need not have
    source = docs.select(docs[id_column].cast("long").alias("id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder_of(shipped.value), TaskContext.get()
        part, done = context.partitionId() if context else 0, 0
        waiting: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, tokens, done
            columns: list[list] = [[] for _ in range(8)]
            for row in best_fit_decreasing([len(x[2]) for x in waiting], length):
                parts = [waiting[i] for i in row]
                ids = np.full(length, end, kind)
                cuts = np.cumsum([0, *(len(x[2]) for x in parts)]).tolist()
                for a, b, x in zip(cuts, cuts[1:], parts, strict=False):
                    ids[a:b] = x[2]
                for c, v in zip(columns, (part, done, cuts[-1], [x[0] for x in parts], [x[1] for x in parts], cuts, cuts[:-1], ids.tobytes()), strict=True):
                    c.append(v)
                done += 1
            waiting, tokens = [], 0
            types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "position_resets", "ids"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(body.as_py() or ""), end], kind)
                for k in range(0, len(ids), length):
                    waiting.append((doc, k // length, ids[k : k + length]))
                tokens += len(ids)
                while tokens >= block:
                    yield from flush()
        yield from flush()

    return map_arrow(source, run, PACKED)


def write_packed(packed_rows: DataFrame, path: str) -> None:
    """The matrix as Parquet files, a binary row of ids each."""
    packed_rows.write.parquet(path)


def unpacked(rows: list, end: int = END_TOKEN, wide: bool = False) -> list[tuple[int | None, list[list[int]]]]:
    """(id, pieces in order) again, of documents whose ids are unique: for tests and spot checks.
    ``wide``: the ids have 32 bits."""
    by: dict = {}
    for r in rows:
        width = "I" if wide or end >= 1 << 16 else "H"
        ids = struct.unpack(f"<{len(r.ids) // struct.calcsize(width)}{width}", r.ids)
        for i, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            by.setdefault(doc, {})[piece] = list(ids[r.cu_seqlens[i] : r.cu_seqlens[i + 1]])
    return [(doc, [pieces[k] for k in sorted(pieces)]) for doc, pieces in by.items()]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
