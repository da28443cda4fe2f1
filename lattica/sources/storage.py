"""Where a world's chunks live. Reading is a DataFrame whose chunk coordinates are columns, so that Catalyst
prunes; writing replaces whole chunks."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import delete_path, exists, kept, mark, marks
from ..operators.dims import Dim
from ..operators.shape import Box, Shape

#: A grid of more chunks shares folders, so that their number does not grow with the square of the tables.
MOST_FOLDERS = 512


def grain_of(dims: Sequence[Dim], most: int | None = None) -> tuple[int, ...]:
    """How many chunks along each axis share a folder: one, doubled along the longest axis until folders are few."""
    grain, lengths = [1] * len(dims), [d.chunks_len for d in dims]
    while prod(-(-n // g) for n, g in zip(lengths, grain, strict=True)) > (most or MOST_FOLDERS):
        longest = max(range(len(dims)), key=lambda i: -(-lengths[i] // grain[i]))
        grain[longest] *= 2
    return tuple(grain)


class Storage(Protocol):
    """A back end. ``scan`` alone makes a read-only one. Chunk coordinates are the columns ``pos_names``. ``scan``
    may use the shape to read less, down to the rows of its chunks; callers filter by it in any case."""

    def scan(self, shape: Shape | None = None) -> DataFrame: ...

    def overwrite(self, touched: DataFrame, rows: DataFrame, emptied: list[Row] | None = None) -> None:
        """Replaces the touched chunks by the rows, all of which lie in them; a chunk without rows goes.
        ``emptied`` is an empty list where the caller knows that there are none."""

    def append(self, rows: DataFrame) -> None: ...


class VirtualStorage:
    """Any DataFrame, read only: coordinates are computed on the fly, and selections ask for values, which
    reach the scan."""

    by_value = True

    def __init__(self, df: DataFrame, pos_names: Sequence[str]):
        self.df, self.pos_names = df, list(pos_names)

    def scan(self, shape: Shape | None = None) -> DataFrame:
        return self.df

    def overwrite(self, touched: DataFrame, rows: DataFrame, emptied: list[Row] | None = None) -> None:
        raise NotImplementedError("a virtual world is read only")

    append = overwrite


class MemoryStorage:
    """Rows that live in the session: for tests and small worlds. Every change is written to scratch, so that
    plans don't grow and lost executors cost nothing."""

    def __init__(self, spark: SparkSession, schema: T.StructType, pos_names: Sequence[str]):
        self.pos_names, self.spark = list(pos_names), spark
        self.schema = T.StructType([*schema.fields, *(T.StructField(p, T.LongType()) for p in pos_names if p not in schema.fieldNames())])
        self.df = spark.createDataFrame([], self.schema)

    def scan(self, shape: Shape | None = None) -> DataFrame:
        return self.df

    def overwrite(self, touched: DataFrame, rows: DataFrame, emptied: list[Row] | None = None) -> None:
        self.df = kept(self.df.join(touched, self.pos_names, "left_anti").unionByName(rows.select(*self.schema.fieldNames())), "memory")

    def append(self, rows: DataFrame) -> None:
        self.df = kept(self.df.unionByName(rows.select(*self.schema.fieldNames())), "memory")


class ParquetStorage:
    """A Hive-style folder for each chunk, rows sorted by id within it. With ``dims``, a grid of more than
    MOST_FOLDERS chunks has folders of several chunks, sorted by chunk and id: coordinates are then columns of the
    files, and a mark in the root says how many chunks share a folder.

    Folders are replaced by a dynamic partition overwrite, which leaves partitions without new rows alone, so
    emptied ones are deleted afterwards. A crash between the two leaves the deleted rows of emptied folders in
    place; running the same change again finishes it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, pos_names: Sequence[str], dims: Sequence[Dim] | None = None):
        self.spark, self.root, self.pos_names, self.dims = spark, root.rstrip("/"), list(pos_names), dims
        self.data = T.StructType([f for f in schema.fields if f.name not in pos_names])
        self.schema = T.StructType([*self.data.fields, *(T.StructField(p, T.LongType()) for p in pos_names)])

    @property
    def grain(self) -> tuple[int, ...]:
        """How many chunks along each axis share a folder; what is stored decides."""
        found = marks(self.spark, f"{self.root}/_grain")
        if found:
            return tuple(map(int, found[0].split("-")))
        return (1,) * len(self.pos_names) if self.dims is None or exists(self.spark, self.root) else grain_of(self.dims)

    def _folders(self, grain: tuple[int, ...]) -> dict[str, Column]:
        """The folder of a row by the names of its columns."""
        return {f"{p}_folder": F.call_function("div", F.col(p), F.lit(g).cast("long")) for p, g in zip(self.pos_names, grain, strict=True)}

    def _named(self, grain: tuple[int, ...]) -> list[str]:
        return self.pos_names if max(grain) == 1 else list(self._folders(grain))

    def scan(self, shape: Shape | None = None) -> DataFrame:
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        grain = self.grain
        if max(grain) == 1:
            return self.spark.read.schema(self.schema).parquet(self.root)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, *(T.StructField(c, T.LongType()) for c in self._named(grain))])).parquet(self.root)
        if shape is not None and self.dims is not None:
            rows = rows.where(self._within(shape, grain))
        return rows.select(*self.schema.fieldNames())

    def _within(self, shape: Shape, grain: tuple[int, ...]) -> Column:
        """The folders of the shape's chunks, as a partition filter."""
        down = lambda pos: tuple(p // g for p, g in zip(pos, grain, strict=True))
        full = tuple(d.chunks_len - 1 for d in self.dims)
        whole = [tuple((a, b) == (0, n) for a, b, n in zip(x.start, x.end, full, strict=True)) for x in shape.boxes]
        boxes = dict.fromkeys(Box(down(x.start), down(x.end), tuple((a or w, b or w) for (a, b), w in zip(x.sides, ws, strict=True))) for x, ws in zip(shape.boxes, whole, strict=True))
        columns = [F.col(c) for c in self._named(grain)]
        single = [b.start for b in boxes if b.start == b.end and not any(map(any, b.sides))]
        wide = Shape(tuple(b for b in boxes if b.start != b.end or any(map(any, b.sides)))).predicate(columns, [n // g + 1 for n, g in zip(full, grain, strict=True)])
        return wide | _listed(self._named(grain), single) if single else wide

    def _write(self, rows: DataFrame, mode: str) -> None:
        grain = self.grain
        if max(grain) > 1 and not exists(self.spark, self.root):
            mark(self.spark, f"{self.root}/_grain/" + "-".join(map(str, grain)))
        folders = self._named(grain)
        rows = rows.select(*self.schema.fieldNames(), *([] if max(grain) == 1 else (c.alias(n) for n, c in self._folders(grain).items())))
        dealt = rows.hint("rebalance", *folders)  # a large folder is split, small ones share a task
        order = [*dict.fromkeys([*folders, *self.pos_names]), *self.data.fieldNames()[:1]]
        dealt.sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(self.root)

    def overwrite(self, touched: DataFrame, rows: DataFrame, emptied: list[Row] | None = None) -> None:
        """The new files are complete before any old one goes, so ``rows`` may read the chunks that it replaces. The
        other chunks of their folders are written again as they are."""
        grain = self.grain
        folders, of = self._named(grain), self._folders(grain)
        if max(grain) > 1:
            touched = touched.select(*self.pos_names)
            beside = kept(touched.select(*(c.alias(n) for n, c in of.items())).distinct(), "folders")
            named = [tuple(r) for r in beside.select(*folders).collect()]  # MOST_FOLDERS at most
            if not named:
                return
            if exists(self.spark, self.root):
                stored = self.spark.read.schema(T.StructType([*self.schema.fields, *(T.StructField(c, T.LongType()) for c in folders)])).parquet(self.root)
                others = stored.where(_listed(folders, named)).join(touched, self.pos_names, "left_anti")
                rows = rows.select(*self.schema.fieldNames()).unionByName(others.select(*self.schema.fieldNames()))
            if emptied is None:
                full = {tuple(r) for r in rows.select(*(c.alias(n) for n, c in of.items())).distinct().collect()}
                emptied = [dict(zip(folders, r, strict=True)) for r in named if r not in full]
        elif emptied is None:
            emptied = touched.join(rows.select(*self.pos_names).distinct(), self.pos_names, "left_anti").collect()  # chunk coordinates only
        self._write(rows, "overwrite")
        for r in emptied:
            delete_path(self.spark, f"{self.root}/" + "/".join(f"{c}={r[c]}" for c in folders))

    def append(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            self._write(rows, "append")


def _listed(names: Sequence[str], found: Sequence[tuple[int, ...]]) -> Column:
    """Whether the columns are one of the tuples."""
    if len(names) == 1:
        return F.col(names[0]).isin([r[0] for r in found])
    listed = ", ".join(f"({', '.join(f'{v}L' for v in r)})" for r in found)
    return F.expr(f"({', '.join(names)}) IN ({listed})")


class ClusteredStorage:
    """Coordinates as plain columns in files sorted by chunk and id: for grids of many small chunks, where row
    groups are skipped by their statistics instead of folders by their names. Written once, read only."""

    def __init__(self, spark: SparkSession, root: str, pos_names: Sequence[str]):
        self.spark, self.root, self.pos_names = spark, root.rstrip("/"), list(pos_names)

    def scan(self, shape: Shape | None = None) -> DataFrame:
        return self.spark.read.parquet(self.root)

    def create(self, rows: DataFrame, id_name: str) -> None:
        order = [*self.pos_names, id_name]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(self.root)

    def overwrite(self, touched: DataFrame, rows: DataFrame, emptied: list[Row] | None = None) -> None:
        raise NotImplementedError("a clustered world is read only")

    append = overwrite


def inventory(storage: Storage) -> DataFrame:
    """The stored chunks and their row counts."""
    names = storage.pos_names
    return storage.scan().groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
