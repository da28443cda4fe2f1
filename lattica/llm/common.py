"""What the operators share: scratch tables, batch sizes and stage helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scratch import kept as stored
from ..functions.scratch import session_dir

__all__ = ["BLOOM", "SPENT", "arrow_flag", "forget_shuffles", "map_arrow", "session_dir", "settings", "stored", "table", "with_columns"]

#: Rows and bytes of one Arrow batch: memory is bounded by texts and not by row counts.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's batch limits to BATCH_ROWS and BATCH_BYTES. They stay lowered: Spark reads them when a
    plan runs, and the results here are lazy."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Lets the optimiser keep rows out of a shuffle by a Bloom filter, of a bounded size, of the other side's keys.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}

#: Spark deletes the shuffle files of a query, on all executors, when it ends. Else they stay until the driver's JVM
#: collects its plan, which a collection right after the query may not yet do.
SPENT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that run within the block."""
    before = {c: spark.conf.get(c, None) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)


def forget_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM for a collection: Spark deletes the shuffle files of an ended query, on all executors,
    when its plan is collected, and a driver that has little to do may not do so for hours."""
    spark._jvm.System.gc()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in bounded batches."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def arrow_flag(df: DataFrame, column: str, test: Callable[[pa.Array], pa.Array]) -> Column:
    """A condition on one column, judged in Python in bounded batches: only that column goes out and only a
    boolean comes back."""
    bounded_batches(df.sparkSession)

    def flag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield test(values)
        release()

    flag.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # as objects: the module's are strings
    return F.arrow_udf(flag, "boolean")(df[column])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, text: str, measure: Callable, added: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row plus the columns ``added`` (a DDL string) that ``measure(column)``,
    given the Arrow array of ``text``, returns as a list of arrays. ``text`` itself goes only if it is kept."""
    wanted = list(dict.fromkeys([*keep, text]))
    more = T.StructType.fromDDL(added)
    schema = T.StructType([*(df.schema[c] for c in keep), *more.fields])
    arrow = to_arrow_schema(schema)
    places, at, source = [wanted.index(c) for c in keep], wanted.index(text), df.select(*wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array(x) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for x in measure(batch.column(at))]
            columns = [*(batch.column(i) for i in places), *new]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return map_arrow(source, run, schema)
