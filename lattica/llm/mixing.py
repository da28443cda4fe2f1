"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected rate = target / size of the source times. The documents of a source stand
in order of their sizes, equal sizes in a random order; the prefix sum of the expected copies plus one random
offset is cut at the integers, and a document is emitted once per integer it crosses. In this order the words
taken differ from the target by less than the source's largest document.

The prefix sum is never computed in one task: documents are dealt to buckets of one (source, size) and, where many
documents share it, of a hash, and the buckets' totals give each bucket its start. A hot source or size has more
buckets of about sqrt(documents) rows, not larger ones.

Null texts have size 0, null sources are a source of their own, ordered last. Repeated rows and ties in every
key are interchangeable, so reruns agree. An empty table, or one without words, takes nothing. Other columns
pass through. The driver holds one row for each source.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

WEIGHTS, MOST_COPIES, SEED, LEAST_BUCKET = (5, 2, 1), 3, 20240, 200
#: A table of one row for each source, or for each size in each source, is broadcast up to so many rows, else shuffled.
BROADCAST_ROWS = 200_000
SOURCE = "_s string, _k int, _size long, _target double, _rate double"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Shares all sizes out by weight; what would go beyond ``most`` times a source's size is shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, free, out = float(sum(n for _, n in order)), dict(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * free[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = float(most * free.pop(s))
        left = max(0.0, sum(n for _, n in order) - sum(out.values()))
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _copies(rank: Column, rate: Column, offset: Column) -> Column:
    """The integers crossed by the prefix sum at one place of the order."""
    return (F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)).cast("int")


class Plan:
    """Rates and bucket starts of one table, from its slim columns alone."""

    def __init__(self, docs: DataFrame, id_column: str, text: str, source: str):
        spark, c = docs.sparkSession, F.col
        slim = docs.select(docs[id_column].alias("i"), docs[source].alias("s"), word_count(docs[text]).alias("n"), F.xxhash64(docs[text]).alias("h"))
        self.slim = stored(slim, "mix-sizes")
        counted = stored(self.slim.groupBy("s", "n").agg(F.count(F.lit(1)).alias("d")), "mix-histogram")
        found = counted.groupBy("s").agg(F.sum(c("n") * c("d")).alias("n"), F.sum("d").alias("d")).collect()  # a row for each source
        goal = targets([(r.s, r.n) for r in found])
        order = sorted(found, key=lambda r: (r.s is None, r.s or ""))
        bucket = max(LEAST_BUCKET, isqrt(sum(r.d for r in found)))
        rows = [(r.s, k, r.n, goal[r.s], goal[r.s] / r.n if r.n else 0.0) for k, r in enumerate(order)]
        sources = spark.createDataFrame(rows, SOURCE)
        placed = counted.join(_small(sources, len(rows)), c("s").eqNullSafe(c("_s")))
        self.sizes = stored(placed.select("_s", "_k", c("n").alias("_of"), "_size", "_target", "_rate", F.ceil(c("d") / bucket).alias("_buckets")), "mix-buckets")
        self.n_sizes = self.sizes.count()
        within = Window.partitionBy("_k").orderBy("_of", "_b").rowsBetween(Window.unboundedPreceding, -1)  # the buckets of a source, not its documents
        counts = self._dealt(self.slim, c("i"), c("s"), c("n"), c("h")).groupBy("_k", "_of", "_b").agg(F.count(F.lit(1)).alias("_in"))
        self.starts = stored(counts.select("_k", "_of", "_b", F.coalesce(F.sum("_in").over(within), F.lit(0)).alias("_start")), "mix-starts")
        self.n_starts = self.starts.count()

    def _dealt(self, df: DataFrame, i: Column, s: Column, n: Column, h: Column) -> DataFrame:
        """Adds the source's number and rate and the row's bucket."""
        own = df.withColumns({"_i": i, "_own": s, "_n": n, "_h": h})
        placed = own.join(_small(self.sizes, self.n_sizes), F.col("_own").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_of")))
        return placed.withColumn("_mix", F.xxhash64(F.lit(SEED), "_i", "_n", "_h")).withColumn("_b", F.pmod(F.col("_mix"), F.col("_buckets")))

    def copies(self, df: DataFrame, i: Column, s: Column, n: Column, h: Column) -> DataFrame:
        """The rows with _n, _size, _target and _copies beside their own columns."""
        order = Window.partitionBy("_k", "_of", "_b").orderBy("_mix", "_i", "_h")
        dealt = self._dealt(df, i, s, n, h).withColumn("_at", F.row_number().over(order))
        rank = (F.col("_start") + F.col("_at")).cast("double")
        offset = _unit(F.lit(SEED), F.col("_k"))
        return dealt.join(_small(self.starts, self.n_starts), ["_k", "_of", "_b"]).withColumn("_copies", _copies(rank, F.col("_rate"), offset))


def mixed_sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken, a row for each document."""
    plan = Plan(docs, id_column, text, source)
    c = F.col
    rows = plan.copies(plan.slim, c("i"), c("s"), c("n"), c("h"))
    return rows.select(c("i").alias(id_column), c("_n").alias("size"), c("_size").alias("source_size"), c("_target").alias("target"), c("_copies").alias("copies"), (c("_copies") * c("_n")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    plan = Plan(docs, id_column, text, source)
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    field = lambda name: F.col("_row").getField(name)
    rows = plan.copies(own, field(id_column), field(source), word_count(field(text)), F.xxhash64(field(text)))
    return rows.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))
