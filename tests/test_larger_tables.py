"""Queries against their SQL on orders whose ids and customers lie beyond the grids of the given tables, and whose ids
meet those that the batch makes."""

import pytest
from pyspark.sql import functions as F

from lattica import Dim, queries

from .oracle import compare

DOMAINS = ["codec_flat", "codec_nested", "drop_malformed", "insert_unique_id", "update_in_place", "version_dispatch"]
BACK = ["update_moves_chunk"]
IDS = "chunk_rejects insert_last_wins insert_new insert_replace insert_returns_old memory_world session_commit session_reads_pending session_selects stream_flush try_insert_accept try_insert_reject write_counts".split()


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("larger")
    rows = spark.range(0, 600000, 100).select(
        F.col("id").alias("o_orderkey"), F.pmod(F.xxhash64("id"), F.lit(20000)).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        (F.col("id") / 8).alias("o_totalprice"), F.timestamp_seconds(F.lit(800000000) + F.col("id") * 300).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    )
    rows.coalesce(1).write.parquet(str(folder / "orders.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", [*DOMAINS, *BACK, *IDS])
def test_against_sql(spark, larger, name):
    assert compare(queries.queries()[name](spark, larger), queries.oracle_sql()[name], larger)


def test_a_domain_reaches_values():
    dim = Dim(10, 29, 5)
    assert dim.reaching(None) is dim is dim.reaching(29)
    assert dim.reaching(30) == Dim(10, 49, 5) == dim.reaching(49) and dim.reaching(50) == Dim(10, 69, 5)
