"""Folders of several chunks: the changes of test_world on them, and how many there are."""

import os

import pytest
from pyspark.sql import functions as F

from lattica import Bounds, Dim, ParquetStorage, World
from lattica.sources import storage

from .test_world import frame, test_a_random_history, test_errors_leave_the_world_alone, test_one_chunk, test_there_and_back_and_emptied_chunks, test_write_counts_and_views  # noqa: F401


@pytest.fixture(params=[1, 2])
def world(request, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "MOST_FOLDERS", request.param)
    w = World(spark, [Dim(0, 99, 25), Dim(0, 99, 50)], ["d0", "d1"])
    w.storage = ParquetStorage(spark, str(tmp_path / "w"), frame(spark, []).schema, w.pos_names, w.dims)
    return w


def test_grain():
    grid = lambda *n: [Dim(0, 10 * x - 1, 10) for x in n]
    assert storage.grain_of(grid(32, 4)) == (1, 1) and storage.grain_of(grid(512)) == (1,)
    assert storage.grain_of(grid(513)) == (2,) and storage.grain_of(grid(560, 220)) == (32, 8)
    assert storage.grain_of([Dim(0, 2**64 - 1, 1, wide=True)], 4) == (2**62,)


def test_folders_grow_no_faster_than_the_rows(spark, tmp_path):
    """10,000 chunks: a folder for each would be 1,250 folders for these rows."""
    rows = spark.range(0, 10000, 8).select(F.col("id").alias("d0"), (F.col("id") * 37 % 10000).alias("d1"))
    model = {(i, i * 37 % 10000) for i in range(0, 10000, 8)}
    world = World(spark, [Dim(0, 9999, 100), Dim(0, 9999, 100)], ["d0", "d1"])
    world.storage = ParquetStorage(spark, str(tmp_path / "w"), rows.schema, world.pos_names, world.dims)
    world.storage.append(world.with_pos(rows))
    folders = lambda: {os.path.relpath(d, tmp_path / "w") for d, _, names in os.walk(tmp_path / "w") if any(n.endswith(".parquet") for n in names)}
    assert len(folders()) <= storage.MOST_FOLDERS and world.chunks().count() == len({(a // 100, b // 100) for a, b in model})
    again = World(spark, world.dims, ["d0", "d1"], ParquetStorage(spark, world.storage.root, rows.schema, world.pos_names))
    for w in (world, again):
        got = w.select(0, Bounds.between(150, 420)).and_(1, Bounds.ge(3000)).plus(1, 5).df()
        assert {(r.d0, r.d1) for r in got.collect()} == {(a, b) for a, b in model if 1 <= a // 100 <= 4 and b >= 3000 or b < 100}
    plan = world.select(0, 150).df()._jdf.queryExecution().executedPlan().toString()
    assert "p0_folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = folders()
    for w, lo in ((world, 0), (again, 5000)):
        w.delete(w.select(0, Bounds.between(lo, lo + 4950)).and_(1, Bounds.lt(5000)))
        model = {(a, b) for a, b in model if not (lo <= a < lo + 5000 and b < 5000)}
        assert {(r.d0, r.d1) for r in w.scan().collect()} == model
    assert folders() < before
