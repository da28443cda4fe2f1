"""Dimension mapping, boxes and shapes, without Spark where there is none to test."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica import Bounds, Box, Dim, OutOfRange, Shape, VirtualStorage, World

NINE = Dim.of(3, range(1, 10))


def test_chunk_of():
    assert [NINE.chunk_of(v) for v in (1, 2, 5, 9)] == [0, 0, 1, 2]
    for v in (0, 10, 114):
        with pytest.raises(OutOfRange) as e:
            NINE.chunk_of(v)
        assert e.value.domain == (1, 9) and e.value.value == v


def test_chunks_of():
    assert NINE.chunks_of(range(2, 7)) == (0, 1)
    assert NINE.chunks_of(Bounds.between(2, 7)) == (0, 2)
    assert NINE.chunks_of(Bounds.lt(7)) == (0, 1)
    assert NINE.chunks_of(slice(5, None)) == (1, 2)
    assert NINE.chunks_of(None) == (0, 2) and NINE.chunks_of(Bounds.gt(3)) == (1, 2)
    assert NINE.chunks_of(range(5, 5)) == (1, 1)
    with pytest.raises(ValueError):
        NINE.chunks_of(Bounds(7, 2))
    with pytest.raises(OutOfRange):
        NINE.chunks_of(Bounds.le(50))
    assert NINE.chunks_of(Bounds(-5, 50), clamp=True) == (0, 2)


def test_invalid_dimensions():
    for bad in (lambda: Dim.of(4, range(1, 10)), lambda: Dim(0, 9, 0), lambda: Dim(5, 4, 1), lambda: Dim.of(1, slice(None)), lambda: Dim(-1, 8, 1)):
        with pytest.raises(ValueError):
            bad()
    assert Dim.of(1 << 32, None, wide=True).chunks_len == 1 << 32
    assert Dim(0, 2**64 - 1, 1, wide=True).chunks_len == 2**64
    with pytest.raises(TypeError):
        Bounds.of("x")


def test_boxes():
    box = Box.of((2, 5), (10, 24))
    assert (box.start, box.end) == ((2, 10), (5, 24))
    assert Box((3, 10), (3, 8)) in box
    a = Box.of((0, 10), (1, 11))
    assert a.intersect(Box.of((7, 17), (2, 5))) == a.intersect(Box.of((7, 17), (2, 5)), strict=True) == Box.of((7, 10), (2, 5))
    thin = Box.of((7, 17), (11, 12))
    assert a.intersect(thin, strict=True) is None and a.intersect(thin) == Box.of((7, 10), (11, 11))
    assert a.intersect(Box.of((11, 12), (1, 1))) is None
    assert a + Box.of((1, 10), (3, 4)) == Shape((a,)) == Box.of((1, 10), (3, 4)) + a
    assert (a + Box.of((7, 17), (2, 5))).boxes == (a, Box.of((7, 17), (2, 5)))
    assert list(Box.of((1, 2), (1, 2)).positions()) == [(1, 1), (2, 1), (1, 2), (2, 2)]


def test_shapes():
    shape = Box.of((0, 1), (0, 1)) + Box.of((1, 1), (1, 3))
    assert list(shape.positions()) == [(0, 0), (1, 0), (0, 1), (1, 1), (1, 2), (1, 3)]
    assert Shape() + shape == shape == shape + Shape() and not Shape()
    assert shape + shape.boxes[1] == shape and len((shape + Box.of((0, 0), (0, 0))).boxes) == 3
    assert (shape + Box.of((0, 0), (0, 0))).simplified() == shape
    assert shape.intersect(Box.of((0, 0), (0, 9))) == Shape((Box.of((0, 0), (0, 1)),))
    assert Shape().intersect(Box.of((0, 0), (0, 9))) == Shape()


AXES = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)).map(sorted).map(tuple), min_size=2, max_size=2)


@given(st.lists(AXES, max_size=4), st.lists(AXES, max_size=4))
@settings(max_examples=200, deadline=None)
def test_shape_algebra_is_set_algebra(left, right):
    a, b = (sum((Shape((Box.of(*x),)) for x in boxes), Shape()) for boxes in (left, right))
    as_set = lambda s: set(s.positions())
    assert len(list(a.positions())) == len(as_set(a))
    assert as_set(a + b) == as_set(a) | as_set(b)
    assert as_set(a & b) == as_set(a) & as_set(b)
    assert as_set(a.simplified()) == as_set(a)


def _model(world, steps, compat):
    """Boolean functions of coordinates and values for the selection that the steps build."""
    inside = lambda v: False
    for i, (op, dim, bounds) in enumerate(steps):
        d = world.dims[dim]
        try:
            first, last = d.chunks_of(bounds)
            slab = lambda v, d=d, dim=dim, first=first, last=last: first <= (v[dim] - d.lo) // d.width <= last
        except OutOfRange:
            slab = None
        before = inside
        if i == 0:
            inside = slab or (lambda v: False)
        elif op == "plus":
            inside = (lambda v, a=before, b=slab: a(v) or b(v)) if slab else before
        else:
            inside = (lambda v, a=before, b=slab: a(v) and b(v)) if slab else (lambda v: False)
    return inside


@pytest.fixture(scope="module")
def grid(spark):
    world = World(spark, [Dim(0, 99, 25), Dim(1000, 1999, 100), Dim(0, 7, 8)], ["d0", "d1", "d2"])
    rows = spark.range(100).select(F.col("id").alias("d0"), (1000 + F.col("id") * 37 % 1000).alias("d1"), (F.col("id") % 8).alias("d2"))
    world.storage = VirtualStorage(world.with_pos(rows).cache(), world.pos_names)
    return world


STEP = st.tuples(st.sampled_from(["and_", "plus"]), st.integers(0, 2), st.tuples(st.integers(0, 2100), st.integers(0, 400)).map(lambda x: Bounds(x[0], x[0] + x[1])))


@given(st.lists(STEP, min_size=1, max_size=4))
@settings(max_examples=25, deadline=None)
def test_selections_against_a_row_filter(grid, steps):
    try:
        selection = grid.select(*steps[0][1:])
        for op, dim, bounds in steps[1:]:
            selection = getattr(selection, op)(dim, bounds)
        inside = _model(grid, steps, False)
    except ValueError:
        return
    rows = [tuple(r)[:3] for r in grid.scan().collect()]
    want = sorted(v for v in rows if inside(v))
    assert sorted(tuple(r)[:3] for r in selection.df().collect()) == want
    by_position = selection.shape.predicate([F.col(p) for p in grid.pos_names], [d.chunks_len for d in grid.dims])
    assert sorted(tuple(r)[:3] for r in grid.scan().where(by_position).collect()) == want


IDS = st.none() | st.lists(st.integers(0, 99), max_size=30)


@given(st.lists(st.tuples(STEP, IDS, st.sampled_from(["or", "and", "minus"])), min_size=2, max_size=3), IDS)
@settings(max_examples=25, deadline=None)
def test_hints_in_combinations_against_a_row_filter(grid, parts, last):
    try:
        branches = []
        for step, ids, op in parts:
            picked, inside = grid.select(*step[1:]), _model(grid, [step], False)
            branches.append((picked if ids is None else picked.hints(ids), lambda v, f=inside, ids=ids: f(v) and (ids is None or v[0] in ids), op))
    except ValueError:
        return
    rows = [tuple(r)[:3] for r in grid.scan().collect()]
    selection, want = branches[0][:2]
    for other, inside, op in branches[1:]:
        if op == "minus":
            got = sorted(tuple(r)[:3] for r in selection.minus(other).collect())
            assert got == sorted(v for v in rows if want(v) and not inside(v))
        elif op == "or":
            selection, want = selection | other, lambda v, a=want, b=inside: a(v) or b(v)
        else:
            selection, want = selection & other, lambda v, a=want, b=inside: a(v) and b(v)
    if last is not None:
        selection, want = selection.hints(last), lambda v, a=want: a(v) and v[0] in last
    assert sorted(tuple(r)[:3] for r in selection.df().collect()) == sorted(v for v in rows if want(v))


def test_numbered(grid):
    got = sorted(grid.select(0, Bounds.le(60)).plus(1, 1500).numbered().collect(), key=lambda r: r.place)
    box = lambda r: 0 if r.p0 <= 2 else 1
    assert [r.place for r in got] == list(range(len(got))) and [r.d0 for r in got] == [r.d0 for r in sorted(got, key=lambda r: (box(r), r.p2, r.p1, r.p0, r.d0))]


def test_errors_of_selections(grid):
    with pytest.raises(ValueError):
        grid.select(3, 1)
    with pytest.raises(ValueError):
        grid.select(0, Bounds(60, 10))
    with pytest.raises(ValueError):
        grid.select_all().at("row")
    with pytest.raises(OutOfRange):
        grid.chunk((0, 10, 0))
    with pytest.raises(ValueError):
        World(grid.spark, [], [])
    assert grid.chunk_pos((30, 1999, 7)) == (1, 9, 0)
    assert grid.select(0, 10).hints(range(20_000)).df().count() == 25
    assert sum(1 for _ in grid.select(0, 10).iter()) == 25
    # one chunk in a dimension: the strict form empties every intersection
    assert grid.select(0, slice(None)).and_(1, Bounds(1000, 1999), compat=True).df().count() == 0


def test_plans_prune(spark, tmp_path):
    from lattica import ParquetStorage

    world = World(spark, [Dim(0, 99, 25), Dim(0, 99, 25)], ["d0", "d1"])
    rows = spark.range(100).select(F.col("id").alias("d0"), (F.col("id") * 7 % 100).alias("d1"))
    world.storage = ParquetStorage(spark, str(tmp_path / "w"), rows.schema, world.pos_names)
    world.storage.append(world.with_pos(rows))
    picked = world.select(0, Bounds.le(30)).and_(1, Bounds.lt(50)).plus(0, 99)
    assert len(picked.df().inputFiles()) >= 1
    plan = picked.df()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "p0" in plan.split("PartitionFilters: [")[1].split("]")[0]
    narrow = world.select(0, 10).ids_only()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<d0:bigint>" in narrow
    hinted = world.select(0, 10).hint(5).df()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(d0,5)" in hinted
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnsRenamed({"o_orderkey": "d0", "o_custkey": "d1"})
    virtual = World(spark, [Dim(0, 262143, 1024), Dim(0, 16383, 256)], ["d0", "d1"])
    virtual.storage = VirtualStorage(virtual.with_pos(orders), virtual.pos_names)
    plan = virtual.select(0, 1100).df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,1024)" in plan and "LessThanOrEqual(o_orderkey,2047)" in plan


def test_values_beyond_a_wide_domain_have_exact_chunks(spark):
    dim = Dim(0, 2**64 - 1, 2**44, wide=True)
    values = [0, 2**64 - 1, 2**64, 2**64 + 2**44, 120000000000000 * 8999999]
    rows = spark.createDataFrame([(str(v),) for v in values], "s string").select(dim.chunk_column(F.col("s").cast("decimal(38,0)")).alias("p"))
    assert [r.p for r in rows.collect()] == [v // 2**44 for v in values]


def test_sides_without_a_bound_reach_beyond_the_domain(spark):
    """A table that is only read may hold rows beyond the domain; SQL without a bound returns them."""
    rows = spark.range(100).select(F.col("id").alias("d0"), (F.col("id") * 7 % 100).alias("d1"))
    for clamp in (False, True):
        world = World(spark, [Dim(0, 49, 10), Dim(0, 49, 10)], ["d0", "d1"], clamp=clamp)
        world.storage = VirtualStorage(world.with_pos(rows), world.pos_names)
        got = lambda s: sorted(r.d0 for r in s.df().collect())
        want = lambda f: [i for i in range(100) if f(i // 10, i * 7 % 100 // 10)]
        assert got(world.select(0, Bounds.ge(25))) == want(lambda a, b: a >= 2)
        assert got(world.select(0, Bounds.gt(39))) == got(world.select(0, Bounds.ge(45))) == want(lambda a, b: a >= 4)
        assert got(world.select(0, 45)) == got(world.select(0, Bounds.between(41, 49))) == want(lambda a, b: a == 4)
        assert got(world.select(0, Bounds.between(5, 12)).plus(0, Bounds.ge(40)).and_(1, Bounds.le(15))) == want(lambda a, b: (a <= 1 or a >= 4) and b <= 1)
        assert got(world.select(0, 45).plus(0, Bounds.ge(45))) == got(world.select(0, Bounds.ge(45)) | world.select(0, 45)) == want(lambda a, b: a >= 4)
        assert got(world.select(0, Bounds.ge(25)).and_(0, Bounds.between(30, 49))) == want(lambda a, b: 3 <= a <= 4)
        assert got(world.select_all()) == list(range(100))
        assert got(world.select(0, Bounds.between(25, 10**9))) == (want(lambda a, b: a >= 2) if clamp else [])
        assert [r.d0 for r in world.chunk((4, 0)).collect()] == want(lambda a, b: a == 4 and b == 0)
