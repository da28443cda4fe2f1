"""Changes against a model, on folders, in memory and through sessions and streams."""

import random

import pytest

from lattica import Bounds, Conflict, Dim, MemoryStorage, OutOfRange, ParquetStorage, Session, VirtualStorage, World

SCHEMA = "d0 long, d1 long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(params=["memory", "parquet"])
def world(request, spark, tmp_path):
    w = World(spark, [Dim(0, 99, 25), Dim(0, 99, 50)], ["d0", "d1"])
    schema = frame(spark, []).schema
    w.storage = MemoryStorage(spark, schema, w.pos_names) if request.param == "memory" else ParquetStorage(spark, str(tmp_path / "w"), schema, w.pos_names)
    return w


def state(world):
    rows = world.scan().collect()
    for r in rows:
        assert (r.p0, r.p1) == world.chunk_pos((r.d0, r.d1))
    return sorted((r.d0, r.d1, r.v) for r in rows)


def test_a_random_history(spark, world):
    rnd, model = random.Random(6), {}
    key = lambda r: (*world.chunk_pos(r[:2]), r[0])
    for turn in range(8):
        batch = {key(r): r for r in [(rnd.randrange(100), rnd.randrange(100), f"{turn}.{i}") for i in range(12)]}
        kind = rnd.choice(["insert", "try", "remove", "delete", "move"]) if turn else "insert"
        if kind == "insert":
            old = world.insert(frame(spark, list(batch.values())))
            assert sorted(map(tuple, old.collect())) == sorted(model[k] for k in batch if k in model)
            model |= batch
        elif kind == "try":
            rejected = world.try_insert(frame(spark, [*batch.values(), (5, 500, "out")]))
            assert sorted(map(tuple, rejected.collect())) == sorted([*(r for k, r in batch.items() if k in model), (5, 500, "out")])
            model = batch | model
        elif kind == "remove":
            ids = [r[0] for r in model.values()][:4]
            gone = world.remove(ids)
            assert sorted(map(tuple, gone.collect())) == sorted(r for r in model.values() if r[0] in ids)
            model = {k: r for k, r in model.items() if r[0] not in ids}
        elif kind == "delete":
            world.delete(world.select(0, 30).and_(1, 10))
            model = {k: r for k, r in model.items() if k[:2] != (1, 0)}
        else:
            moved = {k: (r[0], (r[1] + 50) % 100, r[2] + "m") for k, r in model.items()}
            world.update(world.select_all(), {"d1": "(d1 + 50) % 100", "v": "concat(v, 'm')"})
            model = {key(r): r for r in moved.values()}
        assert state(world) == sorted(model.values())


def test_there_and_back_and_emptied_chunks(spark, world):
    world.insert(frame(spark, [(1, 10, "a")]))
    for d1 in (90, 10):
        world.update(world.select(0, 1), {"d1": f"{d1}"})
        assert state(world) == [(1, d1, "a")]
        assert [tuple(r) for r in world.chunks().collect()] == [(0, d1 // 50, 1)]
    world.delete(world.select_all())
    assert state(world) == [] and world.chunks().count() == 0
    assert world.delete(world.select_all()).count() == 0


def test_errors_leave_the_world_alone(spark, world):
    world.insert(frame(spark, [(1, 10, "a"), (2, 60, "b"), (1, 60, "c")]))
    before = state(world)
    with pytest.raises(OutOfRange):
        world.insert(frame(spark, [(3, 3, "x"), (100, 3, "y")]))
    with pytest.raises(OutOfRange):
        world.update(world.select_all(), {"d1": "d1 + 90"})
    with pytest.raises(Conflict):
        world.insert(frame(spark, [(3, 3, "x"), (3, 4, "y")]))
    with pytest.raises(Conflict):
        world.update(world.select(1, 10), {"d1": "70"})
    for column in ("d0", "p0"):
        with pytest.raises(ValueError):
            world.update(world.select_all(), {column: "1"})
    with pytest.raises(OutOfRange):
        world.insert(frame(spark, [(None, 3, "x")]))
    assert state(world) == before
    virtual = World(spark, world.dims, ["d0", "d1"], storage=VirtualStorage(world.scan(), world.pos_names))
    with pytest.raises(NotImplementedError):
        virtual.insert(frame(spark, [(9, 9, "z")]))


def test_remove_in_one_chunk(spark, world):
    world.insert(frame(spark, [(1, 10, "a"), (1, 60, "c")]))
    assert [r.v for r in world.remove([1], pos=(0, 1)).collect()] == ["c"]
    assert state(world) == [(1, 10, "a")]


def test_session(spark, world):
    with Session(world) as s:
        s.insert(frame(spark, [(1, 10, "a")]))
        s.insert(frame(spark, [(1, 12, "b"), (2, 2, "c")]))
        assert sorted(r.v for r in s.scan().collect()) == ["b", "c"] and state(world) == []
    assert state(world) == [(1, 12, "b"), (2, 2, "c")]
    with pytest.raises(KeyError), Session(world) as s:
        s.insert(frame(spark, [(9, 9, "z")]))
        raise KeyError
    assert len(state(world)) == 2


def test_session_ties_and_selections(spark, world):
    world.insert(frame(spark, [(1, 10, "a"), (30, 60, "z")]))
    s = Session(world)
    s.insert(frame(spark, [(1, 12, "b"), (2, 80, "c")]))
    assert sorted(r.v for r in s.select(1, 10).df().collect()) == ["b"]
    assert sorted(r.v for r in (s.select(1, 60) | s.select(0, 1).hint(2)).df().collect()) == ["c", "z"]
    with pytest.raises(NotImplementedError):
        s.view().insert(frame(spark, [(9, 9, "z")]))
    for both in ([(3, 3, "x"), (3, 4, "y")], [(1, 13, "x"), (1, 14, "y")]):
        s = Session(world)
        s.insert(frame(spark, both))
        with pytest.raises(Conflict):
            s.commit()
    assert state(world) == [(1, 10, "a"), (30, 60, "z")]


def test_one_chunk(spark, world):
    chunk = world.at((0, 1))
    with pytest.raises(OutOfRange):
        chunk.insert(frame(spark, [(1, 60, "a"), (1, 10, "b")]))
    with pytest.raises(OutOfRange):
        world.at((4, 0))
    assert state(world) == []
    chunk.insert(frame(spark, [(1, 60, "a")]))
    rejected = chunk.try_insert(frame(spark, [(1, 61, "b"), (2, 70, "c"), (2, 10, "d"), (500, 60, "e"), (None, 60, "f")]))
    assert sorted(r.v for r in rejected.collect()) == ["b", "d", "e", "f"]
    assert [r.v for r in chunk.rows().orderBy("d0").collect()] == ["a", "c"]
    assert chunk.holds(frame(spark, [(24, 99, "")])) and not chunk.holds(frame(spark, [(24, 99, ""), (25, 99, "")]))


def test_a_custom_back_end(spark):
    """A storage that is asked for the chunks of a selection and gives no others."""
    asked = []

    class Rows:
        pos_names = ["p0", "p1"]

        def scan(self, shape=None):
            asked.append(None if shape is None else list(shape.positions()))
            return world.with_pos(frame(spark, [(i, i, str(i)) for i in range(100) if shape is None or (i // 25, i // 50) in asked[-1]]))

    world = World(spark, [Dim(0, 99, 25), Dim(0, 99, 50)], ["d0", "d1"], Rows())
    assert world.select(0, 30).and_(1, Bounds.lt(50)).df().count() == 25 and asked == [[(1, 0)]]
    assert world.at((3, 1)).rows().count() == 25 and asked[-1] == [(3, 1)]


def test_many_changes_keep_no_plans(spark, world):
    world.insert(frame(spark, [(1, 10, "a")]))
    held = len(vars(world))
    for i in range(5):
        world.insert(frame(spark, [(1, 10, str(i))]))
    assert len(vars(world)) == held and not any(isinstance(x, list) and len(x) > 2 for x in vars(world).values())
    assert [tuple(r) for r in world.writes().collect()] == [(0, 0, 6)]


def test_results_survive_later_changes(spark, world):
    world.insert(frame(spark, [(1, 10, "a"), (2, 10, "b")]))
    old = world.insert(frame(spark, [(1, 11, "n")]))
    world.delete(world.select(0, Bounds.all()))
    assert [tuple(r) for r in old.collect()] == [(1, 10, "a")]


def test_write_counts_and_views(spark, world):
    world.insert(frame(spark, [(1, 10, "a"), (30, 60, "b")]))
    world.try_insert(frame(spark, [(1, 10, "x"), (2, 60, "c")]))
    world.update(world.select(0, 30), {"v": "'z'"})
    assert sorted(map(tuple, world.writes().collect())) == [(0, 0, 1), (0, 1, 1), (1, 1, 2)]
    world.select(1, 60).view("far")
    assert [r.v for r in spark.sql("SELECT v FROM far ORDER BY d0").collect()] == ["c", "z"]
    world.set_chunks_limit(None)
