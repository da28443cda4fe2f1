"""Worlds in which an id may have many records, and double keys in try_insert."""

import pytest

from lattica import Bounds, Conflict, Dim, MemoryStorage, ParquetStorage, Session, World

from .test_world import frame, state


@pytest.fixture(params=["memory", "parquet"])
def make(request, spark, tmp_path):
    def run(**more):
        w = World(spark, [Dim(0, 99, 25), Dim(0, 99, 50)], ["d0", "d1"], **more)
        schema = frame(spark, []).schema
        w.storage = MemoryStorage(spark, schema, w.pos_names) if request.param == "memory" else ParquetStorage(spark, str(tmp_path / "w"), schema, w.pos_names)
        return w

    return run


def test_replace(spark, make):
    w = make(many="replace")
    w.insert(frame(spark, [(1, 10, "a"), (1, 12, "b"), (2, 60, "c"), (3, 70, "d")]))
    old = w.insert(frame(spark, [(1, 90, "e"), (2, 10, "f"), (2, 11, "g")]))
    assert sorted(r.v for r in old.collect()) == ["a", "b", "c"]
    assert state(w) == [(1, 90, "e"), (2, 10, "f"), (2, 11, "g"), (3, 70, "d")]
    rejected = w.try_insert(frame(spark, [(2, 90, "h"), (4, 4, "i"), (4, 5, "j"), (5, 500, "k")]))
    assert sorted(r.v for r in rejected.collect()) == ["h", "k"]
    assert sorted(map(tuple, w.writes().collect())) == [(0, 0, 3), (0, 1, 2)]
    w.delete(w.select(1, 10).at("exact"))
    assert state(w) == [(1, 90, "e"), (2, 11, "g"), (3, 70, "d"), (4, 4, "i"), (4, 5, "j")]
    w.update(w.select(1, Bounds.le(4)).at("exact"), {"d1": "60", "v": "'m'"})
    assert state(w) == [(1, 90, "e"), (2, 11, "g"), (3, 70, "d"), (4, 5, "j"), (4, 60, "m")]
    with Session(w) as s:
        s.insert(frame(spark, [(4, 1, "x"), (6, 6, "y")]))
        s.insert(frame(spark, [(4, 2, "p"), (4, 3, "q")]))
        assert sorted(r.v for r in s.scan().collect()) == ["d", "e", "g", "p", "q", "y"]
    assert state(w) == [(1, 90, "e"), (2, 11, "g"), (3, 70, "d"), (4, 2, "p"), (4, 3, "q"), (6, 6, "y")]


def test_add(spark, make):
    w = make(many="add")
    assert w.insert(frame(spark, [(1, 10, "a"), (1, 10, "a"), (2, 60, "c")])).count() == 0
    assert [r.v for r in w.try_insert(frame(spark, [(1, 10, "b"), (1, 500, "k")])).collect()] == ["k"]
    assert w.insert(frame(spark, [(1, 11, "d")])).count() == 0
    s = Session(w)
    s.insert(frame(spark, [(1, 10, "e")]))
    assert sorted(r.v for r in s.scan().collect()) == ["a", "a", "b", "c", "d", "e"]
    assert [r.v for r in w.at((0, 1)).try_insert(frame(spark, [(2, 60, "f"), (2, 10, "g")])).collect()] == ["g"]
    assert state(w) == [(1, 10, "a"), (1, 10, "a"), (1, 10, "b"), (1, 11, "d"), (2, 60, "c"), (2, 60, "f")]
    for bad in ({"many": "all"}, {"many": "add", "unique_id": True}):
        with pytest.raises(ValueError):
            make(**bad)


@pytest.mark.parametrize("unique_id", [False, True])
def test_try_insert_takes_double_keys_that_are_stored(spark, make, unique_id):
    w = make(unique_id=unique_id)
    w.insert(frame(spark, [(1, 10, "a")]))
    rejected = w.try_insert(frame(spark, [(1, 11, "b"), (1, 12, "c"), (2, 2, "d")]))
    assert sorted(r.v for r in rejected.collect()) == ["b", "c"] and state(w) == [(1, 10, "a"), (2, 2, "d")]
    with pytest.raises(Conflict):
        w.try_insert(frame(spark, [(3, 3, "x"), (3, 4, "y")]))
    assert state(w) == [(1, 10, "a"), (2, 2, "d")]
