"""Boxes of chunk coordinates and unions of them: what a selection comes down to before any data is read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dims import Dim

Pos = tuple[int, ...]


def _within(c: Column, a: int, b: int, open: tuple[bool, bool]) -> Column:
    """From ``a`` to ``b``, where those sides are not open."""
    if open == (False, False):
        return (c == F.lit(a)) if a == b else c.between(F.lit(a), F.lit(b))
    return c <= F.lit(b) if open == (True, False) else c >= F.lit(a) if open == (False, True) else c.isNotNull()


@dataclass(frozen=True)
class Box:
    """All coordinates from ``start`` to ``end``, both included. ``open`` says for each axis whether its lower and its
    upper side is without a bound: rows beyond the grid, which a table that is only read may hold, are then in the
    box too, as an axis that spans the whole grid asks nothing."""

    start: Pos
    end: Pos
    open: tuple[tuple[bool, bool], ...] = ()

    @staticmethod
    def of(*ranges: tuple[int, int]) -> Box:
        return Box(tuple(a for a, _ in ranges), tuple(b for _, b in ranges))

    @property
    def sides(self) -> tuple[tuple[bool, bool], ...]:
        return self.open or ((False, False),) * len(self.start)

    def __contains__(self, other: Box) -> bool:
        if any(b and not a for x, y in zip(self.sides, other.sides, strict=True) for a, b in zip(x, y, strict=True)):
            return False
        return all(a <= b for a, b in zip(self.start, other.start, strict=True)) and all(a >= b for a, b in zip(self.end, other.end, strict=True))

    def intersect(self, other: Box, strict: bool = False) -> Box | None:
        """The common part; ``strict`` drops one that is a single chunk thick along any axis."""
        start = tuple(map(max, self.start, other.start))
        end = tuple(map(min, self.end, other.end))
        thin = any(b <= a for a, b in zip(start, end, strict=True)) if strict else any(b < a for a, b in zip(start, end, strict=True))
        both = tuple((a and c, b and d) for (a, b), (c, d) in zip(self.sides, other.sides, strict=True))
        return None if thin else Box(start, end, both if any(map(any, both)) else ())

    def __add__(self, other: Box) -> Shape:
        return Shape((self,)) if other in self else Shape((other,)) if self in other else Shape((self, other))

    def positions(self) -> Iterator[Pos]:
        """Every coordinate, the first axis fastest."""
        axes = [range(a, b + 1) for a, b in zip(self.start, self.end, strict=True)]
        return (p[::-1] for p in product(*reversed(axes)))

    def predicate(self, columns: Sequence[Column], full: Sequence[int]) -> Column:
        """Rows in the box; an axis that spans all its ``full`` chunks asks nothing."""
        parts = [_within(c, a, b, open) for c, a, b, open, n in zip(columns, self.start, self.end, self.sides, full, strict=True) if (a, b) != (0, n - 1)]
        return reduce(and_, parts) if parts else F.lit(True)

    def value_predicate(self, columns: Sequence[Column], dims: Sequence[Dim]) -> Column:
        """The same rows by their values: reaches a scan's row groups where coordinates are only computed."""
        parts = [_within(c, d.values_of(a)[0], d.values_of(b)[1], open) for c, a, b, open, d in zip(columns, self.start, self.end, self.sides, dims, strict=True) if (a, b) != (0, d.chunks_len - 1)]
        return reduce(and_, parts) if parts else F.lit(True)

    def frame(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """The coordinates as rows, made on the executors."""
        out = spark.range(self.start[0], self.end[0] + 1).toDF(names[0])
        for name, a, b in zip(names[1:], self.start[1:], self.end[1:], strict=True):
            out = out.withColumn(name, F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))))
        return out


@dataclass(frozen=True)
class Shape:
    """A union of boxes, in the order in which they were added; no box at all is the empty shape."""

    boxes: tuple[Box, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.boxes)

    def __add__(self, other: Shape | Box) -> Shape:
        """Two single boxes merge if one contains the other; beyond that only equal boxes do."""
        other = Shape((other,)) if isinstance(other, Box) else other
        if not self or not other:
            return self or other
        if len(self.boxes) == len(other.boxes) == 1:
            return self.boxes[0] + other.boxes[0]
        return Shape(tuple(dict.fromkeys([*self.boxes, *other.boxes])))

    def intersect(self, box: Box, strict: bool = False) -> Shape:
        found = (b.intersect(box, strict) for b in self.boxes)
        return reduce(lambda a, b: a + b, (Shape((b,)) for b in found if b), Shape())

    def __and__(self, other: Shape) -> Shape:
        return reduce(lambda a, b: a + b, (self.intersect(b) for b in other.boxes), Shape())

    def simplified(self) -> Shape:
        """Without boxes that lie in another."""
        kept: list[Box] = []
        for i, b in enumerate(self.boxes):
            if not any(b in o and (o not in b or j < i) for j, o in enumerate(self.boxes) if j != i):
                kept.append(b)
        return Shape(tuple(kept))

    def positions(self) -> Iterator[Pos]:
        """Every coordinate once, box by box."""
        for i, box in enumerate(self.boxes):
            before = self.boxes[:i]
            yield from (p for p in box.positions() if not any(Box(p, p) in b for b in before))

    def predicate(self, columns: Sequence[Column], full: Sequence[int]) -> Column:
        parts = [b.predicate(columns, full) for b in self.simplified().boxes]
        return reduce(or_, parts) if parts else F.lit(False)

    def value_predicate(self, columns: Sequence[Column], dims: Sequence[Dim]) -> Column:
        parts = [b.value_predicate(columns, dims) for b in self.simplified().boxes]
        return reduce(or_, parts) if parts else F.lit(False)

    def frame(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """The coordinates as rows, each once."""
        parts = [b.frame(spark, names) for b in self.simplified().boxes]
        if not parts:
            return spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
        return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()
