"""Lazy selections: unions of terms (a shape of chunks and ids asked for), and how fine the answer is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.scratch import kept
from ..operators.dims import Bounds
from ..operators.shape import Box, Pos, Shape

if TYPE_CHECKING:
    from ..operators.world import World

#: Beyond so many ids a hint is a join and not a list of literals.
HINT_LITERALS = 10_000


@dataclass(frozen=True)
class Term:
    """A shape of chunks, the exact values asked for, and the ids that a hint within this branch leaves."""

    shape: Shape
    exact: Column
    ids: frozenset[int] | None = None


@dataclass(frozen=True)
class Selection:
    """Combined from left to right: ``select(a).and_(b).plus(c)`` is (a and b) or c. The union of ``terms``, of
    which ``ids``, where there are some, keeps the hinted records.

    ``granularity`` "chunk" returns all rows of the touched chunks, "exact" only those whose values match.
    """

    world: World
    terms: tuple[Term, ...]
    ids: frozenset[int] | None = None
    granularity: str = "chunk"

    @staticmethod
    def of(world: World, box: Box | None, exact: Column, granularity: str = "chunk") -> Selection:
        return Selection(world, (Term(Shape((box,)) if box else Shape(), exact),), None, granularity)

    @property
    def shape(self) -> Shape:
        """The chunks of all terms."""
        return reduce(lambda a, b: a + b, (t.shape for t in self.terms))

    def _slab(self, dim: int, bounds: Bounds | int | range | slice | None) -> tuple[Box | None, Column]:
        return self.world.slab(dim, bounds)

    def and_(self, dim: int, bounds: Bounds | int | range | slice | None, compat: bool | None = None) -> Selection:
        """Intersection. With ``compat`` a slab out of the domain changes nothing and a common part that is
        one chunk thick is dropped."""
        compat = self.world.compat if compat is None else compat
        box, exact = self._slab(dim, bounds)
        if box is None:
            return self if compat else replace(self, terms=(Term(Shape(), F.lit(False)),))
        return replace(self, terms=tuple(Term(t.shape.intersect(box, strict=compat), t.exact & exact, t.ids) for t in self.terms))

    def plus(self, dim: int, bounds: Bounds | int | range | slice | None) -> Selection:
        """Union. A slab out of the domain adds nothing."""
        box, exact = self._slab(dim, bounds)
        return self if box is None else replace(self, terms=_union(self.terms, (Term(Shape((box,)), exact),)))

    def _hinted(self) -> tuple[Term, ...]:
        """The terms, each with the hints that hold for all of them."""
        return self.terms if self.ids is None else tuple(Term(t.shape, t.exact, self.ids if t.ids is None else t.ids & self.ids) for t in self.terms)

    def __or__(self, other: Selection) -> Selection:
        """Rows of either; each keeps its own hints."""
        return replace(self, terms=_union(self._hinted(), other._hinted()), ids=None)

    def __and__(self, other: Selection) -> Selection:
        """Rows of both, hints included."""
        both = (Term(a.shape & b.shape, a.exact & b.exact, b.ids if a.ids is None else a.ids if b.ids is None else a.ids & b.ids) for a, b in product(self._hinted(), other._hinted()))
        return replace(self, terms=reduce(_union, ((t,) for t in both)), ids=None)

    def minus(self, other: Selection) -> DataFrame:
        """Rows of this selection that the other, with its hints, does not select."""
        return self.df().where(~F.coalesce(other._predicate(hints=True), F.lit(False)))

    def hint(self, id_: int) -> Selection:
        return self.hints([id_])

    def hints(self, ids: Iterable[int]) -> Selection:
        """Only records with these ids, as a set that further hints add to."""
        return replace(self, ids=(self.ids or frozenset()) | frozenset(ids))

    def at(self, granularity: str) -> Selection:
        if granularity not in ("chunk", "exact"):
            raise ValueError(granularity)
        return replace(self, granularity=granularity)

    def _among(self, ids: frozenset[int]) -> Column:
        return F.col(self.world.dim_names[0]).isin(sorted(ids)) if ids else F.lit(False)

    def _predicate(self, hints: bool = False) -> Column:
        """``hints``: those of the whole selection too."""
        world = self.world

        def one(term: Term) -> Column:
            if getattr(world.storage, "by_value", False):
                out = term.shape.value_predicate([F.col(c) for c in world.dim_names], world.dims)
            else:
                out = term.shape.predicate([F.col(p) for p in world.pos_names], [d.chunks_len for d in world.dims])
            out = out & term.exact if self.granularity == "exact" else out
            return out if term.ids is None else out & self._among(term.ids)

        whole = reduce(lambda a, b: a | b, map(one, self.terms))
        return whole & self._among(self.ids) if hints and self.ids is not None else whole

    def _order(self) -> list[Column | str]:
        """Box by box, first axis fastest, then id."""
        columns, full, boxes = [F.col(p) for p in self.world.pos_names], [d.chunks_len for d in self.world.dims], self.shape.boxes
        box = F.coalesce(*[F.when(b.predicate(columns, full), i) for i, b in enumerate(boxes)], F.lit(len(boxes)))
        return [box, *reversed(columns), self.world.dim_names[0]]

    def df(self, ordered: bool = False) -> DataFrame:
        """The rows, lazily, with their chunk coordinates. ``ordered``: box by box, first axis fastest, then id."""
        out = self.world.scan(self.shape).where(self._predicate())
        key = self.world.dim_names[0]
        if self.ids is not None and len(self.ids) <= HINT_LITERALS:
            out = out.where(self._among(self.ids))
        elif self.ids is not None:
            out = out.join(self.world.spark.createDataFrame([(i,) for i in self.ids], f"{key} long"), key, "left_semi")
        return out.orderBy(*self._order()) if ordered else out

    def numbered(self, name: str = "place") -> DataFrame:
        """The ordered rows with their place in the order, from 0: sorted by ranges, and counted a partition at a time."""
        part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        rows = kept(self.df(ordered=True).withColumn("_at", F.monotonically_increasing_id()), "ordered")
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        starts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + at).drop("_part", "_at", "_start")

    def rows(self) -> DataFrame:
        """The rows without chunk coordinates."""
        return self.df().drop(*self.world.pos_names)

    def ids_only(self) -> DataFrame:
        """Ids alone; other columns are not read."""
        return self.df().select(self.world.dim_names[0])

    def dims_only(self) -> DataFrame:
        """Dimension values alone; payloads are neither read nor decoded."""
        return self.df().select(*self.world.dim_names)

    def iter(self) -> Iterator[Row]:
        """Rows one by one, a partition at a time on the driver."""
        return self.rows().toLocalIterator()

    def view(self, name: str) -> None:
        """Makes the rows a temporary view for SQL."""
        self.df().createOrReplaceTempView(name)

    def positions(self) -> Iterator[Pos]:
        return self.shape.positions()

    def positions_df(self) -> DataFrame:
        return self.shape.frame(self.world.spark, self.world.pos_names)


def _union(left: tuple[Term, ...], right: tuple[Term, ...]) -> tuple[Term, ...]:
    """Terms with the same hints become one."""
    out = {t.ids: t for t in left}
    if len(out) < len(left):
        return (*left, *right)
    for t in right:
        o = out.get(t.ids)
        out[t.ids] = Term(o.shape + t.shape, o.exact | t.exact, t.ids) if o else t
    return tuple(out.values())


def any_of(selections: Iterable[Selection]) -> Selection:
    return reduce(lambda a, b: a | b, selections)
