"""Dimensions: bounded domains of unsigned integers, cut into chunks of equal width."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import OutOfRange

#: The largest dimension value, and the largest that fits a BIGINT.
U64_MAX, LONG_MAX = 2**64 - 1, 2**63 - 1


@dataclass(frozen=True)
class Bounds:
    """Inclusive bounds; None is unbounded. ``lo > hi`` is an empty range."""

    lo: int | None = None
    hi: int | None = None

    @staticmethod
    def eq(v: int) -> Bounds:
        return Bounds(v, v)

    @staticmethod
    def ge(v: int) -> Bounds:
        return Bounds(v, None)

    @staticmethod
    def gt(v: int) -> Bounds:
        return Bounds(v + 1, None)

    @staticmethod
    def le(v: int) -> Bounds:
        return Bounds(None, v)

    @staticmethod
    def lt(v: int) -> Bounds:
        return Bounds(None, v - 1)

    @staticmethod
    def between(lo: int, hi: int) -> Bounds:
        return Bounds(lo, hi)

    @staticmethod
    def all() -> Bounds:
        return Bounds()

    @staticmethod
    def of(x: Bounds | int | range | slice | None) -> Bounds:
        """An int is one value; a range or a slice is half open, as everywhere in Python; None is everything."""
        if isinstance(x, Bounds):
            return x
        if x is None:
            return Bounds()
        if isinstance(x, int) and not isinstance(x, bool):
            return Bounds.eq(x)
        if isinstance(x, (range, slice)) and x.step in (None, 1):
            return Bounds(x.start, None if x.stop is None else x.stop - 1)
        raise TypeError(f"not a bound: {x!r}")

    def column(self, c: Column) -> Column:
        """The values within the bounds, as a predicate."""
        low = F.lit(True) if self.lo is None else c >= F.lit(self.lo)
        return low if self.hi is None else c <= F.lit(self.hi) if self.lo is None else low & (c <= F.lit(self.hi))


@dataclass(frozen=True)
class Dim:
    """The domain ``lo..=hi`` in chunks of ``width`` values. ``wide`` domains reach beyond BIGINT and use
    DECIMAL(20, 0)."""

    lo: int
    hi: int
    width: int
    wide: bool = False

    def __post_init__(self):
        if self.width < 1 or not 0 <= self.lo <= self.hi <= U64_MAX:
            raise ValueError(f"no dimension: {self.lo}..={self.hi} by {self.width}")
        if (self.hi - self.lo + 1) % self.width:
            raise ValueError(f"the {self.hi - self.lo + 1} values of {self.lo}..={self.hi} are not divisible by {self.width}")
        if self.hi > LONG_MAX and not self.wide:
            raise ValueError("a domain beyond BIGINT needs wide=True")

    @staticmethod
    def of(width: int, domain: Bounds | range | slice | None, wide: bool = False) -> Dim:
        b = Bounds.of(domain)
        return Dim(0 if b.lo is None else b.lo, U64_MAX if b.hi is None else b.hi, width, wide)

    def reaching(self, v: int | None) -> Dim:
        """This dimension, or one whose domain is repeated upwards until it holds the value. Chunks stay where they are."""
        size = self.hi - self.lo + 1
        return self if v is None or v <= self.hi else replace(self, hi=self.lo + -(-(v - self.lo + 1) // size) * size - 1)

    @property
    def chunks_len(self) -> int:
        return (self.hi - self.lo + 1) // self.width

    def __contains__(self, v: int) -> bool:
        return self.lo <= v <= self.hi

    def chunk_of(self, v: int) -> int:
        if v not in self:
            raise OutOfRange((self.lo, self.hi), v)
        return (v - self.lo) // self.width

    def chunks_of(self, bounds: Bounds | int | range | slice | None, clamp: bool = False) -> tuple[int, int]:
        """First and last chunk that the bounds touch. A bound outside the domain is an error, or is moved to
        the domain's edge with ``clamp``. An empty range within one chunk touches it."""
        b = Bounds.of(bounds)
        lo, hi = (self.lo if b.lo is None else b.lo), (self.hi if b.hi is None else b.hi)
        if clamp and lo <= self.hi and hi >= self.lo:
            lo, hi = max(lo, self.lo), min(hi, self.hi)
        first, last = self.chunk_of(lo), self.chunk_of(hi)
        if first > last:
            raise ValueError(f"reversed range {lo}..={hi}")
        return first, last

    def values_of(self, chunk: int) -> tuple[int, int]:
        """First and last value of a chunk."""
        return self.lo + chunk * self.width, self.lo + (chunk + 1) * self.width - 1

    def in_domain(self, c: Column) -> Column:
        low, high = (F.lit(str(self.lo)).cast("decimal(20,0)"), F.lit(str(self.hi)).cast("decimal(20,0)")) if self.wide else (F.lit(self.lo), F.lit(self.hi))
        return F.coalesce(c.between(low, high), F.lit(False))

    def chunk_column(self, c: Column) -> Column:
        """The chunk of each value. Exact for wide domains too, and for values beyond them, as a table that is only
        read may hold: integer division of decimals is not."""
        if not self.wide:
            return F.call_function("div", c.cast("long") - F.lit(self.lo), F.lit(self.width).cast("long"))
        v = c.cast("decimal(38,0)") - F.lit(str(self.lo)).cast("decimal(20,0)")
        w = F.lit(str(self.width)).cast("decimal(20,0)")
        p = ((v - v % w) / w).cast("decimal(20,0)")
        return p if self.chunks_len > LONG_MAX else p.cast("long")
