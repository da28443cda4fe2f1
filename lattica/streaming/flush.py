"""Write-behind: streams and sessions that commit to a world in batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dims import Bounds
from ..operators.shape import Shape
from ..operators.world import World
from ..plans.selection import Selection


def write_behind(world: World, stream: DataFrame, checkpoint: str, order: str | None = None, every: str | None = None) -> StreamingQuery:
    """Upserts each micro-batch of a stream. A batch that is run again after a failure changes nothing more,
    as an upsert by key is idempotent; so not in a world that adds. Where an id may have many records, those that
    belong together must come in one batch. ``every`` is a trigger interval; without it all that is there is
    processed and the query ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(lambda batch, _: world.insert(batch, order) and None).start()


class Session:
    """Collects inserts and commits them together, at the latest on leaving the ``with`` block; after an error
    in the block nothing that is still pending is written. Reads and selections see pending rows over stored
    ones. A key twice in one insert is a conflict, as without a session; of two inserts the later wins."""

    def __init__(self, world: World):
        self.world, self.pending = world, []

    def __enter__(self) -> Session:
        return self

    def insert(self, df: DataFrame) -> None:
        self.pending.append(df.withColumn("_turn", F.lit(len(self.pending))))

    def _together(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.pending)

    def scan(self, shape: Shape | None = None) -> DataFrame:
        """The world as it will be: pending rows over stored ones."""
        base = self.world.scan(shape)
        if not self.pending:
            return base
        new, _, _ = self.world._incoming(self._together(), "_turn", strict=True)
        if self.world.many == "add":
            return base.unionByName(new.select(*base.columns))
        return base.join(new.select(*self.world._key), self.world._key, "left_anti").unionByName(new.select(*base.columns))

    def view(self) -> World:
        """The world as it will be, read only: every selection works on it."""
        w = self.world
        return World(w.spark, w.dims, w.dim_names, _Overlay(self, w.pos_names), compat=w.compat, clamp=w.clamp, unique_id=w.unique_id, many=w.many)

    def select(self, dim: int, bounds: Bounds | int | range | slice | None = None, granularity: str = "chunk") -> Selection:
        return self.view().select(dim, bounds, granularity)

    def select_all(self) -> Selection:
        return self.view().select_all()

    def commit(self) -> None:
        if self.pending:
            self.world.insert(self._together(), order="_turn")
            self.pending = []

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.commit()


class _Overlay:
    """A session's state as a read-only storage."""

    def __init__(self, session: Session, pos_names: list[str]):
        self.session, self.pos_names = session, pos_names

    def scan(self, shape: Shape | None = None) -> DataFrame:
        return self.session.scan(shape)

    def overwrite(self, touched: DataFrame, rows: DataFrame, emptied: list[Row] | None = None) -> None:
        raise NotImplementedError("pending rows change through their session")

    append = overwrite
