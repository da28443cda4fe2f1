"""A PySpark-native engine for multi-dimensional record stores."""

from .errors import Conflict, Malformed, OutOfRange
from .functions.records import RecordType
from .operators.dims import Bounds, Dim
from .operators.shape import Box, Shape
from .operators.world import World
from .plans.selection import Selection
from .sources.records import RecordStorage
from .sources.storage import ClusteredStorage, MemoryStorage, ParquetStorage, VirtualStorage
from .streaming.flush import Session, write_behind

__all__ = ["Bounds", "Box", "ClusteredStorage", "Conflict", "Dim", "Malformed", "MemoryStorage", "OutOfRange", "ParquetStorage", "RecordStorage", "RecordType", "Selection", "Session", "Shape", "VirtualStorage", "World", "write_behind"]
