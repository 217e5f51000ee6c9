"""Windows over one station's daily series.

Scale contract: daily tables hold one row per (key, date), so a window group is
bounded by the calendar (366 rows a year), however many stations there are and
however unevenly the raw readings were spread before the daily collapse.
Look-ahead never uses a "current row to unbounded following" frame, which Spark
evaluates in quadratic time: the series is walked backwards instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F

from zephyria import config

KEYS = (config.STATION,)
ORDER = config.DATE


def forward(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(order).asc())


def backward(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(order).desc())


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(rows: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return forward(keys, order).rowsBetween(1 - rows, Window.currentRow)


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)
