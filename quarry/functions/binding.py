"""Values that a plan states once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that the plan states once, however often ``fn`` reads it: an expression that is inlined at each use would grow with every step."""
    return F.element_at(F.transform(F.array(value), fn), 1)
