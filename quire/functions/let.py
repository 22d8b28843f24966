"""Evaluate a column once and use it several times in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``c``. Without it every use would repeat the whole expression in the plan."""
    return F.get(F.transform(F.array(c), use), F.lit(0))
