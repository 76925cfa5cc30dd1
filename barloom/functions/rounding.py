"""Rounding of reported numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column | str, digits: int = 0) -> Column:
    """Half up, with a guard of 1e-6 units so that the order of a distributed sum cannot flip a tie."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** digits)
    return F.floor(x.cast("double") * scale + 0.500001) / scale
