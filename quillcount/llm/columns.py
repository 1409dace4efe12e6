"""Column helpers of the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with value computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(values: Column) -> Column:
    """An array cut in arrays of ``BLOCK`` elements; one empty block of an empty array."""
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
