"""Run statistics without a pass of their own, and cancellation."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.methods import Plan


def observed(counts: DataFrame, plan: Plan, name: str = "counting") -> tuple[DataFrame, Observation]:
    """counts, and an observation that its first action fills: files, bytes, largest, calls and tokens of each method."""
    seen = Observation(name)
    values = [F.count("*").alias("files"), F.coalesce(F.sum("characters"), F.lit(0)).alias("bytes"), F.coalesce(F.max("characters"), F.lit(0)).alias("largest")]
    for m in plan.methods:
        values += [F.count(f"m{m.ord}").alias(f"calls_{m.name}"), F.coalesce(F.sum(f"m{m.ord}"), F.lit(0)).alias(f"tokens_{m.name}")]
    return counts.observe(seen, *values), seen


def tokenizer_calls(metrics: dict) -> int:
    return sum(n for k, n in metrics.items() if k.startswith("calls_"))


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be cancelled from another thread with cancel(); what was stored before stays as it is."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)
