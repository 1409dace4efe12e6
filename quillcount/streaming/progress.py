"""Counting as a stream: running totals over documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counting import document_counts
from ..plans.methods import Plan


_SAVED = "number long, files_done long, characters long, words long, lines long, tokens map<string,bigint>"


@dataclass
class Progress:
    """Totals so far; tokens by method."""

    files_done: int = 0
    characters: int = 0
    words: int = 0
    lines: int = 0
    tokens: dict | None = None


def _saved(spark: SparkSession, folder: str, plan: Plan) -> tuple[int, Progress]:
    """The last batch that a checkpoint has totals of, and these; -1 and zeros for a new one."""
    try:
        row = spark.read.json(f"{folder}/batch-*", schema=_SAVED).orderBy(F.desc("number")).first()
    except AnalysisException:  # no such folder yet
        row = None
    if row is None:
        return -1, Progress(tokens={})
    return row["number"], Progress(row["files_done"], row["characters"], row["words"], row["lines"], dict(row["tokens"] or {}))


def stream_totals(stream: DataFrame, plan: Plan, on_progress: Callable[[Progress], None], checkpoint: str, text: str = "text"):
    """Start a query that counts each micro-batch and reports the totals after it; a batch given twice counts once.

    The totals after each batch are kept beside the checkpoint, so a query that starts again from it goes on from
    there. One row a batch reaches the driver. The returned query is stopped, or awaited, by its owner.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint.rstrip('/')}/totals"
    last, state = _saved(spark, folder, plan)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batch(df: DataFrame, number: int) -> None:
        nonlocal last
        if number <= last:
            return
        counts = document_counts(df.select(text), plan, text)
        row = counts.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("characters", "words", "lines")), *(F.coalesce(F.sum(f"m{m.ord}"), F.lit(0)).alias(f"m{m.ord}") for m in plan.methods)).first()
        state.files_done += row["n"]
        for c in ("characters", "words", "lines"):
            setattr(state, c, getattr(state, c) + row[c])
        for m in plan.methods:
            state.tokens[m.name] = state.tokens.get(m.name, 0) + row[f"m{m.ord}"]
        saved = spark.createDataFrame([(number, *asdict(state).values())], _SAVED)
        saved.coalesce(1).write.mode("overwrite").json(f"{folder}/batch-{number}")
        files.delete(path(f"{folder}/batch-{number - 2}"), True)
        last = number
        on_progress(Progress(**asdict(state)))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grouped_totals(stream: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """A streaming frame of documents, characters, words and lines by group, for output mode complete or update."""
    from ..functions.text import with_stats

    return with_stats(stream, text).groupBy(*by).agg(F.count("*").alias("files_done"), *(F.sum(c).alias(c) for c in ("characters", "words", "lines")))
