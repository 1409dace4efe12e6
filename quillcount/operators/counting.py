"""Counting: per-document statistics and methods, totals, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T
from ..plans.methods import Plan, approximation_rows, method_row

_METHOD = "struct<ord:int,name:string,display_name:string,tokens:bigint,is_exact:boolean,context_window:bigint>"


def document_counts(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """df's other columns, characters, words, lines and m0, m1, ...: the tokens of each planned method; one narrow pass.

    An encoding that several methods share is counted once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    shared: dict[str, str] = {}
    columns = {}
    for m in plan.methods:
        columns[f"m{m.ord}"] = F.col(shared[m.encoding]) if m.encoding in shared else m.tokens(t)
        shared.setdefault(m.encoding, f"m{m.ord}")
    first = {c: e for c, e in columns.items() if c in shared.values()}
    rest = {c: e for c, e in columns.items() if c not in first}
    out = T.with_stats(df, text).withColumns(first) if first else T.with_stats(df, text)
    out = out.withColumns(rest) if rest else out
    return out.drop(text)


def totals(counts: DataFrame, plan: Plan, by: list[str] | None = None, size: str = "characters", skip_errors: bool | None = None) -> DataFrame:
    """file_count, file_size, characters, words, lines and methods by group; partial sums come before the one shuffle.

    methods: planned methods in order, then the approximations, which are derived from the totals. A method that is
    null for some document is left out of an all-methods report, and an error in a report of one model.
    """
    skip = plan.skip_errors if skip_errors is None else skip_errors
    sums = [F.sum(F.col(f"m{m.ord}")).alias(f"m{m.ord}") for m in plan.methods]
    gaps = [F.count_if(F.col(f"m{m.ord}").isNull()).alias(f"gap{m.ord}") for m in plan.methods]
    agg = counts.groupBy(*(by or [])).agg(F.count("*").alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).alias("file_size"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("characters", "words", "lines")), *sums, *gaps)
    rows = []
    for m in plan.methods:
        tokens = F.coalesce(F.col(f"m{m.ord}"), F.lit(0))
        if not skip:
            tokens = F.when(F.col(f"gap{m.ord}") > 0, F.raise_error(F.lit(f"{m.name} failed on a document"))).otherwise(tokens)
        rows.append(F.when((F.lit(not skip)) | (F.col(f"gap{m.ord}") == 0), method_row(F.lit(m.ord), F.lit(m.name), F.lit(m.display_name), tokens, F.lit(m.is_exact), F.lit(m.context_window))))
    planned = F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.array().cast(f"array<{_METHOD}>")
    derived = approximation_rows(F.col("characters"), F.col("words"), plan, len(plan.methods)) if plan.approximations else F.array().cast(f"array<{_METHOD}>")
    return agg.select(*(by or []), "file_count", "file_size", "characters", "words", "lines", F.concat(planned.cast(f"array<{_METHOD}>"), derived.cast(f"array<{_METHOD}>")).alias("methods"))


def report(df: DataFrame, plan: Plan, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """Totals of a table of texts; only the group columns and the text are read."""
    return totals(document_counts(df.select(*(by or []), text), plan, text), plan, by)


def method_rows(totals: DataFrame) -> DataFrame:
    """One row for each method of each report."""
    return totals.select(*(c for c in totals.columns if c != "methods"), F.explode("methods").alias("m")).select("*", "m.*").drop("m")


def primary_method(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each report's methods the first exact one, else the first."""
    first = Window.partitionBy(*by).orderBy(F.desc("is_exact"), "ord")
    return rows.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def running_totals(counts: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Each row with the count and sums of all rows up to it, in the order of a column.

    Ranges of the order (a number), cut at its quantiles, are summed side by side; only one row for each range
    passes through an unpartitioned window, the rest add their range's offset, so no task holds the table.
    """
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({*counts.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01)}) if ranges > 1 else []
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order)) if bounds else F.array()
    parted = counts.withColumn("part", F.size(below))
    own = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parted.withColumns({"files_done": F.count("*").over(own)} | {f"running_{v}": F.sum(v).over(own) for v in values})
    sums = parted.groupBy("part").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s_{v}") for v in values))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select("part", offset("n").alias("n"), *(offset(f"s_{v}").alias(f"s_{v}") for v in values))
    joined = inside.join(F.broadcast(offsets), "part")  # a row for each range
    return joined.select(*counts.columns, (F.col("files_done") + F.col("n")).alias("files_done"), *((F.col(f"running_{v}") + F.col(f"s_{v}")).alias(f"running_{v}") for v in values))


def with_context(rows: DataFrame, tokens: str = "tokens", window: str = "context_window") -> DataFrame:
    return rows.withColumn("context_pct", labels.context_share(F.col(tokens), F.col(window)))


def concatenated(df: DataFrame, order: str, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """All texts of a group joined in order; for small groups, as one value holds them."""
    return df.groupBy(*(by or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))
