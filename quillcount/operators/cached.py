"""Incremental recount of a directory: what a stored generation already has isn't counted again."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.methods import Plan
from ..sources import files, state
from . import counting
from . import invalidation as inv


def _name(method) -> str:
    c = method.contract
    return "|".join((c.method, c.encoding, c.implementation, c.vocabulary_digest, c.normalization_policy, c.special_token_policy))


def current_files(tree: DataFrame, verified: bool) -> DataFrame:
    """Identity of the files of a listing; digests only where contents are compared."""
    digest = T.digest("content") if verified else F.lit(None).cast("string")
    return tree.select(F.col("relative_path").alias("path"), "size", "mtime_ns", digest.alias("digest"), F.lit("text").alias("classification"))


def count_fresh(tree: DataFrame, decisions: DataFrame, plan: Plan) -> DataFrame:
    """Entries of the files of ``tree`` with the methods that their decisions name as missing."""
    todo = decisions.where("kind in ('miss', 'partial_hit')").select("path", "missing")
    rows = tree.withColumn("path", F.col("relative_path")).join(todo, "path")
    rows = rows.withColumn("text", files.as_text(F.col("content")))
    # A method runs where it's missing; elsewhere it sees an empty text.
    out = T.with_stats(rows).withColumn("digest", T.digest("content")).withColumn("classification", F.lit("text"))
    pairs = []
    for m in plan.methods:
        asked = F.array_contains("missing", _name(m))
        pairs.append(F.when(asked, F.struct(F.lit(_name(m)).alias("key"), m.tokens(F.when(asked, F.col("text")).otherwise("")).alias("value"))))
    methods = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull())) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.select("path", *inv.ENTRY[:-1], methods.alias("methods"))


def entry_totals(entries: DataFrame, plan: Plan) -> DataFrame:
    columns = {f"m{m.ord}": F.try_element_at("methods", F.lit(_name(m))) for m in plan.methods}
    return counting.totals(entries.withColumns(columns), plan, size="size")


def count_directory(spark: SparkSession, root: str, plan: Plan, store=None, mode: str = inv.METADATA) -> tuple[DataFrame, DataFrame | None]:
    """(report, decisions) of a directory's text files; with a store, from its latest generation and what is missing.

    Files are listed once. With a store, contents are read of misses and partial hits only (in mode verified, also for the
    digests); whether a file is binary is found by its first bytes when it is read. The driver holds the listing's paths.

    The report is computed before anything is stored. A failing store gives a warning and a cold count, never an
    error. A plan with a method that has no contract isn't stored.
    """
    if store is None or any(m.contract is None for m in plan.methods):
        rows = files.directory(spark, root).withColumn("text", files.as_text(F.col("content"))).select("size", "text")
        return counting.totals(counting.document_counts(rows, plan), plan, size="size"), None
    try:
        snapshot = store.load(root)
    except (OSError, state.StateError) as failure:
        warnings.warn(f"stored counts not used: {failure}", stacklevel=2)
        snapshot = None
    contracts = [_name(m) for m in plan.methods]
    light = mode == inv.METADATA or snapshot is None
    stored = snapshot.entries if snapshot else None
    # One listing, without opening a file; then the contents of what the decisions name, and of nothing else.
    listed = files.walk(root, sniff=False).files
    current = current_files(files.listed_files(spark, root, listed, contents=not light, sniff=not light), not light)
    decisions = inv.plan(current, stored, contracts, mode).cache()
    asked = {r.path for r in decisions.where("kind in ('miss', 'partial_hit')").select("path").collect()}
    tree = files.listed_files(spark, root, [p for p in listed if os.path.relpath(p, root).replace(os.sep, "/") in asked], sniff=True)
    fresh = count_fresh(tree, decisions, plan).cache()
    binary = asked - {r.path for r in fresh.select("path").collect()}
    if binary:  # only now known: they are no files of the tree
        text_only = current.join(spark.createDataFrame([(p,) for p in binary], "path string"), "path", "left_anti")
        decisions = inv.plan(text_only, stored, contracts, mode).cache()
    entries = inv.materialise(decisions, stored, fresh) if snapshot else fresh
    entries = entries.cache()
    if entries.isEmpty():
        raise FileNotFoundError(f"no text files in {root}")
    report = entry_totals(entries, plan)
    rows = report.collect()
    result = spark.createDataFrame(rows, report.schema)
    try:
        changed = decisions.where("kind != 'hit'").select("path")
        updates = entries.join(changed, "path", "left_semi")
        store.commit_and_prune(root, updates, entries.select("path"), snapshot.generation if snapshot else 0)
    except (OSError, PermissionError, state.StateError) as failure:
        warnings.warn(f"counts not stored: {failure}", stacklevel=2)
    return result, decisions
