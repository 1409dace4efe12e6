"""Comparing the current files with a stored snapshot, and merging what was counted anew.

current: path, size, mtime_ns, digest, classification. Snapshot entries: the same, characters, words, lines and
methods, a map from a contract's name to tokens. The comparison is one full outer join on path and one CASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ("size", "mtime_ns", "digest", "classification")
METADATA, VERIFIED = "metadata", "verified"
SCHEMA_VERSION = 1
#: Reasons that count as incompatibilities of a snapshot.
INCOMPATIBLE = ("schema_mismatch", "root_mismatch", "path_changed", "size_changed", "modtime_changed", "content_changed", "classification_changed", "contract_missing")


def _list(contracts: list[str]) -> Column:
    return F.array(*map(F.lit, sorted({*contracts}))).cast("array<string>")


def plan(current: DataFrame, snapshot: DataFrame | None, contracts: list[str], mode: str, *, root: str = "", snapshot_root: str | None = None, snapshot_version: int | None = SCHEMA_VERSION) -> DataFrame:
    """path, kind (hit, partial_hit, miss, stale), reason, reusable, missing: a decision for every file.

    Without a compatible snapshot everything is a miss: root_mismatch if there is one of another root, else
    schema_mismatch. Mode metadata trusts size and time, mode verified compares digests too.
    """
    if mode not in (METADATA, VERIFIED):
        raise ValueError(f"unsupported mode {mode}")
    wanted = _list(contracts)
    none = F.array().cast("array<string>")
    other_root = snapshot is not None and snapshot_root is not None and snapshot_root != root
    if snapshot is None or other_root or snapshot_version != SCHEMA_VERSION:
        return current.select("path", F.lit("miss").alias("kind"), F.lit("root_mismatch" if other_root else "schema_mismatch").alias("reason"), none.alias("reusable"), wanted.alias("missing"))
    old = snapshot.select("path", *(F.col(c).alias(f"old_{c}") for c in IDENTITY), F.map_keys("methods").alias("have"), F.lit(True).alias("stored"))
    both = current.select("path", *IDENTITY, F.lit(True).alias("present")).join(old, "path", "full_outer")
    reusable = F.array_intersect(wanted, F.coalesce("have", none))
    missing = F.array_except(wanted, F.coalesce("have", none))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    miss = F.when(F.col("stored").isNull(), "entry_missing").when(differs("classification"), "classification_changed").when(differs("size"), "size_changed").when(differs("mtime_ns"), "modtime_changed")
    if mode == VERIFIED:
        miss = miss.when(differs("digest"), "content_changed")
    out = both.withColumns({"miss": miss, "can": reusable, "must": missing, "stale": F.col("present").isNull()})
    kind = F.when(F.col("stale"), "stale").when(F.col("miss").isNotNull(), "miss").when(F.size("must") == 0, "hit").when(F.size("can") == 0, "miss").otherwise("partial_hit")
    reason = F.when(F.col("stale"), "stale_entry").when(F.col("miss").isNotNull(), F.col("miss")).when(F.size("must") == 0, "metadata_assumed" if mode == METADATA else "verified_match").otherwise("contract_missing")
    whole = F.col("miss").isNotNull()
    return out.select("path", kind.alias("kind"), reason.alias("reason"), F.when(F.col("stale") | whole, none).otherwise(F.col("can")).alias("reusable"), F.when(F.col("stale"), none).when(whole, wanted).otherwise(F.col("must")).alias("missing"))


def summary(decisions: DataFrame) -> DataFrame:
    """hits, partial_hits, misses (partial ones too), stale, incompatibilities, reasons ("k=v" sorted, or none)."""
    per = decisions.groupBy("kind", "reason").agg(F.count("*").alias("n"))
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0)).alias
    bad = F.coalesce(F.sum(F.when(F.col("reason").isin(*INCOMPATIBLE), F.col("n"))), F.lit(0))
    current = per.where("kind != 'stale'").groupBy("reason").agg(F.sum("n").alias("n"))
    reasons = current.agg(F.array_join(F.array_sort(F.collect_list(F.concat("reason", F.lit("="), "n"))), ",").alias("reasons"))
    counts = per.agg(of("hit")("hits"), of("partial_hit")("partial_hits"), of("miss", "partial_hit")("misses"), of("stale")("stale"), bad.alias("incompatibilities"))
    return counts.join(reasons, how="cross").select("*", F.when(F.col("reasons") == "", "none").otherwise(F.col("reasons")).alias("r")).drop("reasons").withColumnRenamed("r", "reasons")  # one row each


def _same(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in IDENTITY:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


ENTRY = ("size", "mtime_ns", "digest", "classification", "characters", "words", "lines", "methods")


def merge(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Entries of base with those of updates in: of one identity the methods unite (updates win), else the update replaces."""
    pack = lambda df, name: df.select("path", F.struct(*ENTRY).alias(name))
    both = pack(base, "b").join(pack(updates, "u"), "path", "full_outer")
    united = F.map_zip_with("b.methods", "u.methods", lambda k, x, y: F.coalesce(y, x))
    methods = F.when(F.col("b").isNotNull() & F.col("u").isNotNull() & _same("b", "u"), united).otherwise(F.coalesce("u.methods", "b.methods"))
    return both.select("path", *(F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ENTRY[:-1]), methods.alias("methods"))


def compatible_updates(latest: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose path a newer generation doesn't have, or has with the same identity."""
    theirs = latest.select("path", *(F.col(c).alias(f"their_{c}") for c in IDENTITY), F.lit(True).alias("there"))
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"their_{c}"))
    return updates.join(theirs, "path", "left").where(F.col("there").isNull() | same).select(*updates.columns)


def prune(entries: DataFrame, observed: DataFrame, full_walk: bool) -> DataFrame:
    """Entries whose path was observed; only a full walk approves of it."""
    if not full_walk:
        raise PermissionError("pruning needs a full walk")
    return entries.join(observed.select("path").distinct(), "path", "left_semi")


def materialise(decisions: DataFrame, snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries of all current files: hits from the snapshot, misses from fresh, partial hits with both's methods.

    fresh has a row with identity, statistics and the missing methods for each miss and partial hit.
    """
    kinds = decisions.where("kind != 'stale'").select("path", "kind", "reusable")
    hits = snapshot.join(kinds.where("kind = 'hit'").select("path", "reusable"), "path")
    hits = hits.withColumn("methods", F.map_filter("methods", lambda k, v: F.array_contains("reusable", k))).select("path", *ENTRY)
    kept = snapshot.join(kinds.where("kind = 'partial_hit'").select("path", "reusable"), "path").select("path", F.map_filter("methods", lambda k, v: F.array_contains("reusable", k)).alias("kept"))
    new = fresh.join(kept, "path", "left").withColumn("methods", F.map_zip_with("methods", F.coalesce("kept", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), lambda k, x, y: F.coalesce(x, y)))
    return hits.unionByName(new.select("path", *ENTRY))


def contract_totals(entries: DataFrame) -> DataFrame:
    """contract, files, tokens over all entries; an overflow is an error under ANSI."""
    return entries.select(F.explode("methods").alias("contract", "n")).groupBy("contract").agg(F.count("*").alias("files"), F.sum("n").alias("tokens"))


def checked(entries: DataFrame, most: int = 1_000_000) -> DataFrame:
    """entries, failing where one is out of bounds: paths, sizes, counts, class, number of methods; duplicates fail too."""
    bad_path = (F.octet_length("path") > 4096) | (F.col("path") == "") | F.col("path").rlike(r"^/|\\|\x00|(^|/)\.\.?(/|$)|//|/$")
    negative = F.lit(False)
    for c in ("size", "characters", "words", "lines"):
        negative = negative | (F.col(c) < 0)
    tokens = F.exists(F.map_values("methods"), lambda n: n < 0)
    wrong = bad_path | negative | tokens | ~F.col("classification").isin("text", "binary") | (F.size("methods") > 64)
    out = entries.withColumn("path", F.when(wrong, F.raise_error(F.concat(F.lit("invalid entry: "), "path"))).otherwise(F.col("path")))
    n = entries.agg(F.count("*").alias("n"), F.count_distinct("path").alias("d")).first()
    if n["n"] > most or n["n"] != n["d"]:
        raise ValueError("too many entries" if n["n"] > most else "duplicate path")
    return out
