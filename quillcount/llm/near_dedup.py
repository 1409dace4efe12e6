"""b-bit MinHash near-duplicate groups.

Per row, one pass over its bytes gives the set of hashed word shingles, its 128-bit digest, its minima under
``PERMUTATIONS`` hash functions, one 64-bit key for each band of ``ROWS`` minima, and the low ``BITS`` bits of all minima
packed into longs. Rows with equal digests of their whole sets collapse to one representative first; the digest is
cryptographic (BLAKE2), so equal digests stand for equal sets. Representatives that share a band
key are candidates: each against the hub of its bucket, and after these links are merged, those pairs of a
hub's group that still lie in different components and share one of their rarest shingles. A candidate is estimated by XOR and bit counts of the packed
signatures, corrected for chance collisions of b bits; those far below the threshold go, all others are
confirmed on the full sets. With 24 bands of 4 minima a pair of similarity 0.8 shares a band with probability
1 - 3e-6, and the estimate's cut lies seven standard errors below 0.8.

Hubs hold no join back: a hub's own side of a join is repeated, once for each ``SPLIT`` rows around it, and the rows are dealt
over the copies.

Results: null and empty texts, and texts without words, have an empty set and are linked with nothing. A text
with fewer words than a shingle has one shingle, the whole sequence. Ties and repeated rows: equal sets form
one component. Rows, not doc_ids, are linked: a doc_id that stands in several rows gives that many rows, each in the
component of its own text; component_id is the smallest doc_id of a component's rows. Columns beyond those named are
ignored. Rows with a null doc_id are linked with nothing, have a null component_id and are kept. An empty table
gives an empty result. ``drop_near_duplicates`` keeps one row of each component: that of the smallest doc_id, of
several the one whose text has the smallest hash, of rows that repeat both any one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .components import components
from .staging import staged

PERMUTATIONS, ROWS, BITS = 96, 4, 4
BANDS = PERMUTATIONS // ROWS
PER_LONG = 64 // BITS
LONGS = PERMUTATIONS // PER_LONG
#: Standard errors between the threshold and the cut of the estimate.
SLACK = 7
#: Rows around a hub for each copy of its side of a join.
SPLIT = 256

SPACE = scan.byte_class(b" \t\n\v\f\r")
_A, _B = scan.constants(PERMUTATIONS, 1)[:, None], scan.constants(PERMUTATIONS, 2)[:, None]
_ORDER = scan.constants(64, 3)
_BAND = scan.constants(ROWS, 4)
_SALT = scan.constants(BANDS, 5)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its runs of ``width`` words, A-Z lower-cased."""
    order = np.resize(_ORDER, width)
    for _, _, data, off in scan.slices(column):
        starts, ends = scan.spans_of(data, off, ~SPACE)
        words = scan.range_hash(scan.prefix_hash(data, scan.FOLDED_CODES), starts, ends)
        first = np.searchsorted(starts, off)
        runs = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for j in range(width):
            runs += words[j : j + len(runs)] * order[j]
        runs = scan.mix(runs + np.uint64(width))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield scan.mix((words[a:b] * order[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield runs[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    low = None
    for i in range(0, len(shingles), 4096):
        part = (shingles[None, i : i + 4096] * _A + _B).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


_LONG_COLUMNS = ("doc_id", "text_hash", "n", "h1", "h2")
_SIGNED = tuple(f"s{i}" for i in range(LONGS))
_SIGNATURE = pa.schema([*((c, pa.int64()) for c in _LONG_COLUMNS), ("bands", pa.list_(pa.int64())), *((c, pa.int64()) for c in _SIGNED)])
_SIGNATURE_DDL = "".join(f"{c} long, " for c in _LONG_COLUMNS) + "bands array<long>, " + ", ".join(f"{c} long" for c in _SIGNED)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(shingles), digest_size=16).digest()


def _signatures(width: int):
    shifts = (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            lows = np.zeros((batch.num_rows, PERMUTATIONS), np.uint64)
            for i, s in enumerate(shingle_sets(batch.column(2), width)):
                n.append(len(s))
                digests.append(_digest(s))
                if len(s):
                    lows[i] = minima(s)
            keys = scan.mix((lows.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + _SALT)
            low_bits = (lows ^ (lows >> np.uint64(32))) & np.uint64((1 << BITS) - 1)
            packed = (low_bits.reshape(-1, PER_LONG) << shifts).sum(axis=1, dtype=np.uint64).reshape(-1, LONGS)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), scan.int64(keys.ravel()))
            halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(scan.int64(np.ascontiguousarray(halves[:, i])) for i in (0, 1)), bands, *(scan.int64(np.ascontiguousarray(packed[:, i])) for i in range(LONGS))], schema=_SIGNATURE)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), width))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            halves = np.frombuffer(b"".join(map(_digest, found)), np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(scan.int64(np.ascontiguousarray(halves[:, i])) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(offsets), scan.int64(values))], names=["doc_id", "h1", "h2", "shingles"])

    return run


def estimate(left: str, right: str) -> Column:
    """Similarity from the share of equal b-bit groups, corrected for chance: (share - 2**-b) / (1 - 2**-b)."""
    ones = sum(1 << (BITS * i) for i in range(PER_LONG))
    unequal = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{left}s{i}").bitwiseXOR(F.col(f"{right}s{i}"))
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)))
    chance = 2.0**-BITS
    return (F.lit(1.0) - unequal / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def _cut(percent: int) -> float:
    t, chance = percent / 100, 2.0**-BITS
    share = t + (1 - t) * chance
    return t - SLACK * (share * (1 - share) / PERMUTATIONS) ** 0.5 / (1 - chance)


def _sets_of(ids: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Staged (v, shingles), the full sets of the representatives ``ids`` (v)."""
    wanted = reps.join(ids, "v", "left_semi").select("v", "doc_id", "h1", "h2")
    found = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, h1 long, h2 long, shingles array<long>")
    # Rows that repeat a doc_id and its text have one representative.
    found = found.groupBy("doc_id", "h1", "h2").agg(F.first("shingles").alias("shingles"))
    return staged(found.join(wanted, ["doc_id", "h1", "h2"]).select("v", "shingles"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()


def _dealt(side: DataFrame, stars: DataFrame) -> DataFrame:
    """``side`` (a, ...) once for each of the salts that the rows of ``stars`` (a, salts) around a hub have."""
    copies = stars.groupBy("a").agg(F.max("salts").alias("most"))
    return side.join(copies, "a").select("*", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("salt")).drop("most")


def _enough(both: Column, left: Column, right: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, from the sizes of the intersection and of both sets."""
    return (100 + percent) * both >= percent * (left + right)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the estimate of their similarity; where they are dealt around hubs, by their salt."""
    side = lambda c: reps.select(F.col("v").alias(c), *(F.col(s).alias(f"{c}{s}") for s in _SIGNED))
    dealt = "salt" in pairs.columns
    out = pairs.join(side("b"), "b").join(_dealt(side("a"), pairs) if dealt else side("a"), ["a", "salt"] if dealt else "a")
    return out.select(*pairs.columns, estimate("a", "b").alias("likely"))


def _candidates(stars: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) around a common hub that may be similar although one of them isn't similar to the hub.

    Prefix filter: with the shingles of a hub's group in one order, two similar sets share one of their first
    n - ceil(percent * n / 100) + 1. The order is by rarity: first the shingles that no pair of interest can share, as one
    row only has them or only rows that are linked with the hub, then by their number of rows. So a line that many rows
    share comes last, and what comes first rules most rows out. At the first shingle that two sets share, what either
    still has from there on bounds their overlap (positional filter). Shingles whose rows all lie in one component
    lead to no new link and go before any pair is made.
    """
    part = labels.select(F.col("v").alias("b"), F.col("p").alias("part"))
    mixed = stars.filter("not linked").select("a").distinct()
    around = stars.join(mixed, "a", "left_semi").join(part, "b", "left").select("a", "b", F.coalesce("part", "b").alias("part"), "linked")
    around = around.join(sets.select(F.col("v").alias("b"), "shingles"), "b")
    each = staged(around.select("a", "b", "part", "linked", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle")), "around")
    common = each.groupBy("a", "shingle").agg(F.count("*").alias("rows"), F.bool_or(~F.col("linked")).alias("open"), F.min("part").alias("low"), F.max("part").alias("high")).filter("rows > 1 and open")
    each = each.join(common.select("a", "shingle", "rows", (F.col("low") != F.col("high")).alias("leads")), ["a", "shingle"])
    own = Window.partitionBy("a", "b")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("rows", "shingle")) - 1
    first = each.select("a", "b", "part", "linked", "n", "shingle", "leads", place.alias("place"))
    first = staged(first.filter(F.col("leads") & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100))).drop("leads"), "prefixes")
    others = first.select("a", "shingle", *(F.col(c).alias(f"y_{c}") for c in ("b", "part", "linked", "n", "place")))
    rest = F.least(F.col("n") - F.col("place"), F.col("y_n") - F.col("y_place"))
    once = F.col("y_linked") | (F.col("b") < F.col("y_b"))
    found = first.filter("not linked").join(others, ["a", "shingle"]).filter((F.col("part") != F.col("y_part")) & once & _enough(rest, F.col("n"), F.col("y_n"), percent))
    return found.select(F.least("b", "y_b").alias("a"), F.greatest("b", "y_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (links confirmed for the representative of the row's set),
    text_hash, root (the same number for all rows of a component of several rows, else null)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_signatures(width), _SIGNATURE_DDL)
    rows = staged(signed.withColumn("v", F.monotonically_increasing_id()), "signatures")
    sets_in = rows.filter("n > 0 and doc_id is not null")
    same = staged(sets_in.groupBy("h1", "h2").agg(F.min("v").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "same")
    members = rows.select("v", "doc_id", "text_hash", "n", "h1", "h2").join(same, ["h1", "h2"], "left")
    set_in = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    members = staged(members.select("v", "doc_id", "text_hash", "n", (F.col("rep").isNotNull() & set_in).alias("copied"), F.when(set_in, F.coalesce("rep", "v")).alias("rep"), F.when(set_in, F.col("first")).alias("first")), "members")
    heads = staged(members.filter("v = rep").select("v", F.coalesce("first", "doc_id").alias("first")), "heads")
    reps = staged(rows.join(heads, "v").select("v", "doc_id", "first", "n", "h1", "h2", "bands", *_SIGNED), "reps")

    # The row that shares most band keys with others is the hub of its buckets.
    cells = reps.select("v", F.explode("bands").alias("key"))
    shared = staged(cells.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    cells = staged(cells.join(shared, "key"), "cells")
    weight = cells.groupBy("v").agg(F.sum("size").alias("weight"))
    hubs = staged(cells.join(weight, "v").groupBy("key").agg(F.max(F.struct("weight", (-F.col("v")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("a")), "hubs")
    stars = cells.join(hubs, "key").filter("a != v").groupBy("a", F.col("v").alias("b")).agg(F.max("size").alias("size"))
    stars = stars.withColumn("salts", F.ceil(F.col("size") / SPLIT).cast("int"))
    stars = staged(stars.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")), "buckets")
    cut = _cut(percent)
    # In a bucket of two, a pair that is far below the threshold is done; a larger bucket needs all overlaps with its hub.
    stars = staged(_likely(stars, reps).filter((F.col("likely") >= cut) | (F.col("size") > 2)).select("a", "b", "salts", "salt"), "stars")
    sets = _sets_of(_ends(stars), reps, texts, width)
    side = lambda c: sets.select(F.col("v").alias(c), F.col("shingles").alias(f"set_{c}"))
    sized = (F.size(F.array_intersect("set_a", "set_b")).cast("long"), F.size("set_a").cast("long"), F.size("set_b").cast("long"))
    stars = stars.join(side("b"), "b").join(_dealt(side("a"), stars), ["a", "salt"]).select("a", "b", _enough(*sized, percent).alias("linked"))
    stars = staged(stars, "overlaps")
    links = stars.filter("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = components(links)

    pairs = staged(_likely(staged(_candidates(stars, sets, labels, percent), "candidates"), reps).filter(F.col("likely") >= cut).select("a", "b"), "pairs")
    if not pairs.isEmpty():
        sets = _sets_of(_ends(pairs), reps, texts, width)
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        links = staged(links.unionByName(both.filter(_enough(*sized, percent)).select("a", "b")).distinct(), "links")
        labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = labels.select(F.col("v").alias("rep"), F.col("p").alias("root")).unionByName(labels.select(F.col("p").alias("rep"), F.col("p").alias("root")).distinct())
    roots = staged(roots.join(heads.select(F.col("v").alias("rep"), "first"), "rep"), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    found = staged(roots.select("rep", "root").join(least, "root").join(degree, "rep", "left"), "found")
    out = members.join(found, "rep", "left")
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "first", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash", F.coalesce("root", F.when(F.col("copied"), F.col("rep"))).alias("root"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_links", "text_hash", "root")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, and all their columns."""
    grouped = staged(near_duplicates(docs, width, percent).filter("root is not null").select("doc_id", "component_id", "text_hash", "root"), "grouped")
    best = grouped.filter("doc_id = component_id").groupBy("root").agg(F.min("text_hash").alias("stays"))
    grouped = grouped.join(best, "root").select("doc_id", "text_hash", ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("stays"))).alias("stays"))
    fates = staged(grouped.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1"), "fates")
    id_, hash_ = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    marks = fates.select(F.col("doc_id").alias("_dup_id"), F.col("text_hash").alias("_dup_hash"))
    held = docs.withColumns({"_dup_key": id_, "_dup_text": hash_})
    at = (F.col("_dup_key") == F.col("_dup_id")) & (F.col("_dup_text") == F.col("_dup_hash"))
    out = held.join(marks, at, "left_anti").select(docs.columns)
    repeated = marks.join(fates.filter("stays").select(F.col("doc_id").alias("_dup_id"), F.col("text_hash").alias("_dup_hash")), ["_dup_id", "_dup_hash"], "left_semi")
    if repeated.isEmpty():
        return out
    # Of rows that repeat doc_id and text, one: combined before they are shuffled.
    again = held.join(repeated, at, "left_semi").groupBy("_dup_key", "_dup_text").agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns))
    return out.unionByName(again.select(docs.columns))
