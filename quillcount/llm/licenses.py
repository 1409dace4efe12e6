"""License scan by ordered signature rules. DataFrame functions only, one narrow pass without a shuffle.

The rules (license_rules.py) are hand-written patterns over lower-case words joined by single spaces. A text that
holds none of ``GATES`` is done after one look for them. In the others, each rule one of whose own keywords stands in the
text is run over the whole text, and each place it matches is a detection: the interval of words from its first to its
last. Intervals are resolved in order of start: one that lies inside an interval of a rule of the same or a higher
priority is suppressed. Priorities: 4 a tag (SPDX-License-Identifier), 3 a phrase of a license's own text, 2 a
grant ("licensed under ..."), 1 a name. Of one rule's matches that overlap, the leftmost counts.

Base: places where the words of a base phrase stand consecutively; their labels are always reported. Words are
maximal runs of [0-9A-Za-z] and characters beyond U+007F, A-Z lower-cased.

Results: a null text is an empty text: no words, no label, empty strings, score 0, null first_word and
last_word. Every row gives one row; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import blocks, let
from .license_rules import GATES, rules

# Base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Marks of a match's first and last word; no word holds them.
_FROM, _TO = "\x01", "\x02"
_PRIORITIES = 4


def _rule_array() -> Column:
    """All rules as one literal."""
    rows = [{"label": a, "pattern": p, "keys": k, "priority": n, "score": s} for a, p, k, n, s in rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,pattern:string,keys:array<string>,priority:int,score:double>>")


_HIT = "struct<start:int,back:int,down:int,label:string,score:double>"


def _hits(said: Column, present: Column, rule_array: Column) -> Column:
    """All detections, one array for each rule that fires: (first word, -end, -priority, label, score).

    A rule's matches are marked where they start and end, and the marks read off the words; one pass over the text.
    """
    fired = F.filter(rule_array, lambda r: F.arrays_overlap(r["keys"], present) & F.rlike(said, r["pattern"]))

    def found(r: Column) -> Column:
        marked = F.split(F.regexp_replace(said, r["pattern"], F.lit(f"{_FROM}$0{_TO}")), " ")
        places = F.filter(F.transform(marked, lambda w, i: F.struct(i.alias("at"), F.startswith(w, F.lit(_FROM)).alias("first"), F.endswith(w, F.lit(_TO)).alias("last"))), lambda x: x["first"] | x["last"])
        starts, ends = F.filter(places, lambda x: x["first"]), F.filter(places, lambda x: x["last"])
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["at"].alias("start"), (-(b["at"] + 1)).alias("back"), (-r["priority"]).alias("down"), r["label"].alias("label"), r["score"].alias("score")))

    return F.transform(fired, found)


def _resolved(hits: Column) -> Column:
    """Detections that lie inside none of the same or a higher priority; hits are sorted by start, -end, -priority.

    A detection's containers stand before it. Hits are taken in blocks: what the blocks before reach is one maximum
    for each block and priority, so the work grows with the number of hits times a block's size.
    """
    reach = lambda some, level: F.coalesce(F.array_max(F.transform(some, lambda h: F.when(h["down"] <= level, -h["back"]))), F.lit(-1))
    zero = F.array_repeat(F.lit(-1), _PRIORITIES)

    def topped(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), F.transform(parts, lambda block: F.array(*(reach(block, -n) for n in range(1, _PRIORITIES + 1)))).alias("tops"))

    def shown(block: Column, before: Column) -> Column:
        def seen(h: Column, i: Column) -> Column:
            earlier = F.exists(F.slice(block, F.lit(1), i), lambda o: (o["down"] <= h["down"]) & (o["back"] <= h["back"]))
            return ~(earlier | (F.get(before, -h["down"] - 1) >= -h["back"]))

        return F.filter(block, seen)

    def all_shown(x: Column) -> Column:
        before = lambda b: F.aggregate(F.slice(x["tops"], F.lit(1), b), zero, lambda acc, top: F.zip_with(acc, top, lambda p, q: F.greatest(p, q)))
        return F.flatten(F.transform(x["parts"], lambda block, b: let(before(b), lambda reached: shown(block, reached))))

    return let(let(let(hits, blocks), topped), all_shown)


def _places(words: Column, phrase: list[str], label: str) -> Column:
    """(start, label) of every place where the words of a phrase stand consecutively."""

    def here(i: Column) -> Column:
        return reduce(Column.__and__, [F.get(words, i + j) == p for j, p in enumerate(phrase)])

    def place(i: Column) -> Column:
        return F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), place)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # One pass finds the words of every text: their number and whether a gate is among them.
    out = out.select("*", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("some"))
    out = out.select("doc_id", "text", F.size("some").cast("long").alias("n_words"), F.arrays_overlap("some", F.array(*map(F.lit, GATES))).alias("gate"))
    words = F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))
    out = out.select("doc_id", "n_words", F.when(F.col("gate"), words).alias("words"))

    keywords = F.array(*map(F.lit, sorted({k for _, _, keys, *_ in rules() for k in keys})))
    w, none = F.col("words"), F.array().cast(f"array<{_HIT}>")
    starts = [_places(w, phrase.split(), label) for phrase, label in BASE_PHRASES]
    base = F.when(w.isNotNull(), F.concat(*starts)).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))
    out = out.select("doc_id", "n_words", base.alias("base"), F.when(w.isNotNull(), F.array_join(w, " ")).alias("said"), F.when(w.isNotNull(), F.array_intersect(w, keywords)).alias("present"))
    hits = F.when(F.col("said").isNotNull(), F.array_sort(F.array_distinct(F.flatten(_hits(F.col("said"), F.col("present"), _rule_array()))))).otherwise(none)
    out = out.select("doc_id", "n_words", "base", hits.alias("hits"))
    out = out.select("doc_id", "n_words", "base", F.when(F.size("hits") > 0, _resolved(F.col("hits"))).otherwise(none).alias("kept"))
    base_labels = F.transform("base", lambda b: b["label"])
    best = F.array_max(F.concat(F.transform("kept", lambda h: h["score"]), F.when(F.size("base") > 0, F.array(F.lit(0.8))).otherwise(F.array().cast("array<double>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("kept", lambda h: h["label"])))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
