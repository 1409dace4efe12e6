"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. DataFrame only.

All matches of a pattern and what lies between them come from regexp_extract_all and split with the same
pattern; running sums of their lengths are the positions. Repeats that could run back over a long match are
possessive or start only where a run starts, so a long run of digits or letters takes linear time and no stack.

Base kinds: email, ip (four parts up to 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits). The method
adds: iban (mod 97), ssn and aba (bank routing number, weighted mod 10). A span of the method's starts with
the score its pattern earns, a checksum raises it, context words within ``NEAR`` characters before it raise it
again, and it is reported from ``REPORTED`` on; base spans are always reported, their score goes into max_score.

Results: a null text is an empty text: no span, the digest of an empty string, an empty spans string, max_score
0. Positions are code points, ends exclusive. Spans of different kinds may overlap; equal starts are in the
order of KINDS. Other columns are ignored. Every row gives one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import blocks, let

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "aba")
BASE = 4
NEAR = 48
REPORTED = 0.6

# The patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "aba": r"(?<![0-9-])[0-9]{9}(?![0-9-])",
}
#: What the pattern alone earns, and what its checksum adds.
SCORES = {"email": (0.8, 0.0), "ip": (0.6, 0.0), "card": (0.3, 0.5), "phone": (0.5, 0.0), "iban": (0.3, 0.6), "ssn": (0.4, 0.0), "aba": (0.1, 0.3)}
CONTEXT_BONUS = 0.3
CONTEXT = {
    "email": r"mail|contact|write to|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|credit|debit|visa|master|amex|payment",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"ssn|social|security|tax",
    "aba": r"routing|aba|bank|transit",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the letters and digits of an IBAN, its first four moved to the end, are 1 modulo 97."""
    s = F.regexp_replace(iban, "[^A-Z0-9]", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def routing(digits: Column) -> Column:
    """Whether nine digits pass the weighted (3, 7, 1) sum modulo 10."""
    weighted = [w * F.substring(digits, i + 1, 1).cast("int") for i, w in enumerate((3, 7, 1) * 3)]
    return reduce(Column.__add__, weighted) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9..)|-00-|-0000$")
    return routing(m)


_SPAN = "struct<start:int,kind:int,stop:int,score:double>"


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, stop, match) of all matches, from the lengths of the matches and of the gaps before them.

    Lengths are summed in blocks, and blocks by their sums, so many matches cost no growing copies.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        stop = start + F.length(p["match"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), p["match"].alias("match")))).alias("out"))

    def placed(x: Column) -> Column:
        begin = lambda b: F.aggregate(F.slice(x["sums"], F.lit(1), b), F.lit(0), lambda acc, n: acc + n)
        return F.flatten(F.transform(x["blocks"], lambda block, b: F.aggregate(block, F.struct(begin(b).alias("at"), none.alias("out")), add, lambda acc: acc["out"])))

    def summed(parts: Column) -> Column:
        return F.struct(parts.alias("blocks"), F.transform(parts, lambda block: F.aggregate(block, F.lit(0), lambda acc, p: acc + p["gap"] + F.length(p["match"]))).alias("sums"))

    found = F.filter(pairs, lambda p: p["match"].isNotNull())
    return let(let(let(found, blocks), summed), placed)


def _spans(text: Column, kind: str) -> Column:
    alone, checked = SCORES[kind]
    k = KINDS.index(kind)

    def scored(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR))))
        score = F.lit(alone + checked) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["stop"].alias("stop"), F.least(score, F.lit(1.0)).alias("score"))

    out = F.transform(F.filter(_located(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"])), scored)
    return out if k < BASE else F.filter(out, lambda x: x["score"] >= REPORTED)


def _gate(text: Column, kind: str) -> Column:
    """A cheap test that a text without a match mostly fails, and one with a match never."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "-[0-9]{2}-", "aba": "[0-9]{9}"}[kind])


def _text_of(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast(f"array<{_SPAN}>")
    found = [F.when(_gate(F.col("text"), k), _spans(F.col("text"), k)).otherwise(empty).alias(k) for k in KINDS]
    out = out.select("doc_id", *found)
    out = out.select("*", F.concat(*KINDS[:BASE]).alias("base"), F.concat(*KINDS).alias("every"))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]),
        F.sha2(_text_of("base"), 256).alias("base_sha256"),
        _text_of("every").alias("spans"),
        F.coalesce(F.array_max(F.transform("every", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
