"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A text's terms are its words, in lower case (Unicode), weighted 1 + ln(count). For each of ``SAMPLES`` independent samples
and each term, hashes of (term, sample) give r and c from Gamma(2, 1) and b from the unit interval; with
t = floor(ln(weight) / r + b), a = c * exp(-r * (t - b + 1)), the sample is the (term, t) of the smallest a.
Two texts agree in a sample with a probability of the sum of smaller weights over the sum of larger weights,
the generalised Jaccard similarity s; the share of equal samples has a standard error of sqrt(s * (1 - s) / SAMPLES),
0.06 at 0.5 and 0.05 at 0.8, and steps of 1 / SAMPLES. Each sample is kept as 24 bits of hash(term, t), the fingerprint as their
hex digits. The order of a and the hash are packed in one long, so a sample is min() over longs: no row leaves
its partition between its text and its fingerprint. A text and its edited text share most terms: a term that both
have is one row, and one with equal counts in both is sampled once.

The next document is found without a global window: the keys are range-partitioned, each takes its neighbour
in its partition, and the edges of the partitions, one row each, meet in a small table. Of the next document
only the prefix that the edit needs is shuffled to its user.

Results: a null text is an empty text. A text without terms has the empty fingerprint; two of them are alike
(1), one and any other are not (0). doc_ids that stand in several rows are ordered by a hash of their text;
rows that repeat both count as one document, and each of them gets the result. Rows with a null doc_id have no place
in the order: they get n_chars and their fingerprint, and null in the columns of the edited text and of likeness. A
single document is its own next. An empty table gives an empty result. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let
from .staging import staged

SAMPLES = 64
#: Samples that one row of (text, term) computes; more would make one generated method too large to compile well.
TOGETHER = 4
#: a, which is under 64, is kept to 2**-32, above the bits of the hash.
_SCALE, _HASH_BITS = float(1 << 32), 24
_DIGITS = _HASH_BITS // 4
_HASH = (1 << _HASH_BITS) - 1
_BORDER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UNIT = float(1 << 21)


def _uniform(h: Column, part: int) -> Column:
    """One of three 21-bit uniforms of a hash, never 0."""
    return (F.shiftrightunsigned(h, 21 * part).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / _UNIT


def _pack(g: Column, r: Column, c: Column, b: Column, weight_log: Column) -> Column:
    """a and the hash of (term, t) of a sample, packed in a long whose order is that of a; null without a weight."""
    t = F.floor(weight_log / r + b)
    order = F.floor(c * F.exp(r * (b - t - 1)) * _SCALE)
    # t is under 2**31, as r is over 2**-22: the product is no overflow.
    return F.shiftleft(order, _HASH_BITS).bitwiseOR(g.bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit(_HASH)))


def _runs(values: Column) -> Column:
    """(value, number) of each run of equal values of a sorted array."""

    def counted(x: Column) -> Column:
        return F.transform(x["starts"], lambda s, j: F.struct(F.get(x["values"], s).alias("x"), (F.coalesce(F.get(x["starts"], j + 1), F.size(x["values"])) - s).alias("n")))

    def started(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        return F.struct(v.alias("values"), starts.alias("starts"))

    return let(let(values, started), counted)


def _terms(text: Column, kind: int) -> Column:
    """Hashes of a text's words, their last bit the kind; the empty word stands before and after borders."""
    return F.transform(F.split(F.lower(text), _BORDER, -1), lambda w: F.shiftleft(F.shiftright(F.xxhash64(w), 1), 1) + kind)


def _paired(runs: Column) -> Column:
    """(term, n0, n1) from the runs of both kinds, in which a term's two kinds stand side by side."""

    def pair(r: Column, i: Column) -> Column:
        odd = r["x"].bitwiseAND(F.lit(1)) == 1
        after, before = F.get(runs, i + 1), F.get(runs, i - 1)
        other = F.when(after["x"] == r["x"] + 1, after["n"]).otherwise(0)
        return F.struct(F.when(~(odd & F.coalesce(before["x"] == r["x"] - 1, F.lit(False))), F.shiftright(r["x"], 1)).alias("term"), F.when(odd, 0).otherwise(r["n"]).alias("n0"), F.when(odd, r["n"]).otherwise(other).alias("n1"))

    return F.filter(F.transform(runs, pair), lambda p: p["term"].isNotNull())


def _printed(texts: DataFrame, keys: list[str], first: str, second: str | None) -> DataFrame:
    """keys and the fingerprints p0 of ``first`` and p1 of ``second``: one row for each distinct ``keys``.

    Where ``texts`` is hash-partitioned by some of the keys already, nothing is shuffled.
    """
    words = _terms(F.col(first), 0)
    if second is not None:
        words = F.concat(words, _terms(F.col(second), 1))
    rows = texts.select(*keys, F.explode(let(_runs(F.sort_array(words)), _paired)).alias("x"))
    blank = F.col("x.term") == F.shiftright(F.xxhash64(F.lit("")), 1)
    log_weight = lambda n: F.when(~blank & (F.col(n) > 0), F.log(1.0 + F.log(F.col(n).cast("double"))))
    rows = rows.select(*keys, F.col("x.term").alias("term"), log_weight("x.n0").alias("w0"), log_weight("x.n1").alias("w1"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(0, SAMPLES, TOGETHER)))).alias("k"))
    each = range(TOGETHER)
    # Step by step, so that every value is computed once for a row.
    rows = rows.select(*keys, "k", "w0", "w1", *(F.xxhash64("term", F.col("k") + j).alias(f"g{j}") for j in each))
    rows = rows.select("*", *(F.xxhash64(f"g{j}").alias(f"h{j}") for j in each))
    draws = [(-F.log(_uniform(F.col(f"g{j}"), 0) * _uniform(F.col(f"g{j}"), 1)), -F.log(_uniform(F.col(f"h{j}"), 0) * _uniform(F.col(f"h{j}"), 1)), _uniform(F.col(f"g{j}"), 2)) for j in each]
    rows = rows.select(*keys, "k", "w0", "w1", *(f"g{j}" for j in each), *(x.alias(f"{n}{j}") for j, draw in zip(each, draws, strict=True) for n, x in zip("rcb", draw, strict=True)))
    packed = lambda j, w: _pack(*(F.col(f"{n}{j}") for n in "grcb"), F.col(w))
    rows = rows.select("*", *(packed(j, "w0").alias(f"s0_{j}") for j in each))
    mins = [F.min(f"s0_{j}").alias(f"m0_{j}") for j in each]
    if second is not None:
        mins += [F.min(F.when(F.col("w1") == F.col("w0"), F.col(f"s0_{j}")).otherwise(packed(j, "w1"))).alias(f"m1_{j}") for j in each]
    kinds = (0,) if second is None else (0, 1)
    digits = lambda kind: F.concat(*(F.lpad(F.lower(F.hex(F.col(f"m{kind}_{j}").bitwiseAND(F.lit(_HASH)))), _DIGITS, "0") for j in each))
    parts = rows.groupBy(*keys, "k").agg(*mins).select(*keys, "k", *(F.when(F.col(f"m{kind}_0").isNull(), "").otherwise(digits(kind)).alias(f"d{kind}") for kind in kinds))
    whole = parts.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.struct("k", f"d{kind}"))).alias(f"p{kind}") for kind in kinds))
    return whole.select(*keys, *(F.array_join(F.col(f"p{kind}.d{kind}"), "").alias(f"p{kind}") for kind in kinds))


def fingerprinted(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fingerprint: one row for each distinct ``keys``, which have to tell the texts apart."""
    return _printed(texts, keys, text, None).withColumnRenamed("p0", "fingerprint")


def likeness(a: str, b: str) -> Column:
    """The share of equal samples of two fingerprints; of two empty ones 1, of an empty and another one 0."""
    same = F.lit(0)
    for k in range(SAMPLES):
        same = same + F.when(F.substring(a, _DIGITS * k + 1, _DIGITS) == F.substring(b, _DIGITS * k + 1, _DIGITS), 1).otherwise(0)
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def _followed(keys: DataFrame) -> DataFrame:
    """Distinct (doc_id, h, n) with the next in descending order as to_id and to_h, the last with the first."""
    dealt = staged(keys.repartitionByRange("doc_id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part").orderBy(F.desc("doc_id"), F.desc("h"))
    inside = dealt.withColumn("to", F.lead(F.struct("doc_id", "h")).over(own))
    # One row for each range partition, however many documents there are.
    tops = dealt.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    # Nulls sort first, so they are the smallest keys everywhere here.
    edge = Window.orderBy("part")
    tops = tops.select("part", F.lag("top").over(edge).alias("below"), F.max("top").over(edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    out = inside.join(F.broadcast(tops), "part").select("doc_id", "h", "n", F.coalesce("to", "below", "first").alias("to"))
    return out.select("doc_id", "h", "n", F.col("to.doc_id").alias("to_id"), F.col("to.h").alias("to_h"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    unplaced, texts = texts.filter("doc_id is null"), texts.filter("doc_id is not null")
    keys = texts.select("doc_id", "h", F.length("text").alias("n")).groupBy("doc_id", "h", "n").agg(F.count("*").alias("copies"))
    order = staged(_followed(keys.select("doc_id", "h", "n")), "order")
    copied = not keys.filter("copies > 1").isEmpty()

    wanted = order.select(F.col("to_id").alias("doc_id"), F.col("to_h").alias("h"), F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    given = texts.join(wanted, ["doc_id", "h"]).select(F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"), "k", F.substring("text", F.lit(1), F.col("k")).alias("prefix"))
    if copied:
        given = given.groupBy("doc_id", "h", "k").agg(F.max("prefix").alias("prefix"))
    both = texts.join(given, ["doc_id", "h"])
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.col("k")), F.col("prefix"))
    both = both.select("doc_id", "h", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    sums = both.select("doc_id", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # Short keys: they are looked up once for each term.
    printed = _printed(both, ["doc_id", "h"], "text", "edited").withColumnsRenamed({"p0": "fingerprint", "p1": "edited_fingerprint"})
    if copied:
        sums = sums.distinct()
    printed = staged(printed.join(sums, ["doc_id", "h"]), "fingerprints")

    after = printed.select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.col("fingerprint").alias("next_fingerprint"))
    out = printed.join(order.select("doc_id", "h", "to_id", "to_h"), ["doc_id", "h"]).join(after, ["to_id", "to_h"])
    out = out.select("doc_id", "h", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
    if copied:
        out = texts.select("doc_id", "h").join(out, ["doc_id", "h"])
    out = out.drop("h")
    if unplaced.isEmpty():
        return out
    alone = fingerprinted(unplaced.select("h", "text").groupBy("h").agg(F.first("text").alias("text")), ["h"], "text")
    alone = unplaced.select("doc_id", "h", F.length("text").cast("long").alias("n_chars")).join(alone, "h")
    nothing = {"edited_sha256": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    return out.unionByName(alone.select("doc_id", "n_chars", "fingerprint", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())))
