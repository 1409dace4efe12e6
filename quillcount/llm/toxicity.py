"""Counterfactually regularised toxicity classifier.

Features are the hashed words of a text and the hashed beginnings of its words. A bounded sample of the labelled
training rows (``SAMPLE_ROWS``, chosen by a hash of doc_id) fits the model: the ``FEATURES`` features that separate its
labels best are the vocabulary, a logistic model over them is fitted by gradient descent. Every sampled text also gives
counterfactual texts, word sequences in which an identity term is swapped for each other term of its group; a text
that holds no term gets one in the place of one of its words, the group's neutral word first, and swaps start from
there, so the penalty acts whatever the labelled texts happen to mention. The loss has a penalty on the squared change
of the score that a swap causes: a mere mention of a group scores like the neutral word. Identity terms are
always in the vocabulary, that the penalty can act on them.

Sampled labels go to the texts (a broadcast of at most ``SAMPLE_ROWS`` short rows), not texts to labels: no text is
shuffled. The sampled rows are staged once.

Results: a null or empty text gets the score of a text without any feature, the model's base rate. A training
table with one label only, or none, gives a constant score. Labels that are null are not learned from; several
label rows of one document count as several rows. A row with a null doc_id is scored, but never learned from or
held out. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .staging import staged

FEATURES = 4096
SAMPLE_ROWS = 20_000
#: Weight of the counterfactual penalty, and of the ridge penalty.
SWAP_PENALTY, RIDGE = 5.0, 2e-4
STEPS, RATE = 300, 0.05
#: Bytes of a word's beginning that make features of their own.
PREFIXES = (2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3

# Identity terms, by group, in the languages of the corpus; the first word of a group is its neutral one.
IDENTITY_TERMS = tuple(
    tuple(group.split())
    for group in (
        "people women men girls boys immigrants refugees foreigners natives muslims christians jews hindus buddhists atheists africans asians europeans arabs turks mexicans lesbians",
        "person woman man girl boy immigrant refugee foreigner native",
        "local black white asian latino arab african european turkish mexican muslim christian jewish hindu buddhist atheist gay straight lesbian bisexual transgender old young deaf blind disabled",
        "menschen frauen männer mädchen jungen migranten flüchtlinge ausländer muslime christen juden hindus buddhisten atheisten afrikaner asiaten araber türken schwule lesben behinderte",
        "mensch frau mann migrant flüchtling muslim christ jude türke araber",
        "hiesige schwarze weiße asiatische arabische afrikanische türkische muslimische christliche jüdische schwule lesbische alte junge gehörlose blinde behinderte",
        "gens femmes hommes filles garçons immigrés réfugiés étrangers musulmans chrétiens juifs hindous bouddhistes athées africains asiatiques arabes turcs homosexuels handicapés",
        "personne femme homme fille garçon immigré réfugié musulman chrétien juif",
        "personas mujeres hombres niñas niños inmigrantes refugiados extranjeros musulmanes cristianos judíos hindúes budistas ateos africanos asiáticos árabes turcos homosexuales gitanos",
        "persona mujer hombre niña niño inmigrante refugiado musulmán cristiano judío",
    )
)

WORD = scan.byte_class(b"'", (48, 57), (65, 90), (97, 122), (128, 255))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct feature hashes of its text."""
    for _, _, data, off in scan.slices(column):
        starts, ends = scan.spans_of(data, off, WORD)
        prefix = scan.prefix_hash(data, scan.FOLDED_CODES)
        size = ends - starts
        hashes, rows = [scan.range_hash(prefix, starts, ends)], [np.searchsorted(off, starts, "right") - 1]
        for n in PREFIXES:
            long = np.flatnonzero(size > n)
            hashes.append(scan.range_hash(prefix, starts[long], starts[long] + n) ^ np.uint64(n))
            rows.append(rows[0][long])
        h, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        bounds = np.searchsorted(r[order], np.arange(len(off)))
        h = h[order]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


_GROUPS = tuple(tuple(w.encode() for w in group) for group in IDENTITY_TERMS)
#: The words that each term is swapped for.
_OTHERS = {w: tuple(dict.fromkeys(x for g in _GROUPS if w in g for x in g if x != w)) for group in _GROUPS for w in group}


def _keys(word: bytes) -> set[bytes]:
    """A word's features by name: itself between bars, and its beginnings."""
    return {b"|" + word + b"|"} | {word[:n] for n in PREFIXES if len(word) > n}


_KEYS = {w: _keys(w) for w in _OTHERS}


def _hash_of(key: bytes) -> int:
    whole = key[:1] == b"|"
    raw = np.frombuffer(key.strip(b"|"), np.uint8)
    h = scan.range_hash(scan.prefix_hash(raw, scan.FOLDED_CODES), np.array([0]), np.array([len(raw)]))[0]
    return int(h if whole else h ^ np.uint64(len(raw)))


#: The hash of each feature of an identity term.
KEY_HASHES = {key: _hash_of(key) for keys in _KEYS.values() for key in keys}
TERM_FEATURES = np.unique(np.array([*KEY_HASHES.values()], np.uint64))
_TOKEN = re.compile(rb"['0-9A-Za-z\x80-\xff]+")


def swaps(text: str) -> Iterator[tuple[set[bytes], set[bytes]]]:
    """Of each counterfactual of a text: the features only the text has, and those only the swapped text has.

    Every term of the text is swapped, in all its places, for each other term of its groups. In a text without a
    term, a word chosen by the text's checksum first gives way to a group's neutral word.
    """
    raw = text.encode()
    words = [w.lower() for w in _TOKEN.findall(raw)]
    there = [w for w in dict.fromkeys(words) if w in _OTHERS]
    if words and not there:
        pick = zlib.crc32(raw)
        group = _GROUPS[pick % len(_GROUPS)]
        words[pick // len(_GROUPS) % len(words)] = group[0]
        there = [group[0]]
    distinct = {*words}
    for term in there:
        kept = {key for w in distinct if w != term for key in _keys(w)}
        for other in _OTHERS[term]:
            yield _KEYS[term] - kept - _KEYS[other], _KEYS[other] - kept - _KEYS[term]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (feature, label 1, label 0), combined over a batch before they are shuffled."""
    for batch in batches:
        label = np.array(batch.column(1).to_pylist(), np.int64)
        found = list(features(batch.column(0)))
        if not found:
            continue
        keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
        toxic = np.repeat(label, [len(f) for f in found])
        ones = np.bincount(inverse, toxic, len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([scan.int64(keys), pa.array(ones), pa.array(np.bincount(inverse, minlength=len(keys)) - ones)], names=["feature", "ones", "zeros"])


@dataclass
class Model:
    """vocabulary: sorted feature hashes; weights: one for each; bias."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, found: np.ndarray) -> float:
        if not len(self.vocabulary):
            return self.bias
        at = np.searchsorted(self.vocabulary, found)
        at[at == len(self.vocabulary)] = 0
        return self.bias + float(self.weights[at[self.vocabulary[at] == found]].sum())


def training_share(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of doc_id as text, modulo 4, isn't 2."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


@dataclass
class Problem:
    """Sampled rows and distinct swaps as sparse matrices: entry i stands in row ``rows[i]`` and column ``cols[i]``.

    ``weights`` are the shares of the swaps, whose entries have ``signs``. The last of the parameters is the bias.
    """

    rows: np.ndarray
    cols: np.ndarray
    labels: np.ndarray
    swap_rows: np.ndarray
    swap_cols: np.ndarray
    signs: np.ndarray
    weights: np.ndarray
    penalty: float = SWAP_PENALTY

    def loss(self, w: np.ndarray) -> float:
        z = w[-1] + np.bincount(self.rows, w[self.cols], len(self.labels))
        change = np.bincount(self.swap_rows, self.signs * w[self.swap_cols], len(self.weights))
        return float((np.logaddexp(0, z) - self.labels * z).mean() + RIDGE / 2 * (w[:-1] ** 2).sum() + self.penalty / 2 * (self.weights * change**2).sum())

    def gradient(self, w: np.ndarray) -> np.ndarray:
        n, v = len(self.labels), len(w) - 1
        p = 1 / (1 + np.exp(-np.clip(w[v] + np.bincount(self.rows, w[self.cols], n), -30, 30)))
        error = (p - self.labels) / n
        g = np.append(np.bincount(self.cols, error[self.rows], v) + RIDGE * w[:v], error.sum())
        if len(self.weights):
            change = self.weights * np.bincount(self.swap_rows, self.signs * w[self.swap_cols], len(self.weights))
            g[:v] += self.penalty * np.bincount(self.swap_cols, self.signs * change[self.swap_rows], v)
        return g


def _descend(problem: Problem, vocabulary: np.ndarray) -> Model:
    """Full-batch gradient descent with Adam's steps."""
    v = len(vocabulary)
    base = (problem.labels.sum() + 0.5) / (len(problem.labels) + 1)
    w = np.append(np.zeros(v), np.log(base / (1 - base)))
    speed, square = np.zeros(v + 1), np.zeros(v + 1)
    for step in range(1, STEPS + 1):
        g = problem.gradient(w)
        speed, square = 0.9 * speed + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(vocabulary, w[:v], float(w[v]))


def _constant(ones: int, zeros: int) -> Model:
    share = min(max((ones + 0.5) / (ones + zeros + 1), 1e-3), 1 - 1e-3)
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged (text, label): ``SAMPLE_ROWS`` labelled rows of the training share at most, those of the smallest hashes.

    doc_ids that stand in many rows are thinned by a hash of the text, to as many rows in expectation.
    """
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("long").alias("label"))
    few = training_share(known).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = staged(texts.join(F.broadcast(few), "doc_id").select("text", "label"), "labelled")
    n = rows.count()
    if n <= 2 * SAMPLE_ROWS:
        return rows
    return rows.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(SAMPLE_ROWS / n * (1 << 30)))


def problem_of(rows: DataFrame, vocabulary: np.ndarray, penalty: float = SWAP_PENALTY) -> Problem:
    """The optimisation problem of sampled rows (text, label) over a sorted vocabulary that holds all term features."""
    at = {key: int(np.searchsorted(vocabulary, np.uint64(h))) + 1 for key, h in KEY_HASHES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(vocabulary, np.intersect1d(f, vocabulary, assume_unique=True)) for f in features(batch.column(0))]
            pairs = [[sorted([at[k] for k in gone] + [-at[k] for k in new]) for gone, new in swaps(text.as_py())] for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))], names=["label", "features", "pairs"])

    coded = staged(rows.mapInArrow(run, "label long, features array<int>, pairs array<array<int>>"), "coded")
    table = coded.select("label", "features").toArrow()
    # Equal swaps are one row with their number; there are as many as terms and carried beginnings make different.
    changes = coded.select(F.explode("pairs").alias("pair")).filter(F.size("pair") > 0).groupBy("pair").count().toArrow()
    lists = table.column("features").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    pairs = changes.column("pair").combine_chunks()
    signed = np.asarray(pairs.values, np.int64)
    n = changes.column("count").to_numpy().astype(float)
    return Problem(
        np.repeat(np.arange(len(size)), size), np.asarray(lists.values, np.int64), table.column("label").to_numpy().astype(float),
        np.repeat(np.arange(len(n)), np.diff(pairs.offsets.to_numpy())), np.abs(signed) - 1, np.sign(signed).astype(float), n / max(n.sum(), 1), penalty,
    )


def train(docs: DataFrame, labels: DataFrame, penalty: float = SWAP_PENALTY) -> Model:
    """Learn labels.toxic from the texts of the training share of ``docs``."""
    rows = _sample(docs, labels)
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not size.get(0) or not size.get(1):
        return _constant(size.get(1, 0), size.get(0, 0))
    counts = rows.mapInArrow(_counts, "feature long, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    odds = F.log((F.col("ones") + 0.5) / (F.lit(size[1]) + 1 - F.col("ones"))) - F.log((F.col("zeros") + 0.5) / (F.lit(size[0]) + 1 - F.col("zeros")))
    spread = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    best = counts.withColumn("z", F.abs(odds / spread)).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()
    vocabulary = np.unique(np.concatenate([np.array([r[0] for r in best], np.int64).view(np.uint64), TERM_FEATURES]))
    return _descend(problem_of(rows, vocabulary, penalty), vocabulary)


def scorer(model: Model):
    """mapInArrow function: (doc_id, text) to (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = np.zeros(1 << 20, bool)
        filter_bits[(model.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            scores = [model.logit(f[filter_bits[(f & np.uint64((1 << 20) - 1)).astype(np.int64)]]) for f in features(batch.column(1))]
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, one row for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scorer(model), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scores(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns."""
    model = train(docs, labels)
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            text = batch.column(names.index("text"))
            got = next(score(iter([pa.RecordBatch.from_arrays([text, text], names=["doc_id", "text"])])))
            yield batch.filter(pa.array(got.column(1).to_numpy() < THRESHOLD))

    return docs.mapInArrow(run, schema)
