"""Mixing to target weights with soft memberships.

1. Classifier: a table with domain labels gives, over all its labelled rows, word counts of each domain in
   ``BUCKETS`` hashed buckets; naive Bayes on them. A text's log-likelihoods are averaged over its words and counted
   as ``EVIDENCE`` words, so that posteriors stay soft however long a text is.
2. Rates: document i with n_i tokens and posteriors p_i gets a rate r_i >= 0, the expected number of its copies. The
   expected tokens of domain d are sum_i r_i n_i p_id. Starting from r = 1, projected gradient steps
   r_i <- max(0, r_i - p_i . v) lower the squared distance of these totals to their targets; v is the distance times
   the inverse of the Gram matrix of the documents whose rate isn't 0, so a step that meets no bound ends it.

A rate depends on a document's posteriors and the short history of the vectors v only, so no step writes a
table: each is one pass over the posteriors that sums a vector and a matrix per task, and only their totals, as
many numbers as domains and pairs of domains, reach the driver. The result applies the same steps to each text.

Tokens are words, runs of bytes beyond white space. Results: a null or empty text has no tokens, the domains'
shares of the labelled words as posteriors and a rate like any other. A domain that the targets don't name has
the target 0. A target whose domain no posterior reaches can't be met; the rates are then the best found.
More than ``MOST_DOMAINS`` values of the label are a ValueError: nothing is left out or put together
silently. Without any labelled row there is no domain: every rate is 1 and the domain null. Null labels are not learned.
Columns beyond doc_id, text and the label are kept by ``mixed`` and used by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .staging import staged

BUCKETS = 1 << 13
EVIDENCE = 12.0
#: Domains the model holds; its matrix has BUCKETS numbers for each.
MOST_DOMAINS = 128
STEPS = 40
CLOSE = 1e-9

WORD = ~scan.byte_class(b" \t\n\v\f\r")


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word."""
    starts, ends = scan.spans_of(data, off, WORD)
    hashes = scan.range_hash(scan.prefix_hash(data, scan.FOLDED_CODES), starts, ends)
    return np.searchsorted(off, starts, "right") - 1, (hashes % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Domains:
    """names; prior: share of each; weight: log-probability of each bucket (buckets x domains)."""

    names: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of a column of texts."""
        tokens, out = np.zeros(len(column), np.int64), np.zeros((len(column), len(self.names)))
        for i, j, data, off in scan.slices(column):
            row, bucket = _words(data, off)
            n = np.bincount(row, minlength=j - i)
            tokens[i:j] = n
            part = np.stack([np.bincount(row, self.weight[bucket, d], j - i) for d in range(len(self.names))], axis=1) if self.names else out[i:j]
            out[i:j] = part * (np.minimum(EVIDENCE, n) / np.maximum(n, 1))[:, None]
        out += np.log(self.prior)[None, :]
        out = np.exp(out - out.max(axis=1, keepdims=True)) if self.names else out
        return tokens, out / out.sum(axis=1, keepdims=True) if self.names else out


def learn(labelled: DataFrame, label: str) -> Domains:
    """The classifier of ``label`` from all rows of ``labelled`` (text and label)."""
    known = labelled.select(F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text")).filter("label is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j, data, off in scan.slices(batch.column(1)):
                names = batch.column(0).slice(i, j - i).to_pylist()
                index = {x: k for k, x in enumerate(dict.fromkeys(names))}
                owner = np.array([index[x] for x in names])
                row, bucket = _words(data, off)
                sums = np.bincount(owner[row] * BUCKETS + bucket, minlength=len(index) * BUCKETS).reshape(-1, BUCKETS)
                for x, k in index.items():
                    held[x] = held.get(x, 0) + sums[k]
            if len(held) > MOST_DOMAINS:
                yield from give(held)
                held = {}
        yield from give(held)

    def give(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["label", "bucket", "n"])

    counts = staged(known.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "domains")
    names = sorted(r.label for r in counts.select("label").distinct().limit(MOST_DOMAINS + 1).collect())
    if len(names) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    matrix = np.zeros((BUCKETS, len(names)))
    found = counts.toArrow()  # MOST_DOMAINS * BUCKETS rows at most
    place = {x: k for k, x in enumerate(names)}
    matrix[found.column("bucket").to_numpy(), [place[x] for x in found.column("label").to_pylist()]] = found.column("n").to_numpy()
    total = matrix.sum(axis=0)
    return Domains(names, (total + 1) / (total + 1).sum(), np.log((matrix + 0.5) / (total + 0.5 * BUCKETS)))


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p (rows) after the projected steps."""
    r = np.ones(len(p))
    for v in steps:
        r = np.maximum(0.0, r - p @ v)
    return r


def _totals(steps: list[np.ndarray], n_domains: int):
    """mapInArrow function: (tokens, p) to (place, value) of a task's totals and of the Gram matrix behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(n_domains), np.zeros((n_domains, n_domains))
        for batch in batches:
            n = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).values.to_numpy()[batch.column(1).offsets[0].as_py() :].reshape(-1, n_domains)[: len(n)]
            r = rates(p, steps)
            total += (r * n) @ p
            gram += (p * (n * (r > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_domains * (n_domains + 1)), pa.int64()), pa.array(np.concatenate([total, gram.ravel()]))], names=["place", "value"])

    return run


def fit(docs: DataFrame, domains: Domains, targets: dict[str, float] | None = None) -> list[np.ndarray]:
    """Steps whose rates bring the domains' expected tokens to the targets' shares (all equal, by default) of all tokens."""
    d = len(domains.names)
    if not d:
        return []

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = domains.posteriors(batch.column(0))
            offsets = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * d)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=["tokens", "p"])

    soft = staged(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(weigh, "tokens long, p array<double>").filter("tokens > 0"), "posteriors")
    want = np.array([1.0 if targets is None else targets.get(x, 0.0) for x in domains.names])
    if want.sum() <= 0:
        raise ValueError("no domain has a target")
    whole = soft.agg(F.sum("tokens")).first()[0] or 0
    want = want / want.sum() * whole
    steps, best, close = [], [], np.inf
    for _ in range(STEPS if whole else 0):
        rows = soft.mapInArrow(_totals(steps, d), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        values = np.zeros(d * (d + 1))
        for r in rows:
            values[r.place] = r.value
        off = values[:d] - want
        if np.abs(off).sum() < close * (1 - 1e-6):
            best, close = list(steps), np.abs(off).sum()
        if np.abs(off).sum() <= CLOSE * whole:
            break
        gram = values[d:].reshape(d, d)
        steps.append(np.linalg.pinv(gram + np.eye(d) * 1e-12 * np.trace(gram)) @ off)
    return best


def mixed(docs: DataFrame, domains: Domains, steps: list[np.ndarray]) -> DataFrame:
    """All rows and columns of ``docs`` with mix_tokens, mix_domain (the likeliest), mix_share (its posterior) and mix_rate.

    The new columns take the place of older ones of these names.
    """
    new = [("mix_tokens", T.LongType()), ("mix_domain", T.StringType()), ("mix_share", T.DoubleType()), ("mix_rate", T.DoubleType())]
    docs = docs.drop(*(c for c, _ in new))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = domains.posteriors(batch.column(names.index("text")))
            if domains.names and len(tokens):
                top = p.argmax(axis=1)
                found = [pa.array([domains.names[k] for k in top], pa.string()), pa.array(p.max(axis=1)), pa.array(rates(p, steps))]
            else:
                found = [pa.nulls(len(tokens), pa.string()), pa.nulls(len(tokens), pa.float64()), pa.array(np.ones(len(tokens)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), *found], names=[*names, *(c for c, _ in new)])

    return docs.mapInArrow(run, schema)


def mix(docs: DataFrame, label: str, targets: dict[str, float] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with rates that bring the expected tokens of the domains in ``label`` to the targets."""
    domains = learn(docs if labelled is None else labelled, label)
    return mixed(docs, domains, fit(docs, domains, targets))
