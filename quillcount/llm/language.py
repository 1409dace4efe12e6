"""Language identification with bit-sliced Bloom filters of n-grams.

For every language a Bloom filter holds its ``GRAMS`` most frequent n-grams. The filters lie side by side: row i
of the table has one bit for each language, so the AND of the rows that an n-gram's hashes name is the set of
all languages that contain it, one look-up for all languages. A text's count for a language is the number of
its n-grams whose set has that bit. Of those, each filter's known rate of false positives is taken off:
(count - n * rate) / (1 - rate). The largest corrected count decides, ties go to the language that sorts first.

The n-gram counts come from a sample of ``SAMPLE_ROWS`` rows of each language in expectation, chosen by a hash of
doc_id. n-grams are runs of ``SIZES`` bytes of the lower-cased text inside a word and its borders.

Results: und with score 0 for a null text, a text without any letter, or a table without labelled rows. Null
languages are not learned, nor are rows with a null doc_id, which aren't held out either. The score is the share of the winner among all corrected counts. Columns beyond
doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .staging import staged

SAMPLE_ROWS = 3000
GRAMS = 20_000
SIZES = (3, 4)
HASHES = 3
#: Rows of the table; with 20,000 n-grams a filter's false positives are about one in 5,000.
TABLE_BITS = 20
UNDETERMINED = "und"

#: Lower case for A-Z; everything that isn't a letter or a byte of a longer character is a border.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~scan.byte_class(b"", (65, 90), (97, 122), (128, 255))] = 32


def _grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of the n-grams of each size that hold at most one border byte at either end."""
    b = np.concatenate([_FOLD[data], np.full(max(SIZES), 32, np.uint8)]).astype(np.uint64)
    n = len(data)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    letter = b != 32
    end = np.repeat(off[1:], np.diff(off))
    place = np.arange(n)
    for size in SIZES:
        code = np.full(n, size, np.uint64)
        whole = place + size <= end
        for j in range(size):
            code = (code << np.uint64(8)) | b[j : n + j]
            if 0 < j < size - 1:
                whole &= letter[j : n + j]
        whole &= letter[:n] | letter[size - 1 : n + size - 1]
        yield row[whole], code[whole]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in scan.slices(batch.column(0)):
            langs = batch.column(1).slice(i, j - i).dictionary_encode()
            lang = langs.indices.to_numpy()
            for row, code in _grams(data, off):
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    keys, n = np.unique(code[lang[row] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), scan.int64(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass
class Filters:
    """table: rows x words of language bits; rates: false positives of each language's filter."""

    languages: list[str]
    table: np.ndarray
    rates: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Filters:
        languages = sorted(grams)
        table = np.zeros((1 << TABLE_BITS, max(1, (len(languages) + 63) // 64)), np.uint64)
        fill = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            at = np.unique(np.concatenate(cls.places(grams[lang])))
            table[at, i // 64] |= np.uint64(1 << (i % 64))
            fill[i] = len(at) / len(table)
        return cls(languages, table, fill**HASHES)

    @staticmethod
    def places(code: np.ndarray) -> list[np.ndarray]:
        h = scan.mix(code.astype(np.uint64))
        mask = np.uint64((1 << TABLE_BITS) - 1)
        return [((h >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(HASHES)]

    def count(self, row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        """rows x languages: how many of a row's n-grams each language's filter holds."""
        places = self.places(code)
        out = np.zeros((rows, len(self.languages)))
        for w in range(self.table.shape[1]):
            mask = self.table[places[0], w]
            for p in places[1:]:
                mask = mask & self.table[p, w]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[:, i] += np.bincount(row, (mask >> np.uint64(i % 64)) & np.uint64(1), rows)
        return out


def training_share(docs: DataFrame) -> DataFrame:
    return docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def learn(docs: DataFrame) -> Filters:
    """Filters from the labelled rows of ``docs`` (doc_id, text, lang)."""
    known = docs.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Filters.build({})
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))).otherwise(share)
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    counts = sample.select("text", "lang").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = staged(counts, "grams")
    grams = {}
    for lang in sizes:
        best = counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(GRAMS).select("gram").collect()
        grams[lang] = np.array([r[0] for r in best], np.int64).view(np.uint64)
    return Filters.build(grams)


_NO_LETTER = "^[^\\p{L}]*$"


def _predict(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score = [UNDETERMINED] * n, np.zeros(n)
            mute = pc.fill_null(pc.match_substring_regex(batch.column(1), _NO_LETTER), True).to_numpy(zero_copy_only=False)
            for i, j, data, off in scan.slices(batch.column(1)):
                if not filters.languages:
                    break
                counts, total = np.zeros((j - i, len(filters.languages))), np.zeros(j - i)
                for row, code in _grams(data, off):
                    counts += filters.count(row, code, j - i)
                    total += np.bincount(row, minlength=j - i)
                true = np.maximum((counts - total[:, None] * filters.rates) / (1 - filters.rates), 0)
                best, whole = true.argmax(axis=1), true.sum(axis=1)
                for k in np.flatnonzero(~mute[i:j]):
                    pred[i + k] = filters.languages[best[k]]
                    score[i + k] = true[k, best[k]] / whole[k] if whole[k] > 0 else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(filters), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Filters learned from the training share of ``docs``, applied to all of it."""
    out = identify(docs, learn(training_share(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
