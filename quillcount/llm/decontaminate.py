"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are normalised: A-Z lower-cased, every run of other ASCII bytes than letters and digits one
space; distances are in bytes of that form. An item is found in a text where a part of the text is within
``EDITS`` of the item's length of edits.

The windows of a text that are embedded have an item's size, to the power of two below it. A CGK random walk
reads a window: at step j it puts out the current byte and moves on if a random bit of (j, byte) says so. Two
windows at small edit distance have embeddings at small Hamming distance with good probability. Bit-sampling LSH:
each of ``WALKS`` walks gives ``TABLES`` keys, each of ``SAMPLED`` places of the embedding; a text's window and an
item's window with a key in common are a candidate. A text has windows from each of its characters on, so that text
without spaces, or an item that follows other text without a separator, is no exception. An item has windows from
each of its words on, and within longer words from every few bytes, so any part of it that is little edited finds
the rest. A candidate's place is then verified with the exact edit distance between the whole item and the best part
of the text there.

Before the walk a test lets only such windows pass as can be within ``EDITS`` of their size of edits of some item's
window: they share n - 7 - 8 * edits of their 8-byte strings with the items at least. An item whose edits all crowd in
the part that its windows have in common can be missed by it.

Items are taken in blocks of ``BLOCK_BYTES`` in expectation, by a hash; each block goes to all tasks and reads all
texts, so any number of items takes bounded memory. Items of under ``LEAST`` bytes are found where they stand
exactly and don't cut a word: at each end a space, another character than letters, marks and digits, or a character
of a script that is written without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer, Tibetan) has to meet.

Results: null and empty texts and items match nothing. Items that repeat are found under each of their ids; a
text that stands in several rows in each. Null ids stay null. Columns beyond those named are ignored. Without items,
or with an empty table, nothing is found.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .staging import staged

EDITS = 0.08
WALKS, TABLES, SAMPLED = 3, 16, 6
BLOCK_BYTES = 128 << 10
LEAST = 32
_GRAM = 8
_FILTER_BITS, _OWN_BITS = 22, 12
#: Windows, and bytes of them, that are embedded at a time.
_WINDOWS, _WINDOW_BYTES = 1 << 15, 1 << 22

#: Thai, Lao, Tibetan, Burmese, Khmer, Tai scripts, ideographs and kana with their punctuation and wide forms.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u1aaf\u2e80-\u312f\u31a0-\ua4cf\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff00-\uffef\U0001b000-\U0001b16f\U00020000-\U0003ffff]")

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[~scan.byte_class(b"", (48, 57), (65, 90), (97, 122), (128, 255))] = 32


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of each row, and its offsets; one space stands before and after every row's words."""
    b = _NORMAL[data]
    space = b == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    starts = off[:-1][np.diff(off) > 0]
    keep[starts] = True
    out, place = b[keep], np.append(0, np.cumsum(keep))
    cut = place[off]
    return np.insert(out, np.concatenate([cut[:-1], cut[1:]]), 32), cut + 2 * np.arange(len(cut))


class Index:
    """A block of items: its 8-byte strings, and for each window size the keys of its items' windows."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.items: list[tuple[object, bytes]] = []
        self.short: list[tuple[object, bytes]] = []
        for key, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            form = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if form:
                (self.items if len(form) >= LEAST else self.short).append((key, form))
        grams = [self._codes(np.frombuffer(t, np.uint8)) for _, t in self.items]
        self.own = np.zeros((len(self.items), 1 << _OWN_BITS), bool)
        for i, code in enumerate(grams):
            self.own[i, self._slot(code, _OWN_BITS)] = True
        sizes = defaultdict(list)
        for i, (_, t) in enumerate(self.items):
            size = 1 << (len(t).bit_length() - 1)
            sizes[size] += [(i, s) for s in self._starts(t, len(t) - size)]
        self.sizes = {}
        for size, windows in sorted(sizes.items()):
            owner, start = np.array(windows, np.int64).T
            rows = np.stack([np.frombuffer(self.items[i][1], np.uint8)[s : s + size] for i, s in windows])
            keys = self.keys(rows)
            tables = []
            for t in range(keys.shape[1]):
                order = np.argsort(keys[:, t], kind="stable")
                tables.append((keys[order, t], owner[order], start[order]))
            likely = np.zeros(1 << _FILTER_BITS, bool)
            likely[self._slot(keys.ravel())] = True
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[self._slot(np.concatenate([grams[i] for i in {*owner.tolist()}]))] = True
            self.sizes[size] = (tables, likely, known)

    @staticmethod
    def _starts(form: bytes, last: int) -> list[int]:
        """Where windows of an item start, up to ``last``: at words, within them every few bytes, and as late as can be."""
        out, late = [0], 0
        for k in range(1, last + 1):
            if form[k] == 32 or form[k] >> 6 == 2:
                continue
            late = k
            if form[k - 1] == 32 or k - out[-1] >= _GRAM:
                out.append(k)
        return out if late <= out[-1] else [*out, late]

    @staticmethod
    def _codes(b: np.ndarray) -> np.ndarray:
        n = len(b) - _GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        code = np.zeros(n, np.uint64)
        for j in range(_GRAM):
            code = (code << np.uint64(8)) | b[j : j + n].astype(np.uint64)
        return code

    @staticmethod
    def _slot(code: np.ndarray, bits: int = _FILTER_BITS) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def keys(rows: np.ndarray) -> np.ndarray:
        """windows x (WALKS * TABLES) keys of CGK embeddings; a walk takes twice as many steps as a window has bytes."""
        n, size = rows.shape
        steps = 2 * size
        flat = np.ascontiguousarray(rows).ravel()
        base = np.arange(n) * size
        out = np.zeros((n, WALKS * TABLES), np.uint64)
        for w in range(WALKS):
            rng = np.random.Generator(np.random.PCG64([w, size]))
            moves = rng.integers(0, 2, (steps, 256), dtype=np.uint8)
            places = defaultdict(list)
            for t in range(TABLES):
                for j in rng.choice(int(steps * 0.9), SAMPLED, replace=False).tolist():
                    places[j].append(w * TABLES + t)
            at = np.zeros(n, np.int64)
            last = max(places)
            for j in range(last + 1):
                # A walk that is through its window stays on the last byte.
                symbol = flat[base + np.minimum(at, size - 1)]
                for t in places.get(j, ()):
                    out[:, t] = out[:, t] * np.uint64(0x100000001B3) + symbol + np.uint64(1)
                at += moves[j][symbol]
        return scan.mix(out + np.arange(WALKS * TABLES, dtype=np.uint64))

    def found(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, object, int]]:
        """(row, item id, edit distance) in texts of normal form: each row and item once."""
        seen: dict[tuple[int, int], int] = {}
        codes = self._codes(data)
        slots = self._slot(codes)
        few = slots >> (_FILTER_BITS - _OWN_BITS)
        for row, item, near, last in self._candidates(data, off, slots):
            if seen.get((row, item)) == 0:
                continue
            form = self.items[item][1]
            limit = int(EDITS * len(form))
            a, b = max(int(off[row]), near - limit), min(int(off[row + 1]), last + len(form) + limit)
            # Each edit breaks 8 of the item's 8-byte strings at most; the others stand in the text.
            if np.count_nonzero(self.own[item][few[a : max(a, b - _GRAM + 1)]]) < len(form) - _GRAM + 1 - _GRAM * limit:
                continue
            text = data[a:b].tobytes()
            distance = 0 if form in text else edits_inside(form, text)
            if distance <= limit:
                seen[row, item] = min(distance, seen.get((row, item), distance))
        for (row, item), distance in seen.items():
            yield row, self.items[item][0], distance
        for row in range(len(off) - 1) if self.short else ():
            text = data[off[row] : off[row + 1]].tobytes()
            for key, form in self.short:
                if stands(form, text):
                    yield row, key, 0

    def _candidates(self, data: np.ndarray, off: np.ndarray, slots: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Distinct (row, item, first and last place where the item would start)."""
        if not self.items or len(data) < _GRAM:
            return []
        begins = (data != 32) & (data >> 6 != 2)
        # A candidate as one number: row and item, then the place, which can be before the text's first byte.
        before = max(len(form) for _, form in self.items)
        span = len(data) + before
        out = [np.zeros(0, np.int64)]
        for size, (tables, likely, grams) in self.sizes.items():
            if size > len(data):
                continue
            total = np.append(0, np.cumsum(grams[slots], dtype=np.int32))
            shared = total[size - _GRAM + 1 :] - total[: len(data) - size + 1]
            starts = np.flatnonzero((shared >= size - (_GRAM - 1) - _GRAM * EDITS * size) & begins[: len(shared)])
            rows = np.searchsorted(off, starts, "right") - 1
            fit = starts + size <= off[rows + 1]
            starts, rows = starts[fit], rows[fit]
            windows = np.lib.stride_tricks.sliding_window_view(data, size)
            step = max(1, min(_WINDOWS, _WINDOW_BYTES // size))
            for i in range(0, len(starts), step):
                here, row = starts[i : i + step], rows[i : i + step]
                keys = self.keys(windows[here])
                hits = likely[self._slot(keys.ravel())].reshape(keys.shape)
                for t, (table, owner, begin) in enumerate(tables):
                    at = np.flatnonzero(hits[:, t])
                    low, high = np.searchsorted(table, keys[at, t], "left"), np.searchsorted(table, keys[at, t], "right")
                    n = high - low
                    which = np.repeat(at, n)
                    place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    out.append(np.unique((row[which] * len(self.items) + owner[place]) * span + here[which] - begin[place] + before))
        found = np.unique(np.concatenate(out))
        if not len(found):
            return []
        # One range each for what the same passage's windows say; no place is left out.
        pair, near = found // span, found % span - before
        limits = np.array([max(_GRAM, int(EDITS * len(form))) for _, form in self.items])
        first = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(near) > limits[pair[1:] % len(self.items)])))
        last = np.append(first[1:], len(found)) - 1
        row, item = np.divmod(pair[first], len(self.items))
        return list(zip(row.tolist(), item.tolist(), near[first].tolist(), near[last].tolist(), strict=True))


def _spaced(c: str) -> bool:
    """Whether ``c`` is part of a word of a script that sets words apart."""
    return not _UNSPACED.match(c) and (unicodedata.category(c)[0] in "LMN" or c in "\u200c\u200d")


def stands(form: bytes, text: bytes) -> bool:
    """Whether ``form`` stands in ``text``, which starts and ends with a space, without cutting a word."""
    if b" " + form + b" " in text:
        return True
    k = text.find(form)
    if k >= 0:
        item = form.decode(errors="replace")
        head, tail = _spaced(item[0]), _spaced(item[-1])
    while k >= 0:
        before, after = text[max(0, k - 4) : k].decode(errors="ignore")[-1:], text[k + len(form) : k + len(form) + 4].decode(errors="ignore")[:1]
        if not (head and before and _spaced(before)) and not (tail and after and _spaced(after)):
            return True
        k = text.find(form, k + 1)
    return False


def edits_inside(pattern: bytes, text: bytes) -> int:
    """The smallest edit distance between ``pattern`` and any part of ``text``, by bit-parallel columns (Myers)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        score += 1 if up & top else -1 if down & top else 0
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(xv | up) & full, up & xv
    return best


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of items, of bounded size in expectation, and whether there is more than one."""
    known = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))), blocks > 1


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, _, data, off in scan.slices(column):
        yield (i, *normalised(data, off))


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance: one row for each text and item that is found in it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i + row, key, distance) for i, data, off in _slices(batch.column(1)) for row, key, distance in index.found(data, off)]
                at = pa.array([r for r, _, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k for _, k, _ in rows], pa.int64() if kind in ("bigint", "int") else None), pa.array([d for _, _, d in rows], pa.int64())], names=["doc_id", "item_id", "distance"])

        return run

    out = None
    for index, several in _blocks(items, block_bytes):
        part = texts.mapInArrow(finder(index), f"doc_id long, item_id {'long' if kind in ('bigint', 'int') else kind}, distance long")
        part = staged(part, "found") if several else part  # one block's index at a time is held
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id long, item_id {kind}, distance long")


def drop_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with all their columns."""
    schema, names = docs.schema, docs.columns

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, data, off in _slices(batch.column(names.index("text"))):
                    for row, _, _ in index.found(data, off):
                        keep[i + row] = False
                yield batch.filter(pa.array(keep))

        return run

    for index, several in _blocks(items, block_bytes):
        docs = docs.mapInArrow(keeper(index), schema)
        docs = staged(docs, "clean") if several else docs
    return docs
