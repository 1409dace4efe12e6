"""Removal of repeated byte strings with sharded suffix arrays.

A byte goes if a ``WINDOW``-byte string covers it that also starts earlier (smaller doc_id, or same document and
earlier start). The corpus is cut into shards such that all equal windows meet in one of them:

1. One pass finds every window's anchor (anchors.py), a string of ``GRAM`` bytes inside it. What an anchor's windows
   can cover, ``WINDOW - GRAM`` bytes before it to ``WINDOW`` after its start, is its region, known by a cryptographic
   digest of 128 bits (BLAKE2) of its bytes. Anchors go, packed in blobs, to the bucket of their gram's hash; of regions of
   one digest a task sends on only its first, the windows of the others are repeats. A gram with many different regions in one task is dealt over all buckets.
2. In its bucket the first of each region's occurrences stays, the others are repeats. Regions whose gram has
   other regions too, the edges of copies, are asked for.
3. The regions asked for are cut out of the texts and dealt to shards by gram; a shard's bytes go to a scratch file as
   they come, and are sorted there by external induced sorting (suffix_sort.py), in ``MEMORY_ENTRIES`` entries of memory and
   some 60 bytes for each region; suffixes with WINDOW bytes in common are one string, of which the first
   occurrence stays. A gram with over ``HOT_REGIONS`` regions, a common line with different surroundings, would be one shard that
   only one task can sort: its windows are compared by a shuffle on their 128-bit hashes.
4. Each document's repeats are merged and cut out.

Results: a null or empty text, and one shorter than WINDOW, loses nothing. Rows with a null doc_id are no
document and lose nothing. Rows that share doc_id and text count as one document and each get its result; rows
that share only doc_id are ordered by a hash of their text. An empty table gives an empty result. Columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .anchors import anchors
from .staging import staged
from .suffix_sort import MEMORY_ENTRIES, Disk, sorted_suffixes

WINDOW, GRAM = 100, 32
SIDE = WINDOW - GRAM
#: Text bytes for each bucket of anchors, and bytes of regions for each shard of suffixes.
BUCKET_BYTES, SHARD_BYTES = 8 << 20, 3 << 19
#: Anchors a task gathers before it sends them on.
FLUSH = 1 << 19
#: Different regions of one gram: in a task's gathering, before they are dealt; in all, before windows are shuffled.
DEALT_REGIONS, HOT_REGIONS = 256, 20_000
SLICE = 1 << 18

_BLOB = "part int, spans boolean, blob binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-, 32- or 8-bit integers, one after the other, behind their types and lengths."""
    head = struct.pack("<B", len(columns)) + b"".join(struct.pack("<BQ", c.dtype.itemsize, len(c)) for c in columns)
    return head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blob: bytes) -> list[np.ndarray]:
    kinds = {8: np.uint64, 4: np.uint32, 1: np.uint8}
    at, out = 1 + 9 * blob[0], []
    for i in range(blob[0]):
        size, n = struct.unpack_from("<BQ", blob, 1 + 9 * i)
        out.append(np.frombuffer(blob, kinds[size], n, at))
        at += size * n
    return out


def _gather(buckets: int, dealt_regions: int):
    """mapInArrow function: (doc_id, h, text) to blobs of anchors by bucket, and of spans that are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[np.ndarray] = []
        docs = count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, docs, count
            if not count:
                held, ids, docs = [], [], 0
                return
            gram, region, second, row, at, first, last = (np.concatenate(c) for c in zip(*held, strict=True))
            doc = np.concatenate(ids)
            # Documents in their order; rows that repeat are the same document.
            distinct, rank = np.unique(doc, return_inverse=True)
            row = rank[row].astype(np.uint64)
            order = np.lexsort(((row << np.uint64(32)) | at, second, region, gram))
            gram, region, second, row, at, first, last = (c[order] for c in (gram, region, second, row, at, first, last))
            new_gram = np.append(True, gram[1:] != gram[:-1])
            new = new_gram | np.append(True, (region[1:] != region[:-1]) | (second[1:] != second[:-1]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & ((row != row[lead]) | (at != at[lead]))
            parts, kinds, blobs = [], [], []
            if again.any():
                parts.append(int(gram[0] % np.uint64(buckets)))
                kinds.append(True)
                blobs.append(_spans(distinct, row[again], first[again], last[again] + WINDOW))
            gram, region, second, row, at, first, last, new_gram = (c[new] for c in (gram, region, second, row, at, first, last, new_gram))
            group = new_gram.cumsum() - 1
            dealt = (np.bincount(group) > dealt_regions)[group]
            bucket = np.where(dealt, scan.mix(gram ^ region), gram) % np.uint64(buckets)
            # A gram that is dealt leaves a mark in its own bucket: other tasks' regions of it have company.
            marks = np.unique(gram[dealt])
            mark_bucket = marks % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            for b in np.union1d(bucket, mark_bucket).tolist():  # those that get something
                low, high = np.searchsorted(bucket, np.uint64(b), "left", order), np.searchsorted(bucket, np.uint64(b), "right", order)
                mine = order[low:high]
                marked = marks[mark_bucket == np.uint64(b)] if len(marks) else marks
                if len(mine) or len(marked):
                    own, place = np.unique(row[mine].astype(np.int64), return_inverse=True)
                    used = distinct[own]
                    parts.append(b)
                    kinds.append(False)
                    blobs.append(_pack(gram[mine], region[mine], second[mine], place.astype(np.uint32), at[mine].astype(np.uint32), (at[mine] - first[mine]).astype(np.uint8), (last[mine] - first[mine]).astype(np.uint8), dealt[mine].astype(np.uint8), used["id"].view(np.uint64), used["h"].view(np.uint64), marked))
            held, ids, docs, count = [], [], 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "spans", "blob"])

        for batch in batches:
            doc = np.empty(batch.num_rows, _DOC)
            doc["id"], doc["h"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, off in scan.slices(batch.column(2), SLICE):
                at, first, last, gram = anchors(data, off, WINDOW, GRAM)
                row = np.searchsorted(off, at, "right") - 1
                begin, end = np.maximum(at - SIDE, off[row]), np.minimum(at + WINDOW, off[row + 1])
                raw = data.tobytes()
                digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
                region, second = halves[:, 0] ^ scan.mix((at - begin).astype(np.uint64)), halves[:, 1].copy()
                base = off[row]
                held.append((gram, region, second, row + docs, (at - base).astype(np.uint64), (first - base).astype(np.uint64), (last - base).astype(np.uint64)))
                ids.append(doc[i:j])
                docs += j - i
                count += len(at)
                if count >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


_DOC = np.dtype([("id", np.int64), ("h", np.int64)])


def _spans(docs: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """A blob of spans, those of a document that touch merged."""
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    wide = (1 << 33) * row
    reach = np.maximum.accumulate(end + wide)
    new = np.append(True, (start + wide)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return _pack(docs["id"][row[at]].view(np.uint64), docs["h"][row[at]].view(np.uint64), start[at].astype(np.uint64), (reach[np.append(at[1:], len(new)) - 1] - wide[at]).astype(np.uint64))


_FOUND = "doc_id long, h long, start long, stop long, anchor long, gram long, hot boolean"


def _found(docs: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray | None, gram: np.ndarray | None, hot: np.ndarray | None) -> pa.Table:
    n = len(row)
    nothing = pa.nulls(n, pa.int64())
    return pa.table({"doc_id": pa.array(docs["id"][row]), "h": pa.array(docs["h"][row]), "start": pa.array(start.astype(np.int64)), "stop": pa.array(stop.astype(np.int64)), "anchor": nothing if anchor is None else pa.array(anchor.astype(np.int64)), "gram": nothing if gram is None else scan.int64(gram), "hot": pa.array(np.zeros(n, bool) if hot is None else hot)})


def _settle(table: pa.Table, hot_regions: int) -> pa.Table:
    """One bucket: spans of the occurrences after a region's first; requests (anchor not null) for regions in company."""
    out = []
    columns: list[list[np.ndarray]] = [[] for _ in range(8)]
    ids, marks, docs = [], [], 0
    for is_span, blob in zip(table.column("spans").to_pylist(), table.column("blob"), strict=True):
        got = _unpack(blob.as_py())
        if is_span:
            both = np.empty(len(got[0]), _DOC)
            both["id"], both["h"] = got[0].view(np.int64), got[1].view(np.int64)
            out.append(_found(both, np.arange(len(both)), got[2], got[3], None, None, None))
            continue
        gram, region, second, place, at, back, wide, dealt, own, h, marked = got
        both = np.empty(len(own), _DOC)
        both["id"], both["h"] = own.view(np.int64), h.view(np.int64)
        ids.append(both)
        marks.append(marked)
        for col, x in zip(columns, (gram, region, second, place.astype(np.int64) + docs, at, back, wide, dealt), strict=True):
            col.append(x)
        docs += len(own)
    if ids:
        gram, region, second, row, at, back, wide, dealt = (np.concatenate(c) for c in columns)
        known, rank = np.unique(np.concatenate(ids), return_inverse=True)
        row = rank[row]
        order = np.lexsort(((row.astype(np.uint64) << np.uint64(32)) | at, second, region, gram))
        gram, region, second, row, at, back, wide, dealt = (c[order] for c in (gram, region, second, row, at, back, wide, dealt))
        at, first = at.astype(np.int64), at.astype(np.int64) - back
        last = first + wide
        new_gram = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
        new = new_gram | np.append(True, (region[1:] != region[:-1]) | (second[1:] != second[:-1]))[: len(gram)]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
        again = ~new & ((row != row[lead]) | (at != at[lead]))
        if again.any():
            got = _unpack(_spans(known, row[again], first[again], last[again] + WINDOW))
            both = np.empty(len(got[0]), _DOC)
            both["id"], both["h"] = got[0].view(np.int64), got[1].view(np.int64)
            out.append(_found(both, np.arange(len(both)), got[2], got[3], None, None, None))
        group = new_gram.cumsum() - 1
        regions = np.bincount(group, new) if len(group) else np.zeros(0)
        marked = np.isin(gram, np.concatenate(marks))
        company = new & ((regions[group] > 1) | marked | (dealt > 0))
        hot = ((regions[group] > hot_regions) | marked | (dealt > 0))[company]
        out.append(_found(known, row[company], first[company], last[company], at[company], gram[company], hot))
    empty = np.zeros(0, np.int64)
    return pa.concat_tables(out) if out else _found(np.zeros(0, _DOC), empty, empty, empty, empty, empty.view(np.uint64), empty.astype(bool))


_CUT = "shard long, gram long, doc_id long, h long, first long, anchor long, piece binary"


def _cut(shards: int):
    """mapInArrow function: (doc_id, h, text, requests) to the regions asked for; hot ones as one row a window.

    A row of a hot region holds its window's hash in shard and gram, and no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[] for _ in range(7)]
            size = 0

            def take(held: list[list] = held) -> pa.RecordBatch:
                kinds = (*[pa.int64()] * 6, pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=["shard", "gram", "doc_id", "h", "first", "anchor", "piece"])

            for doc_id, h, text, asked in zip(*(batch.column(k) for k in range(4)), strict=True):
                doc_id, h, data = doc_id.as_py(), h.as_py(), text.as_py().encode()
                asked = asked.values.flatten()
                start, stop, anchor, gram, hot = (x.to_numpy(zero_copy_only=False) for x in asked)
                shard = (scan.mix(gram.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                prefix = None
                for a, b, c, g, s, is_hot in zip(start.tolist(), stop.tolist(), anchor.tolist(), gram.tolist(), shard.tolist(), hot.tolist(), strict=True):
                    if is_hot:
                        if prefix is None:
                            raw = np.frombuffer(data, np.uint8)
                            prefix = scan.prefix_hash(raw), scan.prefix_hash(raw, scan.FOLDED_CODES[::-1])
                        places = np.arange(a, b + 1)
                        one, two = (scan.range_hash(p, places, places + WINDOW) for p in prefix)
                        rows = (scan.int64(one).to_pylist(), scan.int64(two).to_pylist(), [doc_id] * len(places), [h] * len(places), places.tolist(), [c] * len(places), [None] * len(places))
                        for col, x in zip(held, rows, strict=True):
                            col += x
                        size += 40 * len(places)
                    else:
                        for col, x in zip(held, (s, g, doc_id, h, a, c, data[a : b + WINDOW]), strict=True):
                            col.append(x)
                        size += b + WINDOW - a
                    if size > 8 << 20:
                        yield take()
                        for col in held:
                            col.clear()
                        size = 0
            yield take()

    return run


_SPAN = "doc_id long, h long, start long, stop long"


class Shard:
    """A shard's regions as they come: their bytes on disk, their places in memory."""

    def __init__(self, memory_entries: int = MEMORY_ENTRIES) -> None:
        self.disk = Disk(memory_entries)
        self.columns: list[list[np.ndarray]] = [[] for _ in range(8)]

    def take(self, batches: Iterator[pa.RecordBatch]) -> None:
        """Keep the batches' pieces, and of each side of each anchor a hash of the bytes that a window there must hold."""
        self.data = self.disk.stored(self._bytes(batches), np.uint8)
        self.gram, self.doc_id, self.h, self.first, self.anchor, self.size, self.left, self.right = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.columns)

    def _bytes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        half = SIDE // 2
        for batch in batches:
            pieces = batch.column(batch.schema.get_field_index("piece")).to_pylist()
            own = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("gram", "doc_id", "h", "first", "anchor")]
            size = np.array([len(p) for p in pieces], np.int64)
            data = np.frombuffer(b"".join(pieces), np.uint8)
            base = np.concatenate([[0], np.cumsum(size)])
            prefix, mid, sides = scan.prefix_hash(data), base[:-1] + own[4] - own[3], []
            for a, b in ((mid - half, mid + GRAM), (mid, mid + GRAM + half)):
                ok = (a >= base[:-1]) & (b <= base[1:])
                key = scan.range_hash(prefix, np.where(ok, a, 0), np.where(ok, b, 0)) ^ own[0].view(np.uint64)
                sides.append(np.where(ok, key | np.uint64(1), 0))
            for column, x in zip(self.columns, (*own, size, *sides), strict=True):
                column.append(x)
            yield data

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (piece, window start in its text) of windows that also start earlier.

        A window reaches SIDE / 2 bytes or more to one side of its anchor's gram, so pieces that share neither side's
        bytes of that length with another piece of the gram can't share a window; they don't enter the suffix array.
        """
        half = SIDE // 2
        base = np.concatenate([[0], np.cumsum(self.size)])
        mid = base[:-1] + self.anchor - self.first
        shared = []
        for key in (self.left, self.right):
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            shared.append((key != 0) & (n[inverse] > 1))
        low = np.where(shared[0], base[:-1], np.maximum(base[:-1], mid - half))
        high = np.where(shared[1], base[1:] - WINDOW, np.minimum(base[1:] - WINDOW, mid - half))
        use = np.flatnonzero((shared[0] | shared[1]) & (low <= high))
        if len(use) < 2:
            return
        low, wide = low[use], high[use] + WINDOW - low[use]
        at = np.concatenate([[0], np.cumsum(wide + 1)])
        text = self.disk.stored(self._symbols(low, wide, at), np.uint16)
        _, owner = np.unique(self._documents(), return_inverse=True)
        owner, start_of = owner[use], low - base[use] + self.first[use]
        number, lead = -1, None  # the string that a block begins with, and its first occurrence so far
        for pos, lcp in sorted_suffixes(text, WINDOW, self.disk):
            piece = np.searchsorted(at, pos, "right") - 1
            inside = pos - at[piece] <= wide[piece] - WINDOW
            string = number + (lcp < WINDOW).cumsum()
            number = int(string[-1])
            pos, piece, string = pos[inside], piece[inside], string[inside]
            who, start = owner[piece], pos - at[piece] + start_of[piece]
            if lead is not None:
                string, who, start, piece = (np.append(x, y) for x, y in zip((string, who, start, piece), lead, strict=True))
            if not len(string):
                continue
            order = np.lexsort((start, who, string))
            string, who, start, piece = string[order], who[order], start[order], piece[order]
            new = np.append(True, string[1:] != string[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = (who != who[head]) | (start != start[head])
            lead = tuple(x[head[-1]] for x in (string, who, start, piece)) if string[-1] == number else None
            if again.any():
                yield use[piece[again]], start[again]

    def _documents(self) -> np.ndarray:
        both = np.empty(len(self.doc_id), _DOC)
        both["id"], both["h"] = self.doc_id, self.h
        return both

    def _symbols(self, low: np.ndarray, wide: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The pieces' bytes as symbols from 1 on, a 0 after each, some at a time."""
        i = 0
        while i < len(low):
            j = max(i + 1, int(np.searchsorted(at, at[i] + self.disk.block, "right")) - 1)
            source = np.repeat(low[i:j] - (at[i:j] - at[i]), wide[i:j] + 1) + np.arange(at[j] - at[i])
            symbols = self.data[np.minimum(source, len(self.data) - 1)].astype(np.uint16) + np.uint16(1)
            symbols[at[i + 1 : j + 1] - 1 - at[i]] = 0
            yield symbols
            i = j


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    shard.take(batches)
    documents = shard._documents()
    for piece, start in shard.repeats():
        known, rank = np.unique(documents[piece], return_inverse=True)
        ids, h, a, b = _unpack(_spans(known, rank, start, start + WINDOW))
        yield pa.RecordBatch.from_arrays([scan.int64(x) for x in (ids, h, a, b)], names=["doc_id", "h", "start", "stop"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the result's rows."""
    for batch in batches:
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            kept, at, count = hashlib.sha256(), 0, 0
            gone = 0
            if spans.is_valid:
                start, stop = (x.to_numpy() for x in spans.values.flatten())
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order])
                new = np.append(True, start[1:] > reach[:-1])
                for a, b in zip(start[new].tolist(), reach[np.append(new[1:], True)].tolist(), strict=True):
                    kept.update(data[at:a])
                    at, count, gone = b, count + 1, gone + b - a
            kept.update(data[at:])
            n_bytes.append(len(data))
            n_removed.append(gone)
            n_spans.append(count)
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, dealt_regions: int = DEALT_REGIONS, hot_regions: int = HOT_REGIONS) -> tuple[DataFrame, DataFrame]:
    """(texts with doc_id, h and text; spans with doc_id, h, start, stop): bytes of windows that also start earlier."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), "text")
    known = texts.filter("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // BUCKET_BYTES)
    blobs = known.mapInArrow(_gather(buckets, dealt_regions), _BLOB)
    found = staged(blobs.groupBy("part").applyInArrow(lambda table: _settle(table, hot_regions), _FOUND), "found")
    asked = found.filter("anchor is not null")
    some = asked.agg(F.sum(F.col("stop") - F.col("start") + WINDOW).alias("bytes"), F.max("hot").alias("hot")).first()
    spans = found.filter("anchor is null").select("doc_id", "h", "start", "stop")
    if not some.bytes:
        return texts, spans
    shards = max(16, some.bytes // SHARD_BYTES)
    lists = asked.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop", "anchor", "gram", "hot")).alias("asked"))
    cut = known.join(lists, ["doc_id", "h"]).select("doc_id", "h", "text", "asked").mapInArrow(_cut(shards), _CUT)
    if some.hot:
        cut = staged(cut, "regions")
        windows = cut.filter("piece is null").select("shard", "gram", "doc_id", "h", "first")
        first = staged(windows.groupBy("shard", "gram").agg(F.min(F.struct("doc_id", "h", "first")).alias("lead"), F.count("*").alias("n")).filter("n > 1"), "windows")
        late = windows.join(first, ["shard", "gram"]).filter(F.struct("doc_id", "h", "first") != F.col("lead"))
        spans = spans.unionByName(late.select("doc_id", "h", F.col("first").alias("start"), (F.col("first") + WINDOW).alias("stop")))
        cut = cut.filter("piece is not null")
    return texts, spans.unionByName(cut.groupBy("shard").applyInArrow(_sort_shard, _SPAN))


def remove_repeats(docs: DataFrame, dealt_regions: int = DEALT_REGIONS, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of ``docs``."""
    texts, spans = repeated_spans(docs, dealt_regions, hot_regions)
    lists = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(lists, ["doc_id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
