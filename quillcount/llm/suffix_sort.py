"""External induced sorting of suffixes with their common-prefix lengths.

A suffix is left (L) if it is larger than the one after it, else S; an S after an L is a star. Stars split the
text into star substrings. These are sorted by inducing, named, and, unless all names differ, the sequence of
names is sorted by recursion, in the same way and at every alphabet. From the sorted stars all left suffixes follow in
one ascending pass, from those all S suffixes in one descending pass: whenever a suffix leaves the queue of its first
symbol, the one before it in the text enters the queue of its own. In the last induction of the text itself the tuples
also carry common-prefix lengths: one more than the smallest that has passed since the target queue's last entry.

A symbol's queue receives its entries in their final order, so the priority queue of all (symbol, rank) tuples
is a first-in-first-out queue for each symbol, or, where symbols are many, for each range of symbols with at most a
block of suffixes; the order inside a range is found when the pass comes to it (``_settled``). Queues, left suffixes, stars, results
are logs of blocks. All logs of a sort share one ``Disk``: beyond ``memory_entries`` entries in memory, blocks go to its scratch
file, and whole arrays (texts of names, star positions) that are longer than that are memory maps of such files. So
memory is a small multiple of ``memory_entries``, whatever the length of the text. A scratch file has no name, lies
where Spark lets its workers spill, and ends with its task; a repeated task begins anew.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

#: Entries of all logs of a sort that are held in memory.
MEMORY_ENTRIES = 1 << 17
#: Alphabets up to this size have a queue for each symbol.
SYMBOL_QUEUES = 1024

Block = tuple[np.ndarray, ...]


def scratch_file():
    """A nameless file in the folder that Spark gives its workers to spill to."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return tempfile.TemporaryFile(dir=folders[0] if folders else None)


class Disk:
    """What a sort's logs hold in memory, and the scratch file that takes the rest."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.most, self.spilled = max(limit, 8), 0, 0, 0
        self.file, self.end = None, 0
        self.free: dict[int, list[int]] = {}  # places by the logarithm of their size
        self.logs: set[Log] = set()

    @property
    def block(self) -> int:
        return max(2, self.limit // 4)

    def room(self, n: int) -> None:
        if self.held + n > self.limit:
            for log in self.logs:
                log.spill()
            self.logs.clear()
        self.most = max(self.most, self.held + n)

    def put(self, block: Block) -> tuple:
        """To the scratch file, in space that blocks have left or at its end; numbers under 2**32 take four bytes."""
        if self.file is None:
            self.file = scratch_file()
        block = tuple(c.astype(np.uint32) if c.dtype == np.int64 and len(c) and 0 <= c.min() and c.max() < 1 << 32 else c for c in block)
        size = max(9, int(sum(c.nbytes for c in block) - 1).bit_length())
        free = self.free.setdefault(size, [])
        at = free.pop() if free else self.end
        self.end = max(self.end, at + (1 << size))
        self.file.seek(at)
        for column in block:
            self.file.write(memoryview(np.ascontiguousarray(column)).cast("B"))
        self.spilled += len(block[0])
        return at, len(block[0]), tuple(c.dtype for c in block), size

    def take(self, place: tuple) -> Block:
        """A block back from the file; its space is free."""
        at, n, kinds, size = place
        self.file.seek(at)
        block = tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)
        self.free[size].append(at)
        return tuple(c.astype(np.int64) if c.dtype == np.uint32 else c for c in block)

    def stored(self, parts: Iterator[np.ndarray], dtype) -> np.ndarray:
        """The parts as one array: in memory if it's short, else a memory map."""
        held, n, file = [], 0, None
        for part in parts:
            part = np.ascontiguousarray(part, dtype)
            n += len(part)
            if file is None and n > self.limit:
                file = scratch_file()
                for old in held:
                    file.write(memoryview(old).cast("B"))
                held = []
            if file is None:
                held.append(part)
            elif len(part):
                file.write(memoryview(part).cast("B"))
        if file is None:
            return np.concatenate(held) if held else np.zeros(0, dtype)
        file.flush()
        self.spilled += n
        return np.memmap(file, dtype, "r+", shape=(n,))

    def empty(self, n: int, dtype) -> np.ndarray:
        if n <= self.limit:
            return np.zeros(n, dtype)
        file = scratch_file()
        file.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(n,))


class Log:
    """Blocks of parallel arrays, in the order in which they came."""

    def __init__(self, disk: Disk) -> None:
        self.disk, self.blocks = disk, deque()

    def append(self, *columns: np.ndarray) -> None:
        for i in range(0, len(columns[0]), self.disk.block):
            block = tuple(c[i : i + self.disk.block] for c in columns)
            self.disk.room(len(block[0]))
            self.disk.held += len(block[0])
            self.disk.logs.add(self)
            self.blocks.append(block)

    def spill(self) -> None:
        """To disk with the blocks in memory, neighbours as one."""
        kept: deque = deque()
        while self.blocks:
            run = self._run(self.blocks.popleft, 0, isinstance(self.blocks[0][0], np.ndarray))
            if isinstance(run[0][0], np.ndarray):
                self.disk.held -= sum(len(x[0]) for x in run)
                run = [self.disk.put(_joined(run))]
            kept.extend(run)
        self.blocks = kept

    def _run(self, take: Callable, end: int, in_memory: bool | None = None) -> list:
        """Blocks from one end, a block's entries of them at most, or the first."""
        run, n = [], 0
        while self.blocks:
            block = self.blocks[end]
            here = isinstance(block[0], np.ndarray)
            size = len(block[0]) if here else block[1]
            if run and (n + size > self.disk.block or in_memory is not None and here is not in_memory):
                break
            run.append(take())
            n += size
        return run

    def _loaded(self, run: list) -> Block:
        self.disk.held -= sum(len(x[0]) for x in run if isinstance(x[0], np.ndarray))
        return _joined([x if isinstance(x[0], np.ndarray) else self.disk.take(x) for x in run])

    def drained(self) -> Iterator[Block]:
        """The entries in order, also those that come while it runs; each is forgotten."""
        while self.blocks:
            yield self._loaded(self._run(self.blocks.popleft, 0))

    def drained_back(self) -> Iterator[Block]:
        while self.blocks:
            run = self._run(self.blocks.pop, -1)
            yield tuple(c[::-1] for c in self._loaded(run[::-1]))

    def forget(self) -> None:
        for _ in self.drained():
            pass

    def shifted_back(self, first: int) -> Iterator[Block]:
        """(position, length) backwards, each with the length that was its follower's; the first with ``first``."""
        for pos, lcp in self.drained_back():
            yield pos, np.concatenate([np.array([first], np.uint8), lcp[:-1]])
            first = lcp[-1]


def _joined(blocks: list[Block]) -> Block:
    return blocks[0] if len(blocks) == 1 else tuple(np.concatenate(c) for c in zip(*blocks, strict=True))


def _ranges(n: int, step: int) -> Iterator[tuple[int, int]]:
    for i in range(0, n, step):
        yield i, min(n, i + step)


def _before(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The symbols before ``pos``; position 0 has none (any symbol)."""
    return np.asarray(text)[np.maximum(pos - 1, 0)].astype(np.int64)


def _grouped(key: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its places in order), keys ascending; keys are under ``top``."""
    order = np.argsort(key.astype(np.uint16) if top <= 1 << 16 else key, kind="stable")
    ordered = key[order]
    cuts = [0, *(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1).tolist(), len(ordered)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield int(ordered[i]), order[i:j]


def _range_of(edges: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Where symbols fall; ranges of one symbol each are the symbols."""
    return symbol if edges[-1] == len(edges) - 1 else np.searchsorted(edges, symbol, "right") - 1


def _stars(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Positions of the stars, ascending."""
    found, n = Log(disk), len(text)
    follower, small = -1, False  # first symbol and kind of what follows the block; the last suffix is left
    for i, j in [*_ranges(n, disk.block)][::-1]:
        t = np.append(np.asarray(text[i:j], np.int64), follower)
        m = j - i
        breaks = np.flatnonzero(t[1:] != t[:-1])
        run_end = np.searchsorted(breaks, np.arange(m))
        inside = run_end < len(breaks)
        at = breaks[np.minimum(run_end, len(breaks) - 1)] if len(breaks) else np.zeros(m, np.int64)
        s = np.where(inside, t[at] < t[at + 1], small) if len(breaks) else np.full(m, small)
        if i > 0:
            star = s & (np.asarray(text[i - 1 : j - 1], np.int64) > t[:-1])
        else:
            star = s & np.concatenate([[False], t[:-2] > t[1:-1]])
        follower, small = int(t[0]), bool(s[0])
        found.append(np.flatnonzero(star)[::-1] + i)
    return disk.stored((b[0] for b in found.drained_back()), np.int64)


def _edges(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Borders of ranges of symbols: every symbol, or ranges with a block of suffixes at most, or one symbol that has more."""
    top = max(int(text[i:j].max()) for i, j in _ranges(len(text), disk.block))
    if top < SYMBOL_QUEUES:
        return np.arange(top + 2)
    counts = disk.empty(top + 1, np.int64)
    for i, j in _ranges(len(text), disk.block):
        symbol, n = np.unique(text[i:j], return_counts=True)
        counts[symbol] += n
    edges, held = [0], 0  # held: suffixes from the last border on
    for i, j in _ranges(top + 1, disk.block):
        sums = np.concatenate([[0], np.cumsum(counts[i:j])])
        at = 0
        while held + sums[-1] - sums[at] > disk.block:
            k = int(np.searchsorted(sums, sums[at] + disk.block - held, "right")) - 1  # symbols i + at .. i + k - 1 still fit
            if i + k <= edges[-1]:
                k = edges[-1] + 1 - i
                if k > j - i:
                    break
            if i + k > edges[-1]:
                edges.append(i + k)
            at, held = k, 0
            if k == j - i:
                break
        held += int(sums[-1] - sums[at])
    if edges[-1] < top + 1:
        edges.append(top + 1)
    return np.array(edges)


def _settled(text: np.ndarray, pos: np.ndarray, key: np.ndarray, fixed: np.ndarray, low: int, high: int, sign: int) -> Block:
    """(position, key, whether fixed) of a range of symbols in the order in which they pass; a key is sign * symbol.

    ``pos`` are a queue's entries by arrival and then the fixed ones; what they induce inside the range is found first.
    An entry's place is by key, the queue's before the fixed, arrived before induced, and then by its inducer's
    place; sorted once more for each step of the longest chain of induced entries, all places are right.
    """
    parts, steps, level_start = [(pos, key, fixed, np.full(len(pos), -1))], 0, 0
    while len(pos):
        before = sign * _before(text, pos)
        up = np.flatnonzero((pos > 0) & (before >= low) & (before <= high) & np.where(fixed, before > key, before >= key))
        parent, level_start = level_start + up, level_start + len(pos)
        pos, key, fixed = pos[up] - 1, before[up], np.zeros(len(up), bool)
        parts.append((pos, key, fixed, parent))
        steps += 1
    pos, key, fixed, parent = _joined(parts)
    induced = parent >= 0
    tie = np.where(induced, 0, np.arange(len(pos)))
    place = np.empty(len(pos), np.int64)
    first = (((key - low) * 2 + fixed) * 2 + induced) * len(pos)  # no two entries have the same sum with their tie
    order = np.arange(len(pos))
    for _ in range(steps + 1):  # from one step to the next little changes, which a merging sort uses
        order = order[np.argsort((first + tie)[order], kind="stable")]
        place[order] = np.arange(len(pos))
        again = place[parent[induced]]
        if (tie[induced] == again).all():
            break
        tie[induced] = again
    return pos[order], key[order], fixed[order]


def _pass(text: np.ndarray, edges: np.ndarray, sign: int, queues: dict[int, Log], fixed: dict[int, Log], sink: Callable, disk: Disk) -> None:
    """One induction: sign 1 ascending, from stars to left suffixes; -1 descending, from left suffixes to the others.

    What passes in range b goes to sink(b, positions, symbols, whether fixed), in order.
    """

    def passed(b: int, pos: np.ndarray, symbol: np.ndarray, held: np.ndarray, settled: bool) -> None:
        sink(b, pos, symbol, held)
        before = _before(text, pos)
        later = np.where(held, sign * before > sign * symbol, sign * before >= sign * symbol) & (pos > 0)
        at = np.flatnonzero(later)
        up, before = pos[at] - 1, before[at]
        for bucket, some in _grouped(_range_of(edges, before), len(edges)):
            if not settled or bucket != b:  # what is induced inside a settled range has passed with it
                queues.setdefault(bucket, Log(disk)).append(up[some], before[some])

    for b in range(len(edges) - 1)[::sign]:
        logs = [queues.setdefault(b, Log(disk)), fixed.get(b, Log(disk))]
        if edges[b + 1] - edges[b] == 1:
            for held, log in zip((False, True), logs, strict=True):
                for pos, symbol in log.drained():
                    passed(b, pos, symbol, np.full(len(pos), held), False)
        else:
            found = [[*log.drained()] for log in logs]
            if found[0] or found[1]:
                pos, symbol = (np.concatenate(c) for c in zip(*found[0], *found[1], strict=True))
                held = np.arange(len(pos)) >= sum(len(x[0]) for x in found[0])
                low, high = sorted((sign * int(edges[b]), sign * (int(edges[b + 1]) - 1)))
                pos, key, held = _settled(text, pos, sign * symbol, held, low, high, sign)
                for i, j in _ranges(len(pos), disk.block):
                    passed(b, pos[i:j], sign * key[i:j], held[i:j], True)
        queues.pop(b, None)


def _by_range(blocks: Iterator[np.ndarray], text: np.ndarray, edges: np.ndarray, disk: Disk) -> dict[int, Log]:
    """Positions in a log for each range of their first symbols, in order of arrival."""
    out: dict[int, Log] = {}
    for pos in blocks:
        symbol = _before(text, pos + 1)
        for bucket, some in _grouped(_range_of(edges, symbol), len(edges)):
            out.setdefault(bucket, Log(disk)).append(pos[some], symbol[some])
    return out


def _induced(text: np.ndarray, edges: np.ndarray, stars: Iterator[np.ndarray], disk: Disk, stars_only: bool) -> Log:
    """All suffixes, or the stars among them, in descending order, from stars in an order of their first symbols."""
    left: dict[int, Log] = {}
    out = Log(disk)
    n = len(text)

    def to_left(b: int, pos: np.ndarray, symbol: np.ndarray, held: np.ndarray) -> None:
        if not held.all():
            left.setdefault(b, Log(disk)).append(pos[~held], symbol[~held])

    def to_out(b: int, pos: np.ndarray, symbol: np.ndarray, held: np.ndarray) -> None:
        if stars_only:  # a suffix that isn't left, after a larger symbol
            pos = pos[~held & (pos > 0) & (_before(text, pos) > symbol)]
        out.append(pos)

    last = int(np.searchsorted(edges, int(text[n - 1]), "right")) - 1
    queues = {last: Log(disk)}
    queues[last].append(np.array([n - 1]), np.array([int(text[n - 1])]))
    _pass(text, edges, 1, queues, _by_range(stars, text, edges, disk), to_left, disk)
    back = {}
    for b, log in left.items():
        back[b] = Log(disk)
        for block in log.drained_back():
            back[b].append(*block)
    _pass(text, edges, -1, {}, back, to_out, disk)
    return out


def _ends(star: np.ndarray, stars: np.ndarray, n: int) -> np.ndarray:
    """Where the substrings of some stars end: with the first symbol of the next star; the last one with the text."""
    at = np.searchsorted(stars, star) + 1
    return np.where(at < len(stars), np.asarray(stars[np.minimum(at, len(stars) - 1)]) + 1, n)


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b have in common, up to ``most``, by comparison."""
    out = most.copy()
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        same = _before(text, a[live] + k + 1) == _before(text, b[live] + k + 1)
        out[live[~same]] = k
        k += 1
        live = live[same]
        live = live[most[live] > k]
    return out


def _sorted_stars(text: np.ndarray, cap: int, disk: Disk) -> tuple[Callable[[], Iterator[np.ndarray]], int]:
    """(blocks of the stars in order, their number); stars that agree in cap symbols may stand in any order."""
    n = len(text)
    stars = _stars(text, disk)
    if len(stars) < 2:
        return lambda: iter([np.asarray(stars)]), len(stars)
    edges = _edges(text, disk)
    log = _induced(text, edges, (np.asarray(stars[i:j]) for i, j in _ranges(len(stars), disk.block)), disk, True)
    names, name, last = disk.empty(len(stars), np.int64), -1, None
    order_of_stars = Log(disk)
    for (pos,) in log.drained_back():
        order_of_stars.append(pos)
        chain = pos if last is None else np.concatenate([[last], pos])
        end = _ends(chain, stars, n)
        size = np.minimum(end - chain, cap)
        final = end == n  # it reaches the end of the text and has no equal, if it isn't longer than cap
        even = (size[1:] == size[:-1]) & (~(final[1:] | final[:-1]) | (size[1:] == cap))
        equal = np.zeros(len(even), bool)
        at = np.flatnonzero(even)
        equal[at] = _agree(text, chain[:-1][at], chain[1:][at], size[1:][at]) == size[1:][at]
        new = ~equal if last is not None else np.concatenate([[True], ~equal])
        number = name + new.cumsum()
        where = np.searchsorted(stars, pos)
        order = np.argsort(where)
        names[where[order]] = number[order]
        name, last = int(number[-1]), pos[-1]
    if name + 1 == len(stars):
        return lambda: (b[0] for b in order_of_stars.drained()), len(stars)
    order_of_stars.forget()
    ranked, _ = _order(names, cap // 2 + 2, disk)
    return lambda: (np.asarray(stars[by]) if not isinstance(stars, np.memmap) else _before(stars, by + 1) for by in ranked()), len(stars)


def _order(text: np.ndarray, cap: int, disk: Disk) -> tuple[Callable[[], Iterator[np.ndarray]], int]:
    """Blocks of all suffixes in order, those that agree in cap symbols in any order among themselves."""
    stars, _ = _sorted_stars(text, cap, disk)
    out = _induced(text, _edges(text, disk), stars(), disk, False)
    return lambda: (b[0] for b in out.drained_back()), len(text)


class _Passed:
    """The smallest common prefix since each symbol's last entry."""

    def __init__(self, symbols: int, cap: int) -> None:
        self.low, self.cap = np.zeros(symbols, np.uint8), cap

    def lengths(self, lcp: np.ndarray, targets: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Common prefixes of the entries of a block at ``places``, grouped by target in order; all of the block passes."""
        m = len(lcp)
        table = [lcp]
        while 2 << (len(table) - 1) <= m:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        low = np.minimum(self.low, lcp.min())
        if not len(places):
            self.low = low
            return lcp[:0]
        first = np.concatenate([[True], targets[1:] != targets[:-1]])
        start = np.where(first, 0, np.concatenate([[0], places[:-1] + 1]))
        level = np.frexp((places - start + 1).astype(np.float64))[1] - 1
        out = np.empty(len(places), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[k][start[at]], table[k][places[at] - (1 << int(k)) + 1])
        out[first] = np.minimum(out[first], self.low[targets[first]])
        end = np.flatnonzero(np.concatenate([first[1:], [True]]))
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(self.cap))
        low[targets[end]] = after[places[end] + 1]
        self.low = low
        return np.minimum(out.astype(np.int16) + 1, self.cap).astype(np.uint8)


def _with_lengths(text: np.ndarray, top: int, stars: dict[int, Log], cap: int, disk: Disk) -> Log:
    """(position, common prefix with the one passed before) of all suffixes, descending, from the sorted stars of each symbol."""
    queues = {c: Log(disk) for c in range(top)}
    left: dict[int, Log] = {}
    ends: dict[int, int] = {}  # the largest left suffix of each symbol
    out = Log(disk)

    def run(at: int) -> int:
        part = np.asarray(text[at : at + cap])
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def forward(passed: _Passed, pos: np.ndarray, lcp: np.ndarray, wanted: Callable) -> None:
        """Pass a block on: the suffixes before its own, where ``wanted`` says so, enter their queues."""
        before = _before(text, pos)
        ok = np.flatnonzero((pos > 0) & wanted(before))
        groups = [*_grouped(before[ok], top)]
        order = ok[np.concatenate([some for _, some in groups])] if groups else ok
        lengths = passed.lengths(lcp, before[order], order)
        up, at = pos[order] - 1, 0
        for symbol, some in groups:
            queues[symbol].append(up[at : at + len(some)], lengths[at : at + len(some)])
            at += len(some)

    def opened(blocks: Iterator[Block], first: int) -> Iterator[Block]:
        """The blocks, their very first length replaced."""
        for pos, lcp in blocks:
            if first is not None:
                lcp, first = np.concatenate([np.array([first], np.uint8), lcp[1:]]), None
            yield pos, lcp

    passed = _Passed(top, cap)
    queues[int(text[-1])].append(np.array([len(text) - 1]), np.zeros(1, np.uint8))
    for c in range(top):
        for pos, lcp in opened(queues[c].drained(), 0):
            left.setdefault(c, Log(disk)).append(pos, lcp)
            ends[c] = int(pos[-1])
            forward(passed, pos, lcp, lambda before, c=c: before >= c)
        if c in stars:
            blocks = stars[c].drained()
            head = next(blocks)
            seam = min(run(ends[c]), run(int(head[0][0]))) if c in ends else 0
            for pos, lcp in opened((b for part in ([head], blocks) for b in part), seam):
                forward(passed, pos, lcp, lambda before, c=c: before > c)
    passed = _Passed(top, cap)
    for c in range(top)[::-1]:
        least = None
        for pos, lcp in opened(queues[c].drained(), 0):
            out.append(pos, lcp)
            least = int(pos[-1])
            forward(passed, pos, lcp, lambda before, c=c: before <= c)
        if c in left:
            seam = min(run(ends[c]), run(least)) if least is not None else 0
            for pos, lcp in left[c].shifted_back(seam):
                out.append(pos, lcp)
                forward(passed, pos, lcp, lambda before, c=c: before < c)
            left.pop(c)
    return out


def sorted_suffixes(text: np.ndarray, cap: int, disk: Disk) -> Iterator[Block]:
    """Suffixes of ``text`` (symbols from 0 to 1,023) in order, in blocks, and the common prefix of each with the one before, up to cap.

    cap is 250 at most. Suffixes that agree in cap symbols may stand in any order among themselves.
    """
    if not len(text):
        return
    top = max(int(text[i:j].max()) for i, j in _ranges(len(text), disk.block)) + 1
    stars, _ = _sorted_stars(text, cap, disk)
    logs: dict[int, Log] = {}
    last = None
    for pos in stars():
        if not len(pos):
            continue
        chain = pos if last is None else np.concatenate([[last], pos])
        most = np.minimum(len(text) - np.maximum(chain[:-1], chain[1:]), cap)
        lcp = _agree(text, chain[:-1], chain[1:], most)
        if last is None:
            lcp = np.concatenate([[0], lcp])
        symbol = _before(text, pos + 1)
        for c, some in _grouped(symbol, top):
            logs.setdefault(c, Log(disk)).append(pos[some], lcp[some].astype(np.uint8))
        last = pos[-1]
    out = _with_lengths(text, top, logs, cap, disk)
    yield from out.shifted_back(0)


def suffix_array(text: np.ndarray, cap: int, memory_entries: int = MEMORY_ENTRIES) -> Block:
    """sorted_suffixes() as two arrays."""
    parts = [*sorted_suffixes(text, cap, Disk(memory_entries))]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
