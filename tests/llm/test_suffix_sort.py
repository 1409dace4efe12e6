import numpy as np
import pytest

from quillcount.llm import suffix_sort
from quillcount.llm.suffix_sort import suffix_array


def brute(text):
    t = text.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("memory", [1 << 20, 64, 7])
@pytest.mark.parametrize("symbols", [1, 2, 3, 26, 500])
def test_random(symbols, memory):
    rng = np.random.default_rng(symbols)
    for n in (1, 2, 3, 10, 60, 300):
        for _ in range(12 if n < 300 else 3):
            text = rng.integers(0, symbols, n)
            if n > 20 and rng.random() < 0.5:
                text[n // 2 : n // 2 + n // 3] = text[: n // 3]
            pos, lcp = suffix_array(text, 250, memory)
            order, want = brute(text)
            assert pos.tolist() == order
            assert lcp[1:].tolist() == np.minimum(want[1:], 250).tolist()


def test_capped():
    """With a cap, groups of suffixes that agree in cap symbols are those of brute force."""
    rng = np.random.default_rng(9)
    piece = rng.integers(0, 4, 90)
    text = np.concatenate([np.append(np.roll(piece, s)[: 80 - s], 9) for s in range(0, 40, 3)] * 2)
    pos, lcp = suffix_array(text, 20, 1 << 20)
    group = (lcp < 20).cumsum()
    got = {}
    for p, g in zip(pos.tolist(), group.tolist(), strict=True):
        if p + 20 <= len(text):
            got.setdefault(g, set()).add(p)
    want = {}
    for p in range(len(text) - 19):
        want.setdefault(tuple(text[p : p + 20].tolist()), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_text_far_larger_than_memory():
    """Sorted in a sixteenth of its entries, at every level of the recursion; all the rest is on disk."""
    rng = np.random.default_rng(2)
    words = [rng.integers(97, 123, n) for n in rng.integers(2, 9, 300)]
    text = np.concatenate([np.append(words[i], 32) for i in rng.integers(0, 300, 9000)]).astype(np.uint16)
    text[20_000:26_000] = text[4_000:10_000]
    limit = len(text) // 16
    disk = suffix_sort.Disk(limit)
    parts = [*suffix_sort.sorted_suffixes(text, 100, disk)]
    assert disk.most <= limit and disk.spilled > len(text) and all(len(p) <= limit // 4 for p, _ in parts)
    pos, lcp = (np.concatenate(c) for c in zip(*parts, strict=True))
    raw = bytes(text.astype(np.uint8))
    assert sorted(pos.tolist()) == list(range(len(text)))
    heads = [raw[p : p + 100] for p in pos.tolist()]
    assert all(a <= b for a, b in zip(heads, heads[1:], strict=False))
    for k in range(1, len(heads), 7):
        same = next((i for i, (x, y) in enumerate(zip(heads[k - 1], heads[k], strict=False)) if x != y), min(len(heads[k - 1]), len(heads[k])))
        assert lcp[k] == same
