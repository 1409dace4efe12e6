"""Content-defined anchors: positions that every occurrence of a long enough string has at the same place.

The anchor of a window of ``window`` bytes is its leftmost ``gram``-byte string with the smallest hash. As it
depends on the bytes of the window alone, two equal windows have their anchors at the same offset.
"""

from __future__ import annotations

import numpy as np

from . import scan


def anchors(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, hash): anchors of the windows inside the rows of ``off``, the range of window starts that
    each stands for, and the hash of its gram; positions are those in ``data``."""
    n, wide = len(data), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    prefix = scan.prefix_hash(data)
    places = np.arange(n - gram + 1)
    grams = scan.range_hash(prefix, places, places + gram)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(at))
    row_end = np.repeat(off[1:], np.diff(off))[: len(at)]
    inside = np.flatnonzero(starts + window <= row_end)
    if not len(inside):
        return none, none, none, none.astype(np.uint64)
    found = at[inside]
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(found)]]) - 1
    return found[new], inside[new], inside[last], grams[found[new]]
