"""Hashes of words, of runs of words, and winnowed anchors, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

_FINAL = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` neighbours, by doubling; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    whole, length, run, width, rest = None, 0, hashes, 1, k
    while True:
        if rest & 1:
            if whole is None:
                whole, length = run, width
            else:
                m = len(hashes) - length - width + 1
                whole = whole[:m] * np.uint64(pow(base, width, 1 << 64)) + run[length : length + m]
                length += width
        rest >>= 1
        if not rest:
            break
        run = run[:-width] * np.uint64(pow(base, width, 1 << 64)) + run[width:]
        width *= 2
    whole = (whole ^ (whole >> np.uint64(31))) * _FINAL
    return whole ^ (whole >> np.uint64(29))


def anchor_of_windows(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window of ``window`` words, where its smallest run of ``k`` words starts (the first of equals).

    The choice depends on the window's words alone, so equal windows choose alike.
    """
    if len(hashes) < window:
        return np.empty(0, np.int64)
    runs = run_hashes(hashes, k, 0x2545F4914F6CDD1D)
    view = np.lib.stride_tricks.sliding_window_view(runs, window - k + 1)
    out = np.empty(len(view), np.int64)
    for start in range(0, len(view), 1 << 16):
        part = view[start : start + (1 << 16)]
        out[start : start + len(part)] = part.argmin(axis=1)
    return out + np.arange(len(view))
