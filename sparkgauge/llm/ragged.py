"""Ragged numpy arrays: a flat array and the lengths of its rows."""

from __future__ import annotations

import numpy as np


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each row begins; one more entry holds the total."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The rows ``flat[s:s + n]``, one after the other."""
    out = starts_of(lengths)
    kind = np.int32 if max(out[-1], len(flat)) < 2**31 else np.int64
    at = np.arange(out[-1], dtype=kind)
    at += np.repeat((starts - out[:-1]).astype(kind), lengths)
    return flat[at]


def text_groups(sizes: np.ndarray, most: int):
    """Slices of consecutive rows whose sizes add up to about ``most``; a longer row stands alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))
