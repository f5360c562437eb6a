"""Anchored windows: which windows of a text could also stand elsewhere, found from a few of its positions.

A window of ``width`` units (bytes or words) is assigned to an anchor: the run of ``size`` units inside it whose hash is
lowest, the leftmost of equals. The choice depends on the window alone, so equal windows have equal anchors in equal
places. Neighbouring windows mostly share their anchor, and all windows of one anchor form a stretch of text; a text
has about ``2 / (width - size + 2)`` stretches a unit.
"""

from __future__ import annotations

import numpy as np

from .text import mix, noise

#: Base of the rolling sums and its inverse modulo 2**64.
BASE = int(noise(1, 51)[0]) | 5
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n - 1, kept between calls."""
    for k, base in enumerate((BASE, INVERSE)):
        while len(_POWERS[k]) < n:
            known = _POWERS[k]
            _POWERS[k] = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any runs of units, from sums over all units before."""

    def __init__(self, units: np.ndarray) -> None:
        self.up, self.down = _powers(len(units) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * self.up[:-1])])

    def fixed(self, size: int) -> np.ndarray:
        """Hash of the run of ``size`` units at each place that has one."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each run from start to end; runs of different lengths differ too."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def anchored_windows(grams: np.ndarray, doc: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each stretch, in order.

    ``grams`` has the hash of the run of ``size`` units at each place, ``doc`` the text of each unit; a window lies in
    one text.
    """
    count = len(doc) - width + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, wanted = 1, width - size + 1
    while 2 * reach <= wanted:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if reach < wanted:
        low = np.minimum(low[: reach - wanted], low[wanted - reach :])
    window = np.flatnonzero(doc[:count] == doc[width - 1 :])
    owner = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(owner[1:] != owner[:-1]) + 1 if len(owner) else np.zeros(0, np.int64)
    first, last = np.concatenate([[0], turn]).astype(np.int64), np.concatenate([turn - 1, [len(owner) - 1]]).astype(np.int64)
    return (owner[first], window[first], window[last]) if len(owner) else (np.zeros(0, np.int64),) * 3
