"""Words of running text, without case and ASCII punctuation, and fast hash look-ups."""

from __future__ import annotations

import numpy as np

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TABLE_BITS = 22


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters that are neither letter nor digit separate them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


class HashSet:
    """A fixed set of 64-bit hashes that arrays are tested against."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.sorted >> np.uint64(64 - _TABLE_BITS)] = True

    def where(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of ``hashes`` that are in the set."""
        maybe = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        if not len(maybe):
            return maybe
        found = hashes[maybe]
        at = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
        return maybe[self.sorted[at] == found]
