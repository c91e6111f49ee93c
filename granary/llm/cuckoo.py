"""Cuckoo filters on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Keys of one shard's filter.
SHARD_KEYS = 1 << 16
_SLOTS = 4


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four slots a bucket; holds repeats, allows deletion."""

    def __init__(self, capacity: int = 0, blob: bytes | None = None):
        if blob is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.8)))))
            self.table = np.zeros((buckets, _SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS).copy()

    def blob(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (keys & mask).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket, prints):
        return bucket ^ ((np.asarray(prints, np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Doubles by reinsertion are left to the caller: raises OverflowError when it is full."""
        prints, one, two = self._places(keys)
        rest = np.arange(len(prints))
        for bucket in (one, two):  # whole rounds first, then one by one
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            b = bucket[rest]
            rank = np.arange(len(b)) - np.searchsorted(b, b)
            free = self.table[b] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(b)), np.minimum(rank, _SLOTS - 1)]
            self.table[b[fits], slot[fits]] = prints[rest[fits]]
            rest = rest[~fits]
        rng = np.random.RandomState(len(keys))
        for i in rest:
            p, b = prints[i], int(one[i])
            for _ in range(500):
                empty = np.flatnonzero(self.table[b] == 0)
                if len(empty):
                    self.table[b, empty[0]] = p
                    break
                s = rng.randint(_SLOTS)
                p, self.table[b, s] = self.table[b, s], p
                b = int(self._other(b, p))
            else:
                raise OverflowError("cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        prints, one, two = self._places(keys)
        for p, *both in zip(prints, one, two, strict=True):
            for b in both:
                at = np.flatnonzero(self.table[b] == p)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def filled(keys: np.ndarray, room: int = 0) -> Cuckoo:
    """A filter with these keys, of the smallest size that takes them and room for so many more."""
    capacity = max(4, len(keys) + room)
    while True:
        try:
            out = Cuckoo(capacity)
            out.insert(keys)
            return out
        except OverflowError:
            capacity *= 2
