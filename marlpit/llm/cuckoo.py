"""A cuckoo filter whose insertions, lookups and deletions take whole arrays of 128-bit keys."""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.84
ROUNDS = 400


class CuckooFull(Exception):
    """The table has no room for all keys; rebuild it larger from the exact keys."""


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot. A key may stand in either of two buckets. No false negatives for
    keys that were inserted (each once) and not deleted."""

    def __init__(self, capacity: int = 0, table: bytes | None = None):
        if table is not None:
            self.table = np.frombuffer(table, dtype=np.uint16).reshape(-1, SLOTS).copy()
        else:
            buckets = 1
            while buckets * SLOTS * LOAD < max(capacity, 1):
                buckets *= 2
            self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @property
    def capacity(self) -> int:
        return int(len(self.table) * SLOTS * LOAD)

    def __len__(self) -> int:
        return int((self.table != 0).sum())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return np.where(prints == 0, 1, prints).astype(np.uint16), (keys[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)
        return bucket ^ step.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one = self._places(keys)
        two = self._other(one, prints)
        return (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Insert distinct keys; raises CuckooFull, and then holds an undefined part of them."""
        prints, bucket = self._places(keys)
        seed = 0
        for turn in range(ROUNDS):
            prints, bucket = self._settle(prints, bucket)
            if not len(prints):
                return
            if turn == 0:
                bucket = self._other(bucket, prints)
                prints, bucket = self._settle(prints, bucket)
                if not len(prints):
                    return
            # one key of each full bucket takes the place of another, which goes to its other bucket
            _, first = np.unique(bucket, return_index=True)
            seed = (seed * 1103515245 + 12345) % (1 << 31)
            slot = (first + seed) % SLOTS
            gone = self.table[bucket[first], slot].copy()
            self.table[bucket[first], slot] = prints[first]
            prints, bucket = prints.copy(), bucket.copy()
            prints[first] = gone
            bucket[first] = self._other(bucket[first], gone)
        raise CuckooFull

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put keys into free slots of their buckets; what is left over."""
        order = np.argsort(bucket, kind="stable")
        prints, bucket = prints[order], bucket[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, dtype=np.int64)
        nth = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
        free = (self.table == 0).sum(axis=1)[bucket]
        fits = nth < free
        slots = np.argsort(self.table[bucket[fits]] != 0, axis=1, kind="stable")[np.arange(int(fits.sum())), nth[fits]]
        self.table[bucket[fits], slots] = prints[fits]
        return prints[~fits], bucket[~fits]

    def delete(self, keys: np.ndarray) -> None:
        """Delete keys, each of which was inserted once."""
        prints, one = self._places(keys)
        two = self._other(one, prints)
        for p, *buckets in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for b in buckets:
                at = np.flatnonzero(self.table[b] == p)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def filter_of(keys: np.ndarray, spare: float = 1.0) -> CuckooFilter:
    """A filter of distinct keys with room for spare times as many; grows until all fit."""
    room = max(16, int(len(keys) * spare))
    while True:
        made = CuckooFilter(room)
        try:
            made.insert(keys)
            return made
        except CuckooFull:
            room = made.capacity * 2
