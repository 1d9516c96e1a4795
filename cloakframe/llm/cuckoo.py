"""A cuckoo filter over 64-bit keys, with deletion, for one shard of an index."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold, twice."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIX
        x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; grows by rebuilding from its owner's exact keys.

    ``insert`` returns False when the table is too full: the owner then builds a
    larger one from its exact table, so no key is ever lost.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * 0.8)))))
        while True:
            made = cls(buckets)
            if made.insert_all(keys):
                return made
            buckets *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(slots), slots)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(keys.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, first ^ self.jump(prints)

    def jump(self, prints: np.ndarray) -> np.ndarray:
        return (mixed(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(keys)
        wanted = prints[:, None]
        return ((self.slots[first] == wanted) | (self.slots[second] == wanted)).any(axis=1)

    def insert_all(self, keys: np.ndarray) -> bool:
        prints, first, second = self.places(keys)
        # Whole rounds at once: each bucket takes as many new prints as it has free slots.
        waiting = np.arange(len(keys))
        for at in (first, second):
            order = waiting[np.argsort(at[waiting], kind="stable")]
            bucket = at[order]
            starts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1] if len(bucket) else np.zeros(0, np.int64)
            rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
            used = (self.slots[bucket] != 0).sum(axis=1)
            fits = rank + used < SLOTS
            self.slots[bucket[fits], (rank + used)[fits]] = prints[order[fits]]
            waiting = order[~fits]
        return all(self.insert(int(prints[i]), int(second[i])) for i in waiting)

    def insert(self, fingerprint: int, bucket: int) -> bool:
        """Place one fingerprint, moving others to their other bucket where it is full."""
        moved = []
        for turn in range(500):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fingerprint
                return True
            slot = (turn * 7 + bucket) % SLOTS
            moved.append((bucket, slot, int(row[slot])))
            row[slot], fingerprint = fingerprint, int(row[slot])
            bucket ^= int(self.jump(np.array([fingerprint], np.uint16))[0])
        for at, slot, old in reversed(moved):
            self.slots[at, slot] = old
        return False

    def add(self, keys: np.ndarray) -> bool:
        """Insert keys, each once; False, with nothing kept of the last one, when the table is full."""
        return self.insert_all(keys)

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted."""
        prints, first, second = self.places(keys)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.slots[bucket] == p)
                if len(found):
                    # Filled slots stay in front, as insert_all expects.
                    last = np.flatnonzero(self.slots[bucket])[-1]
                    self.slots[bucket, found[0]] = self.slots[bucket, last]
                    self.slots[bucket, last] = 0
                    break
