"""Cuckoo filters over 64-bit hashes, with batched inserts, deletions and lookups."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Share of the slots that are filled when a filter is laid out.
LOAD = 0.8
#: Rounds of evictions after which a filter counts as full.
ROUNDS = 200


def buckets_for(keys: int) -> int:
    """A power of two of buckets that holds so many keys."""
    return 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


def print_of(h: np.ndarray) -> np.ndarray:
    """16-bit fingerprints; zero marks an empty slot and is never one."""
    fp = (h & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(fp == 0, np.uint16(1), fp)


def jump(fp: np.ndarray) -> np.ndarray:
    """What separates the two buckets of a fingerprint, before the mask."""
    x = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def rank_in_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal values."""
    starts = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_keys))))


class CuckooFilter:
    """A table of n x 4 fingerprints, n a power of two. Every hash has two buckets, each told from the other."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def empty(cls, buckets: int) -> CuckooFilter:
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, h: np.ndarray, spare: int = 0) -> CuckooFilter:
        """A filter that holds ``h``; it is doubled until all find a place."""
        buckets = buckets_for(len(h) + spare)
        while True:
            made = cls.empty(buckets)
            if made.insert(h):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (jump(fp) & self.mask)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return print_of(h), (h >> np.uint64(16)) & self.mask

    def _settle(self, fp: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put fingerprints into free slots of their buckets; what finds none comes back."""
        order = np.argsort(bucket, kind="stable")
        fp, bucket = fp[order], bucket[order]
        free = self.table[bucket] == 0
        wanted = free & (free.cumsum(axis=1) == (rank_in_runs(bucket) + 1)[:, None])
        placed = wanted.any(axis=1)
        self.table[bucket[placed], wanted[placed].argmax(axis=1)] = fp[placed]
        return fp[~placed], bucket[~placed]

    def insert(self, h: np.ndarray) -> bool:
        """Add every hash, repeats included. False if the filter is full; it must then be made anew from its keys."""
        fp, bucket = self._settle(*self.places(h))
        fp, bucket = self._settle(fp, self.other(fp, bucket))
        for turn in range(ROUNDS):
            if not len(fp):
                return True
            # of the fingerprints that wait at a bucket, one takes the slot of another, which moves to its other bucket
            at, first = np.unique(bucket, return_index=True)
            slot = (fp[first].astype(np.int64) + turn) % SLOTS
            evicted = self.table[at, slot].copy()
            self.table[at, slot] = fp[first]
            waiting = np.delete(np.arange(len(fp)), first)
            fp, bucket = np.append(fp[waiting], evicted), np.append(bucket[waiting], self.other(evicted, at))
            fp, bucket = self._settle(fp, bucket)
        return not len(fp)

    def delete(self, h: np.ndarray) -> None:
        """Take every hash out once; all of them must be in the filter."""
        fp, bucket = self.places(h)
        for _ in range(2):
            order = np.lexsort((fp, bucket))
            fp, bucket = fp[order], bucket[order]
            held = self.table[bucket] == fp[:, None]
            rank = rank_in_runs(bucket * np.uint64(1 << 16) + fp.astype(np.uint64)) if len(fp) else np.empty(0, dtype=np.int64)
            wanted = held & (held.cumsum(axis=1) == (rank + 1)[:, None])
            found = wanted.any(axis=1)
            self.table[bucket[found], wanted[found].argmax(axis=1)] = 0
            fp, bucket = fp[~found], bucket[~found]
            bucket = self.other(fp, bucket)
        if len(fp):
            raise ValueError("a hash to delete is not in the filter")

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, bucket = self.places(h)
        return ((self.table[bucket] == fp[:, None]) | (self.table[self.other(fp, bucket)] == fp[:, None])).any(axis=1)


class Shards:
    """Lookups in many filters at once; a hash goes to the filter of its shard."""

    def __init__(self, filters: dict[int, bytes], shards: int):
        sizes = np.zeros(shards, dtype=np.int64)
        for shard, data in filters.items():
            sizes[shard] = len(data) // (2 * SLOTS)
        self.start = (np.cumsum(sizes) - sizes).astype(np.uint64)
        self.mask = np.where(sizes > 0, sizes - 1, 0).astype(np.uint64)
        self.known = sizes > 0
        # one empty bucket stands at the end for shards without a filter
        joined = b"".join(filters[s] for s in sorted(filters)) + bytes(2 * SLOTS)
        self.table = np.frombuffer(joined, dtype=np.uint16).reshape(-1, SLOTS)
        self.start[~self.known] = len(self.table) - 1

    def contains(self, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
        fp, mask, start = print_of(h), self.mask[shard], self.start[shard]
        first = (h >> np.uint64(16)) & mask
        second = first ^ (jump(fp) & mask)
        return ((self.table[start + first] == fp[:, None]) | (self.table[start + second] == fp[:, None])).any(axis=1)
