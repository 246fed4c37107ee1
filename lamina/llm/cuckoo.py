"""A cuckoo filter of 16-bit fingerprints, four to a bucket, for keys that are 64-bit hashes."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
LOAD = 0.9


class CuckooFilter:
    """Approximate membership with deletion: a key that was inserted is always found.

    Keys that find no place after KICKS moves go to an exact stash, so an insertion never fails; a filter
    that is sized by capacity() hardly uses it.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[int] | None = None):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.stash = stash or []

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, int(np.ceil(keys / LOAD / SLOTS)))
        return cls(1 << (need - 1).bit_length())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        marks = (keys >> np.uint64(48)) % np.uint64(65_535) + np.uint64(1)
        first = keys & np.uint64(self.buckets - 1)
        return marks.astype(np.uint16), first.astype(np.int64), (first ^ self._jump(marks)).astype(np.int64)

    def _jump(self, marks):
        return (np.asarray(marks, np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)

    def insert(self, keys: np.ndarray) -> None:
        """Keys go to the first free slot of their two buckets, all at once; those that find none move others, one by one."""
        keys = np.asarray(keys, np.int64)
        marks, one, two = self._places(keys)
        rest = np.arange(len(keys))
        for at in (one, two):
            order = rest[np.argsort(at[rest], kind="stable")]
            bucket = at[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
            turn = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            used = self.table[bucket] != 0
            fits = turn < SLOTS - used.sum(axis=1)
            slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), turn[fits]]
            self.table[bucket[fits], slot] = marks[order[fits]]
            rest = order[~fits]
        rng = np.random.default_rng(len(keys))
        for key, mark, at in zip(keys[rest].tolist(), marks[rest].tolist(), two[rest].tolist()):
            self._push(key, mark, at, rng)

    def _push(self, key: int, mark: int, at: int, rng: np.random.Generator) -> None:
        """Put a mark into a full bucket: what it displaces goes to its other one, and so on."""
        table, moved = self.table, []
        for _ in range(KICKS):
            slot = int(rng.integers(SLOTS))
            moved.append((at, slot, int(table[at, slot])))
            mark, table[at, slot] = int(table[at, slot]), mark
            at ^= int(self._jump(mark))
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return
        for where, slot, mark in reversed(moved):
            table[where, slot] = mark
        self.stash.append(key)

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before; of a key that wasn't, another's mark may go."""
        keys = np.asarray(keys, np.int64)
        for key, mark, one, two in zip(keys.tolist(), *(x.tolist() for x in self._places(keys))):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for at in (one, two):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, one, two = self._places(keys)
        found = (self.table[one] == marks[:, None]).any(axis=1) | (self.table[two] == marks[:, None]).any(axis=1)
        return found | np.isin(keys, self.stash) if self.stash else found

    def to_bytes(self) -> bytes:
        head = np.array([self.buckets, len(self.stash), *self.stash], np.int64)
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, stashed = np.frombuffer(data, np.int64, 2).tolist()
        stash = np.frombuffer(data, np.int64, stashed, 16).tolist()
        table = np.frombuffer(data, np.uint16, -1, 16 + 8 * stashed).reshape(buckets, SLOTS).copy()
        return cls(buckets, table, stash)
