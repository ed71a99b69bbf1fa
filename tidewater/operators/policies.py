"""Eviction policies as state machines: what a replay task holds for one cache instance."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd

REPLAY_SCHEMA = "instance string, policy string, accesses bigint, hits bigint"
#: The sketch's row seeds and the hash's prime.
SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
PRIME = 0x01000193


class Fifo:
    """The oldest insertion goes; a hit changes nothing."""

    touch = False

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("capacity must be 1 or more")
        self.capacity, self.held = capacity, OrderedDict()

    def access(self, key: str) -> bool:
        if key in self.held:
            if self.touch:
                self.held.move_to_end(key)
            return True
        self.held[key] = True
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return False


class Lru(Fifo):
    """As Fifo, but a hit counts as a new insertion."""

    touch = True


class Lfu:
    """The least used goes, of those the oldest insertion. Only hits count, from 1 on; what goes is forgotten; all are admitted.

    The heap has one entry for each key, with a count that may be out of date, but never too high: a first entry that is out of
    date goes back with its count of now.
    """

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("capacity must be 1 or more")
        self.capacity, self.count, self.heap, self.clock = capacity, {}, [], 0

    def access(self, key: str) -> bool:
        if key in self.count:
            self.count[key] += 1
            return True
        while len(self.count) >= self.capacity:
            uses, born, first = self.heap[0]
            if uses == self.count[first]:
                heapq.heappop(self.heap)
                del self.count[first]
            else:
                heapq.heapreplace(self.heap, (self.count[first], born, first))
        self.clock += 1
        self.count[key] = 1
        heapq.heappush(self.heap, (1, self.clock, key))
        return False


class Sketch:
    """Counts in fixed memory: the least of four hashed counters; after ``sample`` additions all are halved."""

    def __init__(self, width: int, sample: int) -> None:
        self.width, self.sample, self.added = width, sample, 0
        self.rows = np.zeros((len(SEEDS), width), np.int64)
        self.known: dict[str, list[int]] = {}

    def places(self, key: str) -> list[int]:
        found = self.known.get(key)
        if found is None:
            found = []
            for seed in SEEDS:
                h = seed
                for c in key:
                    h = ((h ^ ord(c)) * PRIME) & 0xFFFFFFFF
                found.append(h % self.width)
            if len(self.known) < 100_000:
                self.known[key] = found
        return found

    def add(self, key: str) -> None:
        for r, at in enumerate(self.places(key)):
            self.rows[r, at] += 1
        self.added += 1
        if self.added >= self.sample:
            self.rows >>= 1
            self.added >>= 1

    def estimate(self, key: str) -> int:
        return min(int(self.rows[r, at]) for r, at in enumerate(self.places(key)))


class TinyLfu:
    """A recency window of a tenth in front of an LRU main part. What the window drops enters a full main part only if the
    sketch has seen it more often than the main part's own next victim."""

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("capacity must be 1 or more")
        self.window, self.main = OrderedDict(), OrderedDict()
        self.front = max(1, int(capacity * 0.1 + 0.5))
        self.rest = capacity - self.front
        self.sketch = Sketch(128, 32 * capacity)

    def access(self, key: str) -> bool:
        self.sketch.add(key)
        for part in (self.window, self.main):
            if key in part:
                part.move_to_end(key)
                return True
        self.window[key] = True
        if len(self.window) > self.front:
            self._admit(self.window.popitem(last=False)[0])
        return False

    def _admit(self, candidate: str) -> None:
        if len(self.main) >= self.rest:
            if not self.main:
                return
            victim = next(iter(self.main))
            if self.sketch.estimate(candidate) <= self.sketch.estimate(victim):
                return
            del self.main[victim]
        self.main[candidate] = True


POLICIES = {"fifo": Fifo, "lru": Lru, "lfu": Lfu, "w-tinylfu": TinyLfu}


def replay_batches(batches: Iterator[pd.DataFrame], capacity: int, names: list[str]) -> Iterator[pd.DataFrame]:
    """Of batches sorted by instance and seq: a row for each instance and policy. One instance's caches are held at a time."""
    at, caches, accesses, hits = None, [], 0, []

    def result() -> pd.DataFrame:
        rows = [(at, name, accesses, n) for name, n in zip(names, hits, strict=True)] if at is not None else []
        return pd.DataFrame(rows, columns=["instance", "policy", "accesses", "hits"])

    for frame in batches:
        for instance, key, counts in zip(frame["instance"], frame["key"], frame["counts"], strict=True):
            if instance != at:
                yield result()
                at, caches, accesses, hits = instance, [POLICIES[n](capacity) for n in names], 0, [0] * len(names)
            accesses += counts
            for i, cache in enumerate(caches):
                hits[i] += cache.access(key) and counts
    yield result()
