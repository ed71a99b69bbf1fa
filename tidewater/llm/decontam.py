"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words, lower-cased and cut at everything but letters and digits, make one automaton of
all their word runs. A document's words are streamed through it: after each word the state stands
for the longest run that ends there and occurs in some item. Runs of ``width`` words or more, and
whole items that are shorter, mark their words as hit. As a first sieve, a run of two words or more
can only lie where neighbouring words are neighbours in some item; only such stretches are streamed.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .columns import quoted
from .store import stored

WIDTH = 10
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,runs:array<struct<start:int,end:int,from_byte:bigint,to_byte:bigint>>>"


class _Build:
    """The automaton while it grows. Most states lead on by one word only, so a state's first word lies in flat arrays and
    only the further ones in a dict."""

    def __init__(self) -> None:
        self.word, self.next, self.up, self.size = array("Q", [0]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}

    def get(self, state: int, word: int) -> int:
        """The state behind ``word``, or -1."""
        if self.next[state] >= 0 and self.word[state] == word:
            return self.next[state]
        return self.more[state].get(word, -1) if state in self.more else -1

    def put(self, state: int, word: int, to: int) -> None:
        if self.next[state] < 0 or self.word[state] == word:
            self.word[state], self.next[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def state(self, up: int, size: int, like: int = -1) -> int:
        self.word.append(self.word[like] if like >= 0 else 0)
        self.next.append(self.next[like] if like >= 0 else -1)
        self.up.append(up)
        self.size.append(size)
        new = len(self.up) - 1
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def split(self, parent: int, word: int, child: int) -> int:
        """A copy of child for the runs that come through parent, which are shorter than child's longest."""
        twin = self.state(self.up[child], self.size[parent] + 1, child)
        self.up[child] = twin
        while parent >= 0 and self.get(parent, word) == child:
            self.put(parent, word, twin)
            parent = self.up[parent]
        return twin

    def extend(self, last: int, word: int) -> int:
        known = self.get(last, word)
        if known >= 0:
            return known if self.size[known] == self.size[last] + 1 else self.split(last, word, known)
        new, at = self.state(0, self.size[last] + 1), last
        while at >= 0 and (child := self.get(at, word)) < 0:
            self.put(at, word, new)
            at = self.up[at]
        if at >= 0:
            self.up[new] = child if self.size[child] == self.size[at] + 1 else self.split(at, word, child)
        return new


def _lists(pairs: list[tuple[int, int]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """(state, value) pairs as values by state, without repeats, and where each state's begin."""
    flat = np.unique(np.array(pairs, np.int32).reshape(-1, 2), axis=0)
    return np.searchsorted(flat[:, 0], np.arange(states + 1)).astype(np.int32), np.ascontiguousarray(flat[:, 1])


@dataclass
class Automaton:
    """All word runs of some items, in flat arrays: about 60 bytes a word of the items, on the driver and in each worker.

    Steps of state s: words[first[s]:first[s + 1]] ascending, and states ``to`` behind them. up: suffix link; size: longest
    run; base: the state of its last ``width`` words; owned: items (indices into ``names``) with a window that is reached
    in s. Items shorter than a window end in states of ``short``; hop: the nearest of those on the way of suffix links.
    """

    width: int
    names: list[str]
    first: np.ndarray
    words: np.ndarray
    to: np.ndarray
    up: np.ndarray
    size: np.ndarray
    base: np.ndarray
    hop: np.ndarray
    own_first: np.ndarray
    owned: np.ndarray
    short: dict[int, tuple[tuple[int, tuple[int, ...]], ...]]
    pairs: np.ndarray
    singles: np.ndarray
    shortest: int

    @classmethod
    def build(cls, items: Iterable[tuple[str, str | None]], width: int = WIDTH) -> Automaton:
        b, runs = _Build(), []
        for item, text in items:
            h = hashes(text)
            if len(h):
                runs.append((item, h))
        names = sorted({item for item, _ in runs})
        number = {item: k for k, item in enumerate(names)}
        for _, h in runs:
            last = 0
            for word in h.tolist():
                last = b.extend(last, word)
        states = len(b.up)
        up, size = np.frombuffer(b.up, np.int32).copy(), np.frombuffer(b.size, np.int32).copy()
        one = np.flatnonzero(np.frombuffer(b.next, np.int32) >= 0)
        state = np.concatenate([one, np.array([s for s, more in b.more.items() for _ in more], np.int64)])
        words = np.concatenate([np.frombuffer(b.word, K.U64)[one], np.array([w for more in b.more.values() for w in more], K.U64)])
        to = np.concatenate([np.frombuffer(b.next, np.int32)[one], np.array([t for more in b.more.values() for t in more.values()], np.int32)])
        order = np.lexsort((words, state))
        del b
        words, to = words[order], to[order]
        first = np.searchsorted(state[order], np.arange(states + 1)).astype(np.int32)
        a = cls(width, names, first, words, to, up, size, np.arange(states, dtype=np.int32), np.full(states, -1, np.int32), first, to, {}, words, words, width)

        by_size = np.argsort(size, kind="stable").tolist()  # suffix links lead to shorter runs, which are done
        long = size[up] >= width
        long[0] = False
        for s in by_size:
            if long[s]:
                a.base[s] = a.base[up[s]]
        owners: list[tuple[int, int]] = []
        whole: dict[int, dict[int, set[int]]] = {}
        walk = a.walker()
        for item, h in runs:
            at = 0
            for i, word in enumerate(h.tolist()):
                at = walk(at, word)
                if len(h) >= width:
                    if i + 1 >= width:
                        owners.append((int(a.base[at]), number[item]))
                elif i + 1 == len(h):
                    # The state of a whole item holds shorter runs too: the length goes with it.
                    whole.setdefault(at, {}).setdefault(len(h), set()).add(number[item])
        a.own_first, a.owned = _lists(owners, states)
        a.short = {s: tuple((n, tuple(sorted(x))) for n, x in sorted(of_.items())) for s, of_ in whole.items()}
        if whole:
            for s in by_size:
                a.hop[s] = s if s in whole else a.hop[up[s]] if s else -1
        flat = [h for _, h in runs]
        a.pairs = np.unique(np.concatenate([K.rolling(h, 2) for h in flat] or [np.zeros(0, K.U64)]))
        a.singles = np.unique(np.concatenate([h for h in flat if min(len(h), width) == 1] or [np.zeros(0, K.U64)]))
        a.shortest = min([width, *map(len, flat)])
        return a

    def walker(self) -> Callable[[int, int], int]:
        """A step: the state behind a word, or -1."""
        first, words, to = memoryview(self.first), memoryview(self.words), memoryview(self.to)

        def walk(state: int, word: int) -> int:
            end = first[state + 1]
            at = bisect_left(words, word, first[state], end)
            return to[at] if at < end and words[at] == word else -1

        return walk

    def stream(self, run: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches [start, end) of a run of word hashes, and the items whose windows occur."""
        at, size, hits, found, windows = 0, 0, [], set(), set()
        walk = self.walker()
        for i, word in enumerate(run):
            while (nxt := walk(at, word)) < 0 and at:
                at = int(self.up[at])
                size = int(self.size[at])
            if nxt < 0:
                at = size = 0
                continue
            at, size = nxt, size + 1
            if size >= self.width:
                hits.append((i + 1 - size, i + 1))
                windows.add(int(self.base[at]))
            s = int(self.hop[at])
            while s >= 0:
                for n, items in self.short[s]:
                    if n <= size:
                        hits.append((i + 1 - n, i + 1))
                        found.update(items)
                s = int(self.hop[self.up[s]]) if s else -1
        for s in windows:
            found.update(self.owned[self.own_first[s] : self.own_first[s + 1]].tolist())
        return hits, {self.names[k] for k in found}


def hashes(text: str | None) -> np.ndarray:
    data = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
    return K.hash_words(data, start, end) if len(start) else np.zeros(0, K.U64)


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array. A table of the top bits turns most away at once."""
    if not len(known):
        return np.zeros(len(values), bool)
    bits = max(12, min(22, int(len(known)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    table[known >> K.U64(64 - bits)] = True
    out = table[values >> K.U64(64 - bits)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, values[some]), len(known) - 1)
    out[some] = known[at] == values[some]
    return out


def scan(texts: pa.Array, a: Automaton) -> pa.Array:
    """What each text shares with the items: its words, the hit ones, the items and the maximal hit runs (words and bytes)."""
    rows: list[dict] = []
    for _, _, raw, offs in K.slices(texts):
        data = K.LOWER[raw]
        start, end, first = K.words(data, offs, K.ALNUM)
        h = K.hash_words(data, start, end) if len(start) else np.zeros(0, K.U64)
        n = len(h)
        joined = np.zeros(n + 1, bool)  # word i goes with word i - 1
        if n > 1:
            joined[1:n] = member(K.rolling(h, 2), a.pairs)
            joined[first[(first > 0) & (first < n)]] = False
        change = np.diff(np.concatenate([[False], joined[1:], [False]]).astype(np.int8))
        lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + 1
        long = hi - lo >= a.shortest
        runs = list(zip(lo[long].tolist(), hi[long].tolist(), strict=True))
        if len(a.singles):
            alone = np.flatnonzero(member(h, a.singles))
            inside = np.searchsorted(lo[long], alone, "right") - 1
            apart = (inside < 0) | (alone >= hi[long][np.maximum(inside, 0)]) if long.any() else np.ones(len(alone), bool)
            runs = sorted(runs + [(int(i), int(i) + 1) for i in alone[apart]])
        by: dict[int, tuple[list, set]] = {}
        doc = np.searchsorted(first, [x[0] for x in runs], "right") - 1 if runs else []
        for (x, y), d in zip(runs, doc, strict=True):
            hits, found = a.stream(h[x:y].tolist())
            if hits:
                got = by.setdefault(int(d), ([], set()))
                got[0].extend((x + p, x + q) for p, q in hits)
                got[1].update(found)
        per = np.diff(first)
        for d in range(len(per)):
            hits, found = by.get(d, ((), ()))
            joint = merged([(p - int(first[d]), q - int(first[d])) for p, q in hits])
            base, at = int(first[d]), int(offs[d])
            rows.append({"n_words": int(per[d]), "n_hit": sum(q - p for p, q in joint), "items": sorted(found), "runs": [{"start": p, "end": q, "from_byte": int(start[base + p]) - at, "to_byte": int(end[base + q - 1]) - at} for p, q in joint]})
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])))])
    return pa.array(rows, kind)


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs as one."""
    out: list[tuple[int, int]] = []
    for p, q in sorted(runs):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(q, out[-1][1]))
        else:
            out.append((p, q))
    return out


def _both(one: pa.Array, two: pa.Array) -> pa.Array:
    rows = []
    for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True):
        ends = {(r["start"], r["from_byte"]): r for r in x["runs"] + y["runs"]}
        at = {r["start"]: r["from_byte"] for r in ends.values()}
        to = {r["end"]: r["to_byte"] for r in x["runs"] + y["runs"]}
        joint = merged([(r["start"], r["end"]) for r in x["runs"] + y["runs"]])
        rows.append({"n_words": x["n_words"], "n_hit": sum(q - p for p, q in joint), "items": sorted({*x["items"], *y["items"]}), "runs": [{"start": p, "end": q, "from_byte": at[p], "to_byte": to[q]} for p, q in joint]})
    return pa.array(rows, one.type)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination", width: int = WIDTH, max_bytes: int = 4 << 20) -> DataFrame:
    """df with a struct column ``out``: n_words, n_hit, items (ids as strings, sorted) and runs, the maximal hit stretches in words and bytes.

    The items' automaton is broadcast. Its size is bounded: items are dealt by hash into as many groups as keep each
    group's texts near ``max_bytes``, for which an automaton takes about 11 times that in each worker and 50 times on the driver
    while it is built. One group is the usual case and takes
    one pass without a shuffle. With more, df passes through one automaton after the other, and between them is written with
    the results so far, so a worker holds one automaton at a time and any benchmark is handled whole. An item is never
    cut: one longer than ``max_bytes`` makes a larger group.

    Null or empty texts have no words; an item without words never matches; items with equal text all count. A null item
    id becomes the string "null". Repeated rows are scanned alike; very long texts are scanned whole, at some 40 bytes of
    memory a byte; an empty table gives an empty one. A column of df called ``out`` is replaced.
    """
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("null")).alias("item"), quoted(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-int(total) // max_bytes))
    had = [c for c in df.columns if c.lower() != out.lower()]
    state = df.select(F.struct(*[quoted(c) for c in had]).alias("row"), quoted(text).alias("body"))
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        shared = spark.sparkContext.broadcast(Automaton.build(((r["item"], r["text"]) for r in part.toLocalIterator()), width))
        if g:
            found = F.arrow_udf(lambda x, got, shared=shared: _both(got, scan(x, shared.value)), RESULT)("body", "got")
        else:
            found = F.arrow_udf(lambda x, shared=shared: scan(x, shared.value), RESULT)("body")
        state = state.select("row", "body", found.alias("got"))
        if groups > 1:
            state = stored(state, "contamination")
            shared.destroy()
    return state.select(*[F.col("row")[c].alias(c) for c in had], F.col("got").alias(out))


def _cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for text, runs in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
        if text is None or not runs:
            out.append(text)
            continue
        raw, at, kept = text.encode(), 0, []
        for r in runs:
            kept.append(raw[at : r["from_byte"]])
            at = r["to_byte"]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, max_percent: int = 50) -> DataFrame:
    """df without the benchmark: hit runs are cut out of the texts, and rows of whose words more than ``max_percent`` % are hit go.

    Columns stay as they are, with ``text`` replaced where something was cut; all other rows come back unchanged. Null and
    empty texts stay, as nothing of them is hit; repeated rows are treated alike; an empty table gives an empty one.
    """
    row = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), quoted(text).alias("text"))
    found = contamination(row, benchmark, "text", item_id, item_text, "found", width)
    cut = F.when(F.col("found.n_hit") > 0, F.arrow_udf(_cut, "string")("text", "found.runs")).otherwise(F.col("text"))
    left = found.where(100 * F.col("found.n_hit") <= max_percent * F.col("found.n_words")).select("row", cut.alias("text"))
    return left.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))
