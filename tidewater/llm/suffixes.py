"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

One transform of a whole corpus fits no machine, so the corpus is cut such that strings which can be equal meet.
Every 200-byte string has an anchor: of its runs of 68 bytes the one with the smallest hash. Equal strings
have equal anchors at equal places. Anchors that come once in the corpus settle their strings as unique; the
strings of the others, neighbours with one anchor as one segment, go to the bucket of their anchor's hash.
Each bucket's segments are joined, sorted and transformed; then, starting with the interval of all
suffixes, intervals are extended backwards by a symbol, breadth first. Bounds between suffixes with a common
prefix of length 0, 1, 2, ... come out in this order, and the search stops at 200: suffixes between which no bound was found
share that much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .columns import of
from .hot import with_rows

LENGTH = 200
RESULT = "k1 bigint, k2 bigint, n_bytes bigint, removed array<struct<start:int,end:int>>, n_removed bigint, kept_sha256 string"
#: A value for each byte, so that a run's hash depends on all its bits.
VALUES = K.mix(np.arange(1, 257, dtype=K.U64) * K.U64(K.BASE[1]))
#: Between segments; no UTF-8 text has it.
BREAK = 0xFF


def anchor_length(length: int) -> int:
    """Of an anchor: about a third, so that strings of two thirds of the length agree on theirs."""
    return max(1, length // 3 + 2) if length > 3 else 1


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a slice: (document, first string's start, number of strings, anchor's place, anchor's hash).

    A string's anchor is the leftmost smallest hash among its runs, so neighbouring strings share one until a smaller
    comes in or it drops out. Places are within the slice.
    """
    short = anchor_length(length)
    span = length - short + 1
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.astype(K.U64)
    h = K.rolling(VALUES[data], short)
    least, at, reach = h, np.arange(len(h)), 1
    while reach < span:  # least over [i, i + reach), doubled until it spans all runs of a string
        step = min(reach, span - reach)
        left, right = least[: len(least) - step], least[step:]
        take = right < left
        least, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        reach += step
    doc = np.searchsorted(offs, np.arange(n), "right") - 1 if len(offs) > 2 else np.zeros(n, np.int64)
    start = np.flatnonzero(np.arange(n) + length <= offs[doc + 1])
    if not len(start):
        return none, none, none, none, none.astype(K.U64)
    place = at[start]
    new = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(place, prepend=-1) != 0) | (np.diff(doc[start], prepend=-1) != 0))
    size = np.diff(np.append(new, len(start)))
    first = start[new]
    return doc[first], first, size, place[new], h[place[new]]


def expansion(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, bounds) of a byte array: bounds[i] tells that suffixes i - 1 and i of the order share less than ``length``."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    rank = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(K.U64)
    depth = 8
    while True:
        order = np.argsort(rank, kind="stable")
        group, _ = R.groups(rank[order])
        if depth >= length or (n and group[-1] == n - 1):
            break
        level = np.empty(n, np.int64)
        level[order] = group + 1
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - depth)] = level[depth:]
        rank = level * np.int64(n + 1) + behind
        depth *= 2
    last = text[order - 1]  # the transform: the symbol before each suffix
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)  # to the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    before = np.full(n, -1, np.int64)  # the same symbol's last place
    same = last[by_symbol][1:] == last[by_symbol][:-1]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    fresh_ = np.zeros(1, np.int64)
    for _ in range(length):
        all_ = np.flatnonzero(bound)
        end = all_[np.searchsorted(all_, fresh_) + 1]
        size = end - fresh_
        begin = np.repeat(fresh_, size)
        inside = np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size) + begin
        longer = step[inside[before[inside] < begin]]
        fresh_ = np.unique(longer[~bound[longer]])
        if not len(fresh_):
            break
        bound[fresh_] = True
    return order, bound[:n]


def repeated(segments: list[bytes], weight: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct segment, which of its strings come twice or more in all of them, a segment of weight w counting w times."""
    text = np.frombuffer(b"".join(s + bytes([BREAK]) for s in segments), np.uint8)
    size = np.array([len(s) + 1 for s in segments])
    base = np.cumsum(size) - size
    order, bound = expansion(text, length)
    group = np.cumsum(bound) - 1
    of_segment = np.repeat(np.arange(len(segments)), size)
    whole = np.arange(len(text)) - base[of_segment] + length < size[of_segment]  # a string of the segment starts here
    times = np.bincount(group, np.where(whole[order], weight[of_segment[order]], 0))
    twice = np.empty(len(text), bool)
    twice[order] = times[group] > 1
    return [twice[b : b + n - length] for b, n in zip(base.tolist(), size.tolist(), strict=True)]


def _slices(block: pa.Table, length: int):
    for lo, _, data, offs in K.slices(R.texts(block)):
        yield lo, data, offs, anchors(data, offs, length)


def anchor_places(buckets: int, length: int):
    def emit(block: pa.Table) -> list[tuple[int, bytes]]:
        doc, at, fp = [], [], []
        for lo, _, offs, (d, _, _, place, h) in _slices(block, length):
            doc.append(d + lo)
            at.append(place - offs[d])
            fp.append(h)
        return R.send(R.docs_of(block), *(np.concatenate(x) for x in (doc, at, fp)), buckets)

    return emit


def _runs(docs: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Table:
    """FOUND rows in which ``at`` holds pairs: where strings start, and how many in a row."""
    order = np.lexsort((start, doc))
    doc = doc[order]
    used, first = np.unique(doc, return_index=True)
    pairs = np.stack([start[order], size[order]], 1).astype(np.int32).ravel()
    lists = pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(doc)), pa.int32()), pa.array(pairs))
    return pa.Table.from_arrays([pa.array(docs["k1"][used]), pa.array(docs["k2"][used]), lists], schema=R._FOUND)


def segments_of(buckets: int, length: int):
    def emit(block: pa.Table) -> list[tuple[int, bytes]]:
        docs, lists = R.docs_of(block), block.column("at").to_pylist()
        places: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for lo, data, offs, (d, start, size, place, h) in _slices(block, length):
            raw = data.tobytes()
            hit = np.zeros(len(data) + 1, bool)
            for i in range(len(offs) - 1):
                hit[offs[i] + np.array(lists[lo + i], np.int64)] = True
            for i, s, n, x in zip(*(a[hit[place]].tolist() for a in (d, start, size, h)), strict=True):
                places.setdefault((x, raw[s : s + n + length - 1]), []).append((i + lo, s - int(offs[i])))
        rows, own, out = [], [], {}
        for (x, segment), where in places.items():
            if len(where) > 1:
                own.extend((i, s, len(segment) - length + 1) for i, s in where)
            out.setdefault((x >> 40) % buckets, []).append((*where[0], len(where) > 1, x, segment))
        if own:
            i, s, n = np.array(sorted(own), np.int64).T
            rows.append((own[0][1] % buckets, R.pack(docs, i, s, 1, n.astype("<u4").tobytes(), 4)))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b, some in out.items():
            by_text = sorted(range(len(some)), key=lambda j: some[j][3:])  # like segments side by side
            turn = sorted(range(len(some)), key=lambda j: some[by_text[j]][:2])
            seen = [some[by_text[j]] for j in turn]
            head = np.array([(t, x, len(g)) for t, (_, _, _, x, g) in zip(turn, seen, strict=True)], "<u8").tobytes()
            body = squeeze(b"".join(some[j][4] for j in by_text))
            at = np.array([s for _, s, _, _, _ in seen], np.int64) | np.where([m for _, _, m, _, _ in seen], R.SURE, 0)
            rows.append((int(b), R.pack(docs, np.array([i for i, *_ in seen], np.int64), at, 0, head + body, 24)))
        return rows

    return emit


def expanded(length: int):
    def reduce(parts: list) -> pa.Table:
        docs, have = [], 0
        doc, start, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known: dict[tuple[int, bytes], list[tuple[int, int, bool]]] = {}
        for kind, d, i, at, more, width in parts:
            docs.append(d)
            if kind:
                doc.append(i + have)
                start.append(at.astype(np.int64))
                size.append(np.frombuffer(more, "<u4").astype(np.int64))
            else:
                head = np.frombuffer(more, "<u8", 3 * len(i)).reshape(-1, 3)
                body = zstandard.ZstdDecompressor().decompress(more[width * len(i) :])
                long = np.zeros(len(i), np.int64)
                long[head[:, 0].astype(np.int64)] = head[:, 2].astype(np.int64)
                ends = np.cumsum(long)
                for j, (t, x, n) in enumerate(head.tolist()):
                    known.setdefault((x, body[ends[t] - n : ends[t]]), []).append((int(i[j]) + have, int(at[j] & ~R.SURE), bool(at[j] & R.SURE)))
            have += len(d)
        kinds: dict[int, int] = {}
        for x, _ in known:
            kinds[x] = kinds.get(x, 0) + 1
        weight = {k: len(w) + any(m for *_, m in w) for k, w in known.items()}
        several = [k for k in known if kinds[k[0]] > 1]
        twice = dict(zip(several, repeated([k[1] for k in several], np.array([weight[k] for k in several]), length), strict=True)) if several else {}
        for k, where in known.items():
            n = len(k[1]) - length + 1
            mask = twice[k] if k in twice else np.full(n, weight[k] > 1)
            edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            if len(edge):
                i, s = (np.array(a, np.int64) for a in zip(*((i, s) for i, s, _ in where), strict=True))
                doc.append(np.repeat(i, len(edge)))
                start.append((s[:, None] + edge[None, :, 0]).ravel())
                size.append(np.tile(edge[:, 1] - edge[:, 0], len(i)))
        return _runs(np.concatenate(docs), np.concatenate(doc), np.concatenate(start), np.concatenate(size))

    return reduce


def _removed(length: int):
    kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, copies, text, at in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "n", "text", "at")), strict=True):
                raw = text.encode()
                edge = [(0, len(raw))] if copies > 1 and len(raw) >= length else []
                if at and not edge:
                    start, size = np.array(at, np.int64).reshape(-1, 2).T
                    gone = K.spans(start, start + size + length - 1, len(raw))
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                kept, done = [], 0
                for p, q in edge:
                    kept.append(raw[done:p])
                    done = q
                left = b"".join([*kept, raw[done:]])
                rows.append((k1, k2, len(raw), [{"start": p, "end": q} for p, q in edge], len(raw) - len(left), hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)

    return out


def repeated_bytes(df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, out: str = "repeats") -> DataFrame:
    """df with a struct column ``out``: n_bytes, removed (byte runs [start, end)), n_removed, kept_sha256.

    A byte is removed if a string of ``length`` bytes over it also starts anywhere else in the corpus, the same document
    included; overlapping strings count, and all are judged on the input. Null text is empty. Rows with equal texts are
    places of their own, so a text of ``length`` bytes or more that comes twice is removed whole. Ids may be null or
    repeat. A column of df called ``out`` is replaced; an empty table gives an empty one.

    Anchors' hashes (64 bits) only choose what is compared; the comparison is of bytes. Each distinct text is shuffled
    once, besides anchors' places and the segments of anchors that come more than once.
    """
    rows, size = R.extent(df, text)
    buckets = R.bucket_count(size, 4 << 20, 128)
    texts_ = R.distinct(df, id_column, text)
    hits = R.by_text(R.through_buckets(texts_, anchor_places(buckets, length), R.anchored(1)))
    near = texts_.join(hits, ["k1", "k2"])
    runs = R.by_text(R.through_buckets(near, segments_of(buckets, length), expanded(length)))
    judged = texts_.join(runs, ["k1", "k2"], "left").mapInArrow(_removed(length), RESULT)
    both = with_rows(df, text, out, judged, rows)
    result = F.struct(*[F.col(f"j.{c}").alias(c) for c in ("n_bytes", "removed", "n_removed", "kept_sha256")])
    return both.select(*[of("d", c).alias(c) for c in df.columns if c.lower() != out.lower()], result.alias(out))


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("repeats")
    return repeated_bytes(docs).select("doc_id", x["n_bytes"].alias("n_bytes"), x["n_removed"].alias("n_removed"), F.size(x["removed"]).cast("long").alias("n_spans"), x["kept_sha256"].alias("kept_sha256"))
