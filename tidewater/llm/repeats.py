"""What the two searches for repeated stretches share: distinct texts, blocks of documents, messages to hash buckets.

Documents pass in blocks of some megabytes. A block's hashes go to buckets in packed messages, one for each
bucket, which groupBy("bucket") brings together. What a block already knows to repeat within itself is sent
as a plain finding with only one representative, so a stretch that a third of all documents share reaches
its bucket once from each block, not once from each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .kernels import trim

BLOCK = 8 << 20
U64 = np.uint64
#: On a place in a message: more than one has its hash in the block.
SURE = np.int64(1) << 31
LAST = np.iinfo(np.int64).max
MESSAGE = "bucket int, payload binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
FOUND = "k1 bigint, k2 bigint, at array<int>"
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.list_(pa.int32()))])
#: A document in a message: the key of its text and its id (null: LAST).
DOC = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("id", "<i8")])


def keyed(df: DataFrame, text: str) -> DataFrame:
    """df with k1 and k2, two hashes of the whole text (null: the empty text), which stand for it."""
    body = F.coalesce(quoted(text), F.lit(""))
    return df.withColumn("k1", F.xxhash64(body, F.lit(1))).withColumn("k2", F.xxhash64(F.lit(2), body))


def distinct(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(k1, k2, id, n, text): each text once, with its smallest id and how often it comes; copies meet in partial aggregates."""
    rows = keyed(df.select(quoted(id_column).cast("long").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text")), "text")
    return rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Table]:
    """Arrow batches cut and joined to tables of about ``size`` bytes of text."""
    held, have = [], 0
    for batch in batches:
        at = 0
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
        while at < len(batch):
            done = int(ends[at - 1]) if at else 0
            upto = min(len(batch), max(at + 1, int(np.searchsorted(ends, done + size - have, "right"))))
            held.append(batch.slice(at, upto - at))
            have += int(ends[upto - 1]) - done
            at = upto
            if have >= size:
                yield pa.Table.from_batches(held)
                held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def docs_of(table: pa.Table) -> np.ndarray:
    out = np.zeros(len(table), DOC)
    for name in ("k1", "k2"):
        out[name] = table.column(name).to_numpy()
    out["id"] = table.column("id").fill_null(LAST).to_numpy()
    return out


def planes(values: np.ndarray) -> bytes:
    """Bytes by place, so that high bytes, mostly zero, lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel(), at + n * size


def pack(docs: np.ndarray, doc: np.ndarray, at: np.ndarray, kind: int, more: bytes = b"", width: int = 0) -> bytes:
    """A message of places: ``doc`` (indices into docs, ascending) and ``at``; ``more`` holds ``width`` bytes for each."""
    used, count = np.unique(doc, return_counts=True)
    head = np.array([kind, len(used), len(doc), width], "<i4").tobytes()
    return b"".join([head, docs[used].tobytes(), planes(count.astype("<u4")), planes(at.astype("<u4")), more])


def unpack(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes, int]:
    """(kind, docs, index of each place's document, at, more, width)."""
    kind, n_docs, n, width = np.frombuffer(raw, "<i4", 4).tolist()
    start = 16 + n_docs * DOC.itemsize
    docs = np.frombuffer(raw, DOC, n_docs, 16)
    count, start = unplanes(raw, start, n_docs, "<u4")
    at, start = unplanes(raw, start, n, "<u4")
    return kind, docs, np.repeat(np.arange(n_docs), count), at, raw[start:], width


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its members in their order)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_MESSAGE)


def found(docs: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.Table:
    """Places by document as FOUND rows."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    used, first = np.unique(doc, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at.astype(np.int32)))
    return pa.Table.from_arrays([pa.array(docs["k1"][used]), pa.array(docs["k2"][used]), lists], schema=_FOUND)


def send(docs: np.ndarray, doc: np.ndarray, at: np.ndarray, hashes: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Messages with a block's hashes (five bytes of each are enough beside the bucket). Those that the block has twice
    are findings already: their places go as such, and one of them goes with the hash, marked SURE."""
    if not len(doc):
        return []
    order = np.argsort(hashes, kind="stable")
    group, size = groups(hashes[order])
    twice, leader = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    twice[order] = size[group] > 1
    leader[order[np.flatnonzero(np.diff(group, prepend=-1))]] = True
    rows, own = [], np.flatnonzero(twice)
    if len(own):
        rows.append((int(hashes[0] % U64(buckets)), pack(docs, doc[own], at[own], 1)))
    one = np.flatnonzero(leader)
    marked = at[one] | np.where(twice[one], SURE, 0)
    low = hashes[one].view(np.uint8).reshape(-1, 8)[:, :5]
    for b, part in dealt(((hashes[one] >> U64(40)) % U64(buckets)).astype(np.int64)):
        rows.append((b, pack(docs, doc[one[part]], marked[part], 0, np.ascontiguousarray(low[part]).tobytes(), 5)))
    return rows


def anchored(length: int) -> Callable[[list], pa.Table]:
    """For a bucket's messages: the places of hashes that come twice or more, at least once at a block start (a multiple of length)."""

    def reduce(parts: list) -> pa.Table:
        docs, doc, at, hashes, own_doc, own_at, have = [], [], [], [], [], [], 0
        for kind, d, i, a, more, width in parts:
            docs.append(d)
            (own_doc if kind else doc).append(i + have)
            (own_at if kind else at).append(a.astype(np.int64))
            if not kind:
                low = np.zeros((len(i), 8), np.uint8)
                low[:, :width] = np.frombuffer(more, np.uint8).reshape(-1, width)
                hashes.append(low.view("<u8").ravel())
            have += len(d)
        if hashes:
            doc, at, hashes = np.concatenate(doc), np.concatenate(at), np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            group, size = groups(hashes[order])
            index = ((at[order] & SURE) > 0) | (at[order] % length == 0)
            good = (size > 1) & (np.bincount(group, index) > 0)
            chosen = order[good[group]]
            own_doc.append(doc[chosen])
            own_at.append(at[chosen] & ~SURE)
        return found(np.concatenate(docs), np.concatenate(own_doc), np.concatenate(own_at))

    return reduce


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the group of each, and the groups' sizes."""
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return group, np.bincount(group, minlength=0)


def by_text(rows: DataFrame) -> DataFrame:
    """FOUND rows of all buckets as one row for each text."""
    return rows.groupBy("k1", "k2").agg(F.flatten(F.collect_list("at")).alias("at"))


def joined_tables(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes, int]]:
    trim()
    return [unpack(x) for x in table.column("payload").to_pylist()]


def through_buckets(texts_: DataFrame, emit: Callable, reduce: Callable) -> DataFrame:
    """FOUND rows: blocks of texts_ through ``emit`` to messages, and the messages of each bucket through ``reduce``."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = emit(block)
            if rows:
                yield messages(rows)

    return texts_.mapInArrow(out, MESSAGE).groupBy("bucket").applyInArrow(lambda t: reduce(joined_tables(t)), FOUND)


def extent(df: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of text)."""
    got = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(quoted(text))), F.lit(0)).alias("bytes")).first()
    return int(got["rows"]), int(got["bytes"])


def bucket_count(size: int, per_bucket: int, least: int = 64) -> int:
    """Buckets for so many bytes of input, so that each fits in a Python worker however large the input is."""
    return max(least, -(-size // per_bucket))
