"""Repeated word windows by fixed-block anchors.

Every document's words are cut into blocks of ten that don't overlap; their hashes are the index. Windows of
ten words rolling over all documents probe it. Any two equal runs of twenty words hold a whole block of one
and, at the same place, a window of the other; and of the two ways round, one has its window at most half a
block's length behind a block start, so windows at offsets 0 to 5 within a block find every pair. A hit is then
extended: all windows of twenty words around it are compared as wholes, which gives the maximal exact repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .columns import of
from .hot import with_rows

WINDOW = 20
RESULT = "k1 bigint, k2 bigint, id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_sha256 string"


def block_length(window: int) -> int:
    """The longest block of which every window holds a whole one."""
    return max(1, window // 2)


def _words(block: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, word hashes, first word of each document) for slices of a block."""
    for lo, _, data, offs in K.slices(R.texts(block)):
        start, end, first = K.words(data, offs, K.SPACED)
        yield lo, K.hash_words(data, start, end) if len(start) else np.zeros(0, K.U64), first


def _windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, hash) of every window within one document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(h) - width + 1)
    inside = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n])
    return doc[inside], inside - first[doc[inside]], K.rolling(h, width)[inside]


def _wide(h: np.ndarray, first: np.ndarray, width: int, base: int) -> np.ndarray:
    """32 further bits for each window of _windows."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(h) - width + 1)
    inside = doc[:n] == doc[width - 1 : width - 1 + n]
    return (K.rolling(K.mix(h + K.U64(base)), width, base)[inside] >> K.U64(32)).astype(np.uint32)


def probes(buckets: int, length: int):
    def emit(block: pa.Table) -> list[tuple[int, bytes]]:
        parts = []
        for lo, h, first in _words(block):
            doc, at, fp = _windows(h, first, length)
            some = at % length <= length // 2
            parts.append((doc[some] + lo, at[some], fp[some]))
        doc, at, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        return R.send(R.docs_of(block), doc, at, fp, buckets)

    return emit


def _around(block: pa.Table, lo: int, first: np.ndarray, reach: tuple[int, int], n: int) -> np.ndarray:
    """A mask of the slice's words within [hit - reach[0], hit + reach[1]) of the documents' hits."""
    lists = block.column("at").slice(lo, len(first) - 1).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(lists.value_lengths().fill_null(0))
    hits = np.asarray(lists.flatten()).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    base, end = first[:-1][doc], first[1:][doc]
    return K.spans(np.maximum(base, base + hits - reach[0]), np.minimum(end, base + hits + reach[1]), n)


#: A window in a message: 96 bits of its hash.
PRINT = np.dtype([("f", "<u8"), ("w", "<u4")])


def _sames(order: np.ndarray, fp: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which windows, in an order that brings equal ones together, are like the one before."""
    return np.concatenate([[False], (fp[order][1:] == fp[order][:-1]) & (wide[order][1:] == wide[order][:-1])])


def candidates(buckets: int, window: int, length: int):
    def emit(block: pa.Table) -> list[tuple[int, bytes]]:
        docs, parts = R.docs_of(block), []
        for lo, h, first in _words(block):
            doc, at, fp = _windows(h, first, window)
            near = _around(block, lo, first, (window - length, 1), len(h))[first[doc] + at]
            parts.append((doc[near] + lo, at[near], fp[near], _wide(h, first, window, K.BASE[1])[near]))
        doc, at, fp, wide = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(doc):
            return []
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((docs["k2"], docs["k1"], docs["id"]))] = np.arange(len(docs))
        order = np.lexsort((at, rank[doc], wide, fp))
        again = np.zeros(len(fp), bool)
        again[order] = _sames(order, fp, wide)
        rows, own, send = [], np.flatnonzero(again), np.flatnonzero(~again)
        if len(own):
            rows.append((int(fp[0] % K.U64(buckets)), R.pack(docs, doc[own], at[own], 1)))
        prints = np.empty(len(fp), PRINT)
        prints["f"], prints["w"] = fp, wide
        bucket = ((fp[send] >> K.U64(40)) % K.U64(buckets)).astype(np.int64)
        for b, part in R.dealt(bucket):
            rows.append((b, R.pack(docs, doc[send[part]], at[send[part]], 0, prints[send[part]].tobytes(), PRINT.itemsize)))
        return rows

    return emit


def later(parts: list) -> pa.Table:
    """The windows of a bucket that start earlier elsewhere."""
    docs, doc, at, prints, own, have = [], [], [], [], [], 0
    for kind, d, i, a, more, _ in parts:
        docs.append(d)
        if kind:
            own.append((i + have, a))
        else:
            doc.append(i + have)
            at.append(a)
            prints.append(np.frombuffer(more, PRINT))
        have += len(d)
    docs = np.concatenate(docs)
    out_doc, out_at = [x[0] for x in own], [x[1] for x in own]
    if prints:
        doc, at, both = np.concatenate(doc), np.concatenate(at), np.concatenate(prints)
        fp, wide = both["f"], both["w"]
        order = np.lexsort((at, docs["k2"][doc], docs["k1"][doc], docs["id"][doc], wide, fp))
        rest = order[_sames(order, fp, wide)]
        out_doc.append(doc[rest])
        out_at.append(at[rest])
    none = np.zeros(0, np.int64)
    return R.found(docs, np.concatenate([none, *out_doc]), np.concatenate([none, *out_at]).astype(np.int64))


def _removed(window: int):
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_sha256", pa.string())])
        for batch in batches:
            rows = []
            for k1, k2, i, text, at in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "id", "text", "at")), strict=True):
                words, runs, n = text.encode().split(), [], 0
                if at:
                    gone = K.spans(np.array(at), np.minimum(np.array(at) + window, len(words)), len(words))
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    runs, n = [{"start": p, "end": q} for p, q in edge.tolist()], int(gone.sum())
                    kept = b" ".join(compress(words, ~gone))
                else:
                    kept = b" ".join(words)
                rows.append((k1, k2, i, len(words), n, runs, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)

    return out


def repeated_words(df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, out: str = "repeats") -> DataFrame:
    """df with a struct column ``out``: n_words, n_removed, removed (word runs [start, end)), kept_sha256.

    A word is removed if a window of ``window`` words over it also starts earlier: in a document with a smaller integer
    id, or before in the same one. Null ids come last; different texts with equal ids are ordered by their hashes; rows
    alike in id and text are one document and judged alike. Null text has no words. Texts shorter than a window keep all.
    Windows are compared by 96 bits of hashes of word hashes: among 1e13 windows that is one chance in a thousand of a
    single false repeat. An empty table gives an empty one. A very long text is held whole by one worker, at some 100 bytes
    a byte. A column of df called ``out`` is replaced.

    Copies of a text are judged once: all but the first lose every word. Only hashes and places are shuffled, besides
    each distinct text once; see repeats.py for how hot windows are kept small.
    """
    length = block_length(window)
    rows, size = R.extent(df, text)
    buckets = R.bucket_count(size, 12 << 20)
    texts_ = R.distinct(df, id_column, text)
    hits = R.by_text(R.through_buckets(texts_, probes(buckets, length), R.anchored(length)))
    near = texts_.join(hits, ["k1", "k2"])
    windows = R.by_text(R.through_buckets(near, candidates(buckets, window, length), later))
    judged = texts_.join(windows, ["k1", "k2"], "left").mapInArrow(_removed(window), RESULT)
    both = with_rows(df, text, out, judged, rows)
    copy = ~of("d", id_column).cast("long").eqNullSafe(F.col("j.id")) & (F.col("j.n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("j.n_words").cast("int").alias("end")))
    result = F.struct(
        F.col("j.n_words").alias("n_words"),
        F.when(copy, F.col("j.n_words")).otherwise(F.col("j.n_removed")).alias("n_removed"),
        F.when(copy, whole).otherwise(F.col("j.removed")).alias("removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("j.kept_sha256")).alias("kept_sha256"),
    )
    return both.select(*[of("d", c).alias(c) for c in df.columns if c.lower() != out.lower()], result.alias(out))


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("repeats")
    return repeated_words(docs).select("doc_id", x["n_words"].alias("n_words"), x["n_removed"].alias("n_removed"), x["kept_sha256"].alias("kept_sha256"))
