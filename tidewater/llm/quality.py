"""Quality rules by compression bands.

zstandard ratios (compressed bytes by bytes) of the whole document and of fixed chunks: text that
repeats itself compresses too well, noise doesn't compress at all. What is too well depends on the
length, since a short text gives the compressor little to refer back to; so the limits are bands by
length. Beside the bands stand a few plain counts of words, symbols and repeated lines.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .columns import put, quoted

#: Fixed values: (from so many bytes, least ratio, greatest ratio). Set a little outside the range
#: (1st to 99th percentile) of documents labelled good at each length.
BANDS = (
    (0, 0.0, 9.0),
    (64, 0.36, 1.30),
    (128, 0.42, 1.00),
    (256, 0.49, 0.82),
    (512, 0.475, 0.76),
    (1024, 0.440, 0.70),
    (2048, 0.420, 0.64),
    (4096, 0.400, 0.60),
    (8192, 0.385, 0.58),
    (16384, 0.365, 0.56),
    (65536, 0.330, 0.56),
)
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, n_chunks long, n_odd_chunks long, base_failed boolean, kept boolean"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: the plain rules. chunk: bytes of a chunk; low, high: a whole chunk's band. The rest of a
    text behind its whole chunks is a chunk too, judged by the band of its length, ``slack`` wider on both sides (as low
    and high are wider than the band of their length). max_odd_percent: of chunks outside. level: of zstandard."""

    min_words: int = 50
    max_repeat_percent: int = 50
    bands: tuple[tuple[int, float, float], ...] = BANDS
    chunk: int = 4096
    low: float = 0.30
    high: float = 0.66
    slack: float = 0.25
    max_odd_percent: int = 34
    level: int = 3


def judge(texts: pa.Array, rules: Rules = Rules()) -> pa.Array:
    """The counts, ratios and verdict of each text."""
    out: dict[str, list[np.ndarray]] = {f.split()[0]: [] for f in FIELDS.split(", ")}
    squeeze = zstandard.ZstdCompressor(level=rules.level).compress
    limits = np.array(rules.bands, float)
    for _, _, data, offs in K.slices(texts):
        start, end, first = K.words(data, offs, K.SPACED)
        docs, per = len(offs) - 1, np.diff(first)
        size = np.diff(offs)
        beyond = np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offs)  # bytes after the first of a character
        chars = K.per_doc(end - start, first) - np.diff(beyond)
        symbols = np.diff(np.searchsorted(np.flatnonzero(SYMBOLS[data]), offs))
        repeated = repeated_words(K.hash_words(data, start, end), first)
        again, ratio, odd, chunks = (np.zeros(docs, t) for t in (np.int64, float, np.int64, np.int64))
        raw = data.tobytes()
        for i in range(docs):
            text = raw[offs[i] : offs[i + 1]]
            if not text:
                continue
            ratio[i] = len(squeeze(text)) / len(text)
            for at in range(0, len(text), rules.chunk):
                piece = text[at : at + rules.chunk]
                low, high = rules.low, rules.high
                if len(piece) < rules.chunk:
                    _, low, high = rules.bands[bisect_right(rules.bands, len(piece), key=lambda b: b[0]) - 1]
                    low, high = low * (1 - rules.slack), high * (1 + rules.slack)
                chunks[i] += 1
                odd[i] += not low <= (len(squeeze(piece)) / len(piece) if len(piece) < len(text) else ratio[i]) <= high
            lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            again[i] = len(lines) - len(set(lines))
        failed = (per < rules.min_words) | (100 * repeated > rules.max_repeat_percent * per)
        band = np.searchsorted(limits[:, 0], size, "right") - 1
        good = (ratio >= limits[band, 1]) & (ratio <= limits[band, 2]) & (100 * odd <= rules.max_odd_percent * chunks)
        for k, v in zip(out, (per, chars, symbols, again, repeated, size, ratio, chunks, odd, failed, good & ~failed), strict=True):
            out[k].append(v)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], {"ratio": pa.float64(), "kept": pa.bool_(), "base_failed": pa.bool_()}.get(k, pa.int64())) for k, v in out.items()], list(out))


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """For each document, how many words lie in a window of ``width`` words that the document has twice or more."""
    n, per = len(hashes), np.diff(first)
    if n < width:
        return np.zeros(len(per), np.int64)
    doc = np.repeat(np.arange(len(per)), per)
    inside = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    key = K.rolling(hashes, width)[inside] + K.mix(doc[inside].astype(K.U64) + K.U64(1))
    order = np.argsort(key)
    twin = key[order][1:] == key[order][:-1]
    at = inside[order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]]
    return K.per_doc(K.spans(at, at + width, n), first)


def quality(df: DataFrame, text: str = "text", out: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """df with a struct column ``out`` of FIELDS: what the rules count in ``text``, and whether the row is kept.

    One pass over whole texts, no shuffle. Null text is empty: all counts 0, base_failed. Repeated rows are judged
    alike. A column of df that is called ``out`` is replaced. An empty table gives an empty one.
    """
    judged = F.arrow_udf(lambda x: judge(x, rules), "struct<" + FIELDS.replace(" long", ":bigint").replace(" double", ":double").replace(" boolean", ":boolean") + ">")
    return put(df, out, judged(quoted(text)))


def keep(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of df that the rules keep, columns as they were.

    Null, empty and short texts go, as base rules reject them; repeated rows share their fate; an empty table gives an
    empty one. A very long text is one Arrow value in its worker, as quality() reads it whole.
    """
    judged = quality(df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), quoted(text).alias("text")), "text", "quality", rules)
    return judged.where("quality.kept").select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "quality.*")
