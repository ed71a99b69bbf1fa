"""Similarity join of documents by the Jaccard index of their word shingles, with signature trees.

Which documents can meet at all is decided by prefixes: a document that links with another lacks at most
allowed(n) of its n shingles there, so of its first allowed(n) + 1 in an order common to all, one is shared. Shingles
that only one document has come first in the order; a document with more of them than it may lack links with
nothing and goes. Those left meet in the groups of their prefix shingles.

A group is joined by a tree. Each node holds the OR of its sets' bitmaps, the range of their sizes and the
most shingles that share a bit with others of their set. Two nodes, or two sets, can have no more shingles in
common than their bitmaps have bits in common plus that surplus; where that doesn't reach the least overlap
that their sizes allow, the pair is left. What remains is compared exactly, unless links found already join it.

Groups are joined in three rounds, components after each. First each document goes to the group of its first
prefix shingle. Then components of several documents send one of them to the groups of all. What is left is
complete but planned: of the pairs in one group, from different components, not met in the first round, each is
due in the group of the first shingle that both have; only documents with such a pair go there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .columns import of, quoted
from .components import components
from .hot import with_rows
from .store import discard, stored

#: Shingles whose hash lies in the lowest quarter are sent by all documents that have them.
LOW = K.U64(1 << 62)
#: Bytes of a shingle's hash that are kept in a set.
KEPT = 6
#: Documents of a group that are joined in one piece, and leaves' sets.
PIECE, LEAF = 128, 8
#: Documents of a group that are planned in one piece, and shingles that are looked at together for it.
PLAN, COLUMNS = 512, 4096
PLANNED = "g bigint, k1 bigint, k2 bigint, l1 bigint, l2 bigint"
_PLANNED = pa.schema([(c.split()[0], pa.int64()) for c in PLANNED.split(", ")])
SETS = "k1 bigint, k2 bigint, id bigint, n bigint, shingles binary, room int, shared array<bigint>"
_SETS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary()), ("room", pa.int32()), ("shared", pa.list_(pa.int64()))])
#: Shingles of more than HOT documents come late in the order; MOST of them at most are looked up, the most frequent.
HOT, MOST = 128, 200_000
LINKS = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"
_LINKS = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])


def allowed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many of its n shingles a set may lack in one that it links with."""
    return n - (-(-percent * n // 100))


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each document's distinct shingles, ascending. A text of fewer words, but not none, has its whole run as one."""
    data = K.LOWER[data]
    start, end, first = K.words(data, offs, K.SPACED)
    h = K.hash_words(data, start, end) if len(start) else np.zeros(0, K.U64)
    per = np.diff(first)
    doc = np.repeat(np.arange(len(per)), per)
    n = max(0, len(h) - width + 1)
    inside = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n])
    values, docs = [K.rolling(h, width)[inside]], [doc[inside]]
    for i in np.flatnonzero((per > 0) & (per < width)).tolist():
        run = h[first[i] : first[i + 1]]
        values.append(K.mix(K.rolling(run, len(run)) + K.U64(len(run))))
        docs.append(np.array([i]))
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(per) + 1))


def sent(value: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """How many of each document's shingles are sent: the low ones, and as many as a prefix may need."""
    n = np.diff(bounds)
    low = np.diff(np.searchsorted(np.flatnonzero(value < LOW), bounds))
    return np.where(n > 0, np.maximum(low, np.minimum(n, allowed(n, percent) + 1)), 0)


def first_shingles(buckets: int, width: int, percent: int):
    def emit(block: pa.Table) -> list[tuple[int, bytes]]:
        doc, at, fp = [], [], []
        for lo, _, data, offs in K.slices(R.texts(block)):
            value, bounds = shingles(data, offs, width)
            many = sent(value, bounds, percent)
            d = np.repeat(np.arange(len(many)), many)
            i = np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)
            doc.append(d + lo)
            at.append(i)
            fp.append(value[bounds[d] + i])
        return R.send(R.docs_of(block), *(np.concatenate(x) for x in (doc, at, fp)), buckets)

    return emit


def sets_of(width: int, percent: int):
    """Of texts with the places of their shared sent shingles: SETS rows; without a set where nothing can link.

    ``shared`` holds the low shared shingles, and of the others those that a prefix may reach; ``room`` is how much of a
    prefix the shingles that nobody shares leave.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in R.blocks(batches):
            docs, lists = R.docs_of(block), block.column("at").to_pylist()
            size, packed, rooms, lists_out = [], [], [], []
            for lo, hi, data, offs in K.slices(R.texts(block)):
                value, bounds = shingles(data, offs, width)
                many = sent(value, bounds, percent)
                for i in range(hi - lo):
                    own = value[bounds[i] : bounds[i + 1]]
                    size.append(len(own))
                    at, lack = lists[lo + i], allowed(len(own), percent)
                    chosen = None
                    if at:
                        shared = np.unique(np.array(at))
                        low = int(np.searchsorted(own[: many[i]], LOW))
                        n_low = int(np.searchsorted(shared, low))
                        room = lack + 1 - (low - n_low)  # what the shingles that nobody shares leave of the prefix
                        if room > 0:
                            chosen = np.concatenate([shared[:n_low], shared[n_low:][shared[n_low:] < low + max(0, room - n_low)]])
                    if chosen is None or not len(chosen):
                        packed.append(None)
                        rooms.append(None)
                        lists_out.append(None)
                    else:
                        rooms.append(room)
                        packed.append(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes())
                        lists_out.append(own[chosen].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs["k1"]), pa.array(docs["k2"]), block.column("id").combine_chunks(), pa.array(size, pa.int64()), pa.array(packed, pa.binary()), pa.array(rooms, pa.int32()), pa.array(lists_out, pa.list_(pa.int64()))], schema=_SETS)

    return out


def in_order(shared: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose unsigned order is that of prefixes: low and not hot, low and hot, others; by hash in each."""
    low = shared < LOW
    at = np.minimum(np.searchsorted(hot, shared), max(0, len(hot) - 1))
    late = low & (hot[at] == shared) if len(hot) else np.zeros(len(shared), bool)
    return np.sort((shared >> K.U64(1)) | np.where(late, K.U64(1 << 62), K.U64(0)) | np.where(low, K.U64(0), K.U64(1 << 63)))


def prefixes(hot, with_sets: bool):
    """For sets: (k1, k2, n, prefix), with ``with_sets`` also the first of the prefix as ``token`` and the shingles."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            lists = [in_order(np.array(x, np.int64).view(K.U64), hot.value)[:room].view(np.int64) for x, room in zip(column("shared").to_pylist(), column("room").to_pylist(), strict=True)]
            made = {c: column(c) for c in ("k1", "k2", "n")} | {"prefix": pa.array(lists, pa.list_(pa.int64()))}
            if with_sets:
                made |= {"token": pa.array([x[0] for x in lists], pa.int64()), "shingles": column("shingles")}
            yield pa.RecordBatch.from_pydict(made)

    return out


PREFIXES = "k1 bigint, k2 bigint, n bigint, prefix array<bigint>"


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Tree:
    """A signature tree over some sets. At each level LEAF nodes, or sets, make one above; sets are ordered by size, then by
    bitmap, so that like ones share nodes."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        size = np.array([len(s) for s in sets])
        bits = 1 << int(min(16, max(9, int(size.max()).bit_length() + 2)))
        marks = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            at = K.mix(s) & K.U64(bits - 1)
            np.bitwise_or.at(marks[i], (at >> K.U64(3)).astype(np.int64), (1 << (at & K.U64(7))).astype(np.uint8))
        marks = marks.view(np.uint64)
        order = np.lexsort((marks[:, 0], size))
        least = size[order]
        surplus = least - np.bitwise_count(marks[order]).sum(1, dtype=np.int64)
        self.order = order
        self.levels = [(marks[order], least, least, surplus)]
        while len(self.levels[-1][0]) > LEAF:
            m, lo, hi, extra = self.levels[-1]
            cut = np.arange(0, len(m), LEAF)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(extra, cut)))

    def may(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level may hold a link: sizes near enough, and the greatest possible overlap reaches the least needed."""
        m, lo, hi, extra = self.levels[level]
        p = self.percent
        near = (100 * hi[i] >= p * lo[j]) & (100 * hi[j] >= p * lo[i])
        out = np.flatnonzero(near)
        most = np.bitwise_count(m[i[out]] & m[j[out]]).sum(1, dtype=np.int64) + np.minimum(extra[i[out]], extra[j[out]])
        near[out] = (100 + p) * most >= p * (lo[i[out]] + lo[j[out]])  # overlap / (sizes - overlap) >= p / 100
        return near

    def links(self, forest: Forest) -> list[tuple[int, int]]:
        """Links that join what forest holds apart; it is joined by them. Dual traversal from the top level's pairs down."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        i, j = np.triu_indices(n, 0 if top else 1)
        for level in range(top, -1, -1):
            some = max(64, (4 << 20) // self.levels[level][0][0].nbytes)  # pairs whose bitmaps take 4 MB
            ok = np.concatenate([self.may(level, i[k : k + some], j[k : k + some]) for k in range(0, len(i), some)]) if len(i) else np.zeros(0, bool)
            i, j = i[ok], j[ok]
            if level:
                n = len(self.levels[level - 1][0])
                step = np.arange(LEAF)
                x = np.repeat(i[:, None] * LEAF + step, LEAF, 1).ravel()
                y = np.tile(j[:, None] * LEAF + step, (1, LEAF)).ravel()
                ok = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
                i, j = x[ok], y[ok]
        found = []
        for x, y in zip(self.order[i].tolist(), self.order[j].tolist(), strict=True):
            if forest.root(x) != forest.root(y) and linked(self.sets[x], self.sets[y], self.percent):
                forest.join(x, y)
                found.append((x, y))
        return found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exactly, of sorted sets."""
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def join_groups(percent: int):
    """For rows (g, k1, k2, label, shingles) of some groups: LINKS between rows of different labels, enough to join what links join."""

    def run(table: pa.Table) -> pa.Table:
        K.trim()
        g = table.column("g").to_numpy()
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        l1, l2 = table.column("l1").to_numpy(), table.column("l2").to_numpy()
        packed = table.column("shingles").combine_chunks()
        packed = pa.concat_arrays(packed.chunks) if isinstance(packed, pa.ChunkedArray) else packed
        rows: list[tuple[int, int, int, int]] = []
        for _, part in R.dealt(g):
            if len(part) < 2:
                continue
            sets = []
            for r in part.tolist():
                raw = np.frombuffer(packed[r].as_buffer(), np.uint8).reshape(-1, KEPT)
                whole = np.zeros((len(raw), 8), np.uint8)
                whole[:, :KEPT] = raw
                sets.append(np.sort(whole.view("<u8").ravel()))
            forest, seen = Forest(len(part)), {}
            for i, r in enumerate(part.tolist()):
                forest.join(i, seen.setdefault((l1[r], l2[r]), i))
            for x, y in Tree(sets, percent).links(forest):
                rows.append((k1[part[x]], k2[part[x]], k1[part[y]], k2[part[y]]))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], schema=_LINKS)

    return run


def plan_groups(percent: int):
    """For rows (g, token, k1, k2, l1, l2, met, n, prefix) of some groups: PLANNED rows, the documents that have a pair due, in
    groups of two pieces at most."""

    def due(w: np.uint64, label: np.ndarray, met: np.ndarray, n: np.ndarray, prefixes: list[np.ndarray]) -> np.ndarray:
        m = len(n)
        need = (label[:, None] != label[None, :]) & (met[:, None] != met[None, :]) & (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
        if need.any():
            owner = np.repeat(np.arange(m), [len(x) for x in prefixes])
            shingle = np.concatenate(prefixes).view(K.U64)
            before = shingle < w
            known, column, times = np.unique(shingle[before], return_inverse=True, return_counts=True)
            several = times > 1
            number = np.cumsum(several) - 1
            row, column = owner[before][several[column]], number[column][several[column]]
            for at in range(0, int(several.sum()), COLUMNS):
                some = (column >= at) & (column < at + COLUMNS)
                has = np.zeros((m, COLUMNS), np.float32)
                has[row[some], column[some] - at] = 1
                need &= (has @ has.T) == 0
        return need

    def run(table: pa.Table) -> pa.Table:
        K.trim()
        names = ("g", "token", "k1", "k2", "l1", "l2", "met", "n")
        a = {c: table.column(c).to_numpy() for c in names}
        prefix = table.column("prefix").combine_chunks()
        prefix = pa.concat_arrays(prefix.chunks) if isinstance(prefix, pa.ChunkedArray) else prefix
        ends, values = prefix.offsets.to_numpy(), prefix.values.to_numpy()
        out: list[np.ndarray] = []
        for g, part in R.dealt(a["g"]):
            _, one = np.unique(a["k1"][part] ^ K.mix(a["k2"][part].view(K.U64)).view(np.int64), return_index=True)
            part = part[one]
            _, label, times = np.unique(np.stack([a["l1"][part], a["l2"][part]], 1), axis=0, return_inverse=True, return_counts=True)
            order = np.argsort(times[label.ravel()], kind="stable")  # documents of one large component side by side
            part, label = part[order], label.ravel()[order]
            need = due(a["token"][part[:1]].view(K.U64)[0], label, a["met"][part], a["n"][part], [values[ends[i] : ends[i + 1]] for i in part.tolist()])
            for i in range(0, len(part), PLAN):
                for j in range(i, len(part), PLAN):
                    block = need[i : i + PLAN, j : j + PLAN]
                    if block.any():
                        chosen = np.union1d(i + np.flatnonzero(block.any(1)), j + np.flatnonzero(block.any(0)))
                        key = K.mix(np.array([g], np.int64).view(K.U64) + K.U64(1 + i * PLAN * 8 + j)).view(np.int64)
                        out.append(np.stack([np.repeat(key, len(chosen)), *(a[c][part[chosen]] for c in ("k1", "k2", "l1", "l2"))], 1))
        rows = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(5)], schema=_PLANNED)

    return run


def _joined(members: DataFrame, sets: DataFrame | None, percent: int, buckets: int) -> DataFrame:
    """Links (a, b) between the vertices of members (g, v, label), with their sets from ``sets`` unless they have them."""
    if sets is not None:
        members = members.join(sets.select(F.struct("k1", "k2").alias("v"), "shingles"), "v")
    flat = members.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket"), "g", F.col("v.k1").alias("k1"), F.col("v.k2").alias("k2"), F.col("label.k1").alias("l1"), F.col("label.k2").alias("l2"), "shingles")
    found = flat.groupBy("bucket").applyInArrow(join_groups(percent), LINKS)
    return found.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("b"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels merged along links between vertices."""
    a = links.join(labels.select(F.col("v").alias("a"), F.col("label").alias("la")), "a")
    return components(labels, a.join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))


def _groups(members: DataFrame) -> DataFrame:
    """Of members (token, v, label): those of tokens with several labels, one token for each set of vertices; with the group's size.

    The token that stays is the first in the order of prefixes, which is unsigned: pairs are due in the first group that both are in.
    """
    flipped = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))
    whole = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l"), F.max("label").alias("m"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "v")).alias("y"))
    kept = whole.where("l != m").groupBy("size", "x", "y").agg(F.min(flipped).alias("token")).withColumn("token", flipped)
    return members.join(kept.select("token", "size"), "token")


def classes(df: DataFrame, id_column: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Of the distinct texts of df: (v, id, n, label), and for each label (label, least) with its document of the smallest id as
    least (none, id, v, n); and the rows of df. Both read stored tables."""
    rows, size = R.extent(df, text)
    buckets = R.bucket_count(size, 16 << 20, 64)
    texts_ = R.distinct(df, id_column, text)
    shared = R.by_text(R.through_buckets(texts_, first_shingles(buckets, width, percent), R.anchored(1)))
    sets = stored(texts_.join(shared, ["k1", "k2"], "left").select("k1", "k2", "id", "text", "at").mapInArrow(sets_of(width, percent), SETS), "shingle-sets")
    del texts_, shared
    able = sets.where("shingles is not null")
    vertex = F.struct("k1", "k2")
    labels = stored(able.select(vertex.alias("v"), vertex.alias("label")), "labels")

    # The order of shingles: those that many have come late. Any choice of them is right, so the list may be cut.
    counted = able.select(F.explode("shared").alias("token")).where(F.col("token").between(0, int(LOW) - 1)).groupBy("token").count()
    late = counted.where(F.col("count") > HOT).orderBy(F.desc("count"), "token").limit(MOST)
    hot = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r["token"] for r in late.collect()], np.int64).view(K.U64)))
    narrow = stored(able.drop("shingles", "id").mapInArrow(prefixes(hot, False), PREFIXES), "prefixes")

    # The first shingle of each document. Large groups go in pieces.
    crowds = stored(narrow.groupBy(F.element_at("prefix", 1).alias("token")).count().where(F.col("count") > PIECE), "large-groups")
    large = F.broadcast(crowds) if crowds.count() <= 100_000 else crowds
    parts = F.coalesce(F.ceil(F.col("count") / PIECE), F.lit(1))
    met = F.xxhash64("token", F.pmod(F.xxhash64(vertex), parts)).alias("met")
    first = able.mapInArrow(prefixes(hot, True), PREFIXES + ", token bigint, shingles binary").join(large, "token", "left").select("k1", "k2", "shingles", met)
    labels = _relabelled(labels, _joined(first.select(F.col("met").alias("g"), vertex.alias("v"), vertex.alias("label"), "shingles"), None, percent, buckets))


    # One document of each component of several, by all its shingles.
    members = narrow.select(vertex.alias("v"), F.explode("prefix").alias("token"))
    several = stored(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label"), "several")
    lead = members.join(labels.join(several, "label", "left_semi"), "v").groupBy("token", "label").agg(F.min("v").alias("v"))
    grouped = _groups(lead).withColumn("g", F.xxhash64("token", F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / PIECE))))
    labels = _relabelled(labels, _joined(grouped.select("g", "v", "label"), able, percent, buckets))

    # All pairs that are left, planned; of very large groups by pairs of pieces.
    rest = _groups(members.join(labels, "v")).withColumn("pieces", F.ceil(F.col("size") / PLAN)).withColumn("own", F.pmod(F.xxhash64("v"), F.col("pieces")))
    pairs = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).withColumn("g", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
    known = narrow.withColumn("token", F.element_at("prefix", 1)).join(large, "token", "left").select(vertex.alias("v"), met, "n", "prefix")
    wide = pairs.select("g", "token", "v", "label").join(known, "v").select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket"), "g", "token", "v.k1", "v.k2", F.col("label.k1").alias("l1"), F.col("label.k2").alias("l2"), "met", "n", "prefix")
    due = wide.groupBy("bucket").applyInArrow(plan_groups(percent), PLANNED)
    pair = lambda a, b: F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))
    labels = _relabelled(labels, _joined(due.select("g", pair("k1", "k2").alias("v"), pair("l1", "l2").alias("label")), able, percent, buckets))

    judged = stored(sets.select(vertex.alias("v"), "id", "n").join(labels, "v", "left").select("v", "id", "n", F.coalesce("label", "v").alias("label")), "classes")
    least = stored(judged.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v", "n")).alias("least")), "least-ids")
    discard(sets, labels, narrow, crowds, several)
    return judged, least, rows


def similar(df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, out: str = "similar") -> DataFrame:
    """df with a struct column ``out``: n_shingles, component_id (the smallest integer id that links lead to, the own included), first (whether
    it is the text of that id), k1 and k2 (the text's hashes).

    Two documents link when their sets of ``width``-word shingles (A-Z lower-cased) have a Jaccard index of ``percent`` / 100
    or more. No link between different texts is lost and none is added, but that hashes of 64 bits (48 within a pair)
    stand for shingles. Equal texts are one vertex. A text without words, or null, has no shingle and links with
    nothing, not even its copies. Null ids: a component of them alone has component_id null. A column of df called ``out``
    is replaced; an empty table gives an empty one. A very long text is held whole by one worker, at some 25 bytes a byte.

    Texts are shuffled once, for the distinct ones; after that a document is its shingles' hashes. Large groups are
    joined in pieces of PIECE documents, and planned by pairs of pieces of PLAN, so no task holds a whole group.
    """
    judged, least, rows = classes(df, id_column, text, width, percent)
    whole = judged.join(least, "label").select(F.col("v.k1").alias("k1"), F.col("v.k2").alias("k2"), "n", F.col("least.id").alias("least"), (F.col("least.v") == F.col("v")).alias("first"))
    both = with_rows(df, text, out, whole, rows)
    component = F.when(F.col("j.n") > 0, F.col("j.least")).otherwise(of("d", id_column).cast("long"))
    result = F.struct(F.col("j.n").alias("n_shingles"), component.alias("component_id"), F.col("j.first").alias("first"), F.col("j.k1").alias("k1"), F.col("j.k2").alias("k2"))
    return both.select(*[of("d", c).alias(c) for c in df.columns if c.lower() != out.lower()], result.alias(out))


def representatives(df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of similar(): that with the smallest id. Documents without words, null among them, stay;
    columns as they were; an empty table gives an empty one.

    Of rows alike in id and text one stays, documents without words aside. Which of them, where other columns differ, is not
    defined. Rows are matched by id and text, after repeats of both are gone, so no text's copies meet in one task.
    """
    _, least, _ = classes(df, id_column, text, width, percent)
    words = F.coalesce(quoted(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    body, row = quoted(text), F.struct(*[quoted(c) for c in df.columns]).alias("row")
    rows = df.where(words).select(F.xxhash64(body, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), body).alias("k2"), quoted(id_column).cast("long").alias("id"), row)
    once = rows.groupBy("k1", "k2", "id").agg(F.first("row").alias("row")).alias("d")
    first = least.where("least.n > 0").select("least.v.k1", "least.v.k2", "least.id").alias("f")
    same = (F.col("d.k1") == F.col("f.k1")) & (F.col("d.k2") == F.col("f.k2")) & F.col("d.id").eqNullSafe(F.col("f.id"))
    kept = once.join(first, same, "left_semi").select(*[F.col("row")[c].alias(c) for c in df.columns])
    return kept.unionByName(df.where(~words))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("similar")
    return similar(docs, width=4, percent=85).select("doc_id", x["n_shingles"].alias("n_shingles"), x["component_id"].alias("component_id"))
