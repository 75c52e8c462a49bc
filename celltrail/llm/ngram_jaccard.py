"""Exact Jaccard join of word shingles by token-combination prefixes.

Texts with equal shingle sets are one class. A class orders its shingles: rare ones
first, by hash, then frequent ones. Two sets of Jaccard similarity t or more share
at least k shingles among the first ``n - ceil(t n) + k`` of each, for every k; here
k grows with the set. Rare shingles of that prefix are index keys by themselves;
frequent ones only in pairs. Two sets that share no rare shingle share k frequent
ones, so they share a pair; two that share a rare one are counted up, and must
reach k together with what frequent shingles they can share at most.

All pairs of a long text's frequent shingles would be too many. Of similar sets of n and more
shingles no more than ``d = (1 - t) n / t`` are not common, and each of them parts one pair of neighbours in the
common order. So among the first d + 2 common shingles two stand next to each other in
both, and they are within the first ``d + 2 + n - ceil(t n)`` of each: long sets are indexed by
the pairs of neighbours of that longer prefix, whose number grows with n. Sizes of similar sets
differ by one class of sizes at most; the first class of long sets has both kinds of keys,
so no link between short and long is lost.

Keys of few classes give pairs of classes; keys of many are linked in a chain to one
of them. Candidates connected so are one cluster, and each cluster is verified
exactly: the sets come together in one cell, or, of a large cluster, in a cell for
each pair of blocks; a cell counts all overlaps by matrix products and returns only
as many links as connect what is linked.

Which shingle counts as frequent is read from hashed counts over all documents,
whose size is bounded; whatever it is, no link is lost.

Defined cases: a null or empty text, or one of white space alone, has no shingle and
no link; a text of fewer words than a shingle is one shingle; repeated rows are one
class; rows of one id are one node, a null id is a component of null unless its
class holds another id; a very long text is one step of its own; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, prepare, steps, stored, table, utf8
from ._graph import components, roots
from ._words import mix, prefix_sums, span_hash, spans

U = np.uint64
#: Keys of at most so many classes give all pairs.
FEW = 128
#: Shingles from which on a set is long: neighbours are more keys than a prefix has, and fewer than pairs only there.
LONG = 20_000
#: Index keys that are sent on together.
SENT = 1 << 18
#: Classes in a block of a large cluster.
BLOCK = 1024
#: Bytes that one matrix of a cell takes.
CELL_BYTES = 1 << 26
LEAST_SLOTS, MOST_SLOTS, ROWS, STRIPES = 18, 23, 2, 32
#: Bytes of text that one task counts, at most, where there are more of them than tasks at once.
COUNTED_BYTES = 1 << 30
#: Bits of the filter of clustered ids, as a power of two; ids that one task marks.
MOST_BITS, MARKED = 27, 1 << 26

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Similarity:
    """A threshold as a fraction, so that comparisons are exact."""

    def __init__(self, over: int = 90, under: int = 100, words: int = 3):
        self.over, self.under, self.words = over, under, words

    def prefix(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many shingles the prefix has, and how many of them two similar sets share at least."""
        overlap = -(-self.over * n // self.under)
        k = np.minimum(2 + n // 50, overlap)
        return n - overlap + k, k

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Classes of sizes; those of similar sets differ by one at most."""
        return np.floor(np.log(np.maximum(n, 1)) / math.log(self.under / self.over) + 1e-9).astype(np.int64)

    def long(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which sets have pairs of neighbours as keys, and which of these are of the first class, with both kinds."""
        first = self.size_class(np.array([LONG]))[0]
        at = self.size_class(n)
        return at >= first, at == first

    def neighbours(self, n: np.ndarray) -> np.ndarray:
        """How many shingles the longer prefix has whose neighbours are paired."""
        return np.minimum(n, (self.under - self.over) * n // self.over + 2 + n - -(-self.over * n // self.under))

    def shared(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """How many shingles of both prefixes two similar sets have in common at least.

        What they share outside stands behind the prefix that ends first, so it is no
        more than what is left of one of them.
        """
        overlap = -(-self.over * (n + m) // (self.over + self.under))
        (p, k), (q, j) = self.prefix(n), self.prefix(m)
        return np.maximum(np.minimum(k, j), overlap - np.maximum(n - p, m - q))

    def linked(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.under * common >= self.over * (n + m - common)

    def sizes_fit(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.under * np.minimum(n, m) >= self.over * np.maximum(n, m)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers and hashes of all distinct shingles, by text and hash."""
    data = _LOWER[data]
    start, end, text = spans(_WORD, data, offsets)
    if not len(start):
        return text, np.zeros(0, U)
    h = span_hash(prefix_sums(data), start, end)
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    # a text of fewer words is one shingle of them all
    at = np.flatnonzero((np.arange(len(text)) - first[text] + words <= n[text]) | ((n[text] < words) & (np.arange(len(text)) == first[text])))
    length = np.minimum(n[text[at]], words)
    value = np.zeros(len(at), U)
    for k in range(words):
        has = length > k
        value[has] = mix(value[has] * U(0x9E3779B97F4A7C15) + h[at[has] + k] + U(k + 1))
    order = np.lexsort((value, text[at]))
    who, value = text[at][order], value[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
    return who[new], value[new]


def _stepped(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for lo, hi in steps(np.diff(offsets)):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, *shingles(data[a:b], offsets[lo : hi + 1] - a, words)


class Frequent:
    """Which shingles are frequent, from hashed counts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.bits = int(counts.shape[1]).bit_length() - 1
        mean = counts[0].sum() / counts.shape[1]
        self.least = mean + max(FEW // 2, 4 * math.sqrt(mean))

    @staticmethod
    def slots(value: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(value >> U(64 - bits)).astype(np.int64), (value & U((1 << bits) - 1)).astype(np.int64)]

    def __call__(self, value: np.ndarray) -> np.ndarray:
        a, b = self.slots(value, self.bits)
        return (self.counts[0][a] >= self.least) & (self.counts[1][b] >= self.least)


def frequent_shingles(df: DataFrame, s: Similarity) -> Frequent:
    """Hashed counts of the shingles of all texts; how wide they are follows the number of texts up to a bound."""
    texts, held = df.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, int(texts).bit_length() + 1))
    # every task sends all counters, so a task counts much text, but no more than so much
    wide = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-(held or 0) // COUNTED_BYTES))
    size, step = 1 << bits, (1 << bits) // STRIPES

    def piece(stripe: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["stripe", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, used = np.zeros((ROWS, size), np.int64), False
        for batch in batches:
            for *_, value in _stepped(batch.column(0), s.words):
                for k, slot in enumerate(Frequent.slots(value, bits)):
                    counts[k] += np.bincount(slot, minlength=size)
                used = used or len(value) > 0
        if used:
            for i in range(STRIPES):
                yield piece(i, np.ascontiguousarray(counts[:, i * step : (i + 1) * step]).astype(np.int32))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["counts"], np.int32).astype(np.int64)
                held[row["stripe"]] = held[row["stripe"]] + own if row["stripe"] in held else own
        for stripe, counts in held.items():
            yield piece(stripe, np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    shape = "stripe int, counts binary"
    parts = df.select("text").coalesce(wide).mapInArrow(count, shape)
    counts = np.zeros((ROWS, size), np.int32)
    for row in parts.repartition(STRIPES, "stripe").mapInArrow(total, shape).collect():  # of one size
        i = row["stripe"]
        counts[:, i * step : (i + 1) * step] = np.frombuffer(row["counts"], np.int32).reshape(ROWS, step)
    return Frequent(counts)


def prefixes(df: DataFrame, s: Similarity, frequent: Frequent) -> DataFrame:
    """(doc_id, n, set_a, set_b, rare, often): each text's set, known by two hashes, and its prefix shingles by class."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)  # bounded: see MOST_SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for lo, hi, who, value in _stepped(batch.column(1), s.words):
                n = np.bincount(who, minlength=hi - lo).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                own = np.zeros(len(value) + 1, U)
                np.cumsum(mix(value ^ U(0xA5A5A5A5)), out=own[1:])
                other = np.zeros(len(value) + 1, U)
                np.cumsum(mix(value + U(0x1234567)), out=other[1:])
                often = frequent(value)
                order = np.lexsort((value, often, who))
                place = np.arange(len(value)) - first[who]
                size, _ = s.prefix(n)
                size = np.where(s.long(n)[0], np.maximum(size, s.neighbours(n)), size)
                take = place < size[who]
                held = order[take[np.arange(len(order))]]
                h_who, h_often, h_value = who[held], often[held], value[held]
                rows = []
                for flag in (False, True):
                    mine = h_often == flag
                    cut = np.concatenate([[0], np.cumsum(np.bincount(h_who[mine], minlength=hi - lo))]) * 8
                    raw = pa.py_buffer(np.ascontiguousarray(h_value[mine]).tobytes())
                    rows.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), raw]))
                sums = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in (own, other)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), *rows],
                    names=["doc_id", "n", "set_a", "set_b", "rare", "often"],
                )

    return df.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, rare binary, often binary")


def keys(classes: DataFrame, s: Similarity) -> DataFrame:
    """(key, node, size): index keys of each class; ``size``: how many shingles it has, times 2^32, and how many frequent ones in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            p, k = s.prefix(n)
            long, both = s.long(n)
            out, whose, sent = [], [], 0
            # what two sets may share uncounted: of a long set all
            free = np.where(long, n, 0)

            def gathered() -> pa.RecordBatch:
                who = np.concatenate(whose)
                held = [pa.array(np.concatenate(out).view(np.int64)), pa.array(node[who]), pa.array((n << 32 | free)[who])]
                out.clear()
                whose.clear()
                return pa.RecordBatch.from_arrays(held, names=["key", "node", "size"])

            for i, (rare, often) in enumerate(zip(batch.column("rare").to_pylist(), batch.column("often").to_pylist(), strict=True)):
                a, b = np.frombuffer(rare, U), np.frombuffer(often, U)
                found = []
                if long[i]:
                    chain = np.concatenate([a, b])
                    found.append(mix(chain[:-1] * U(0x9E3779B97F4A7C15) + mix(chain[1:] + U(7))))
                    a, b = a[: p[i]], b[: max(0, int(p[i]) - len(a))]
                if not long[i] or both[i]:
                    if not long[i]:
                        free[i] = len(b)
                    found.append(a)
                    if len(b) >= k[i]:  # what shares no rare shingle shares k of these, so two of the first f - k + 2
                        few = b[: max(len(b) - int(k[i]) + 2, 0)] if k[i] >= 2 else b
                        if k[i] < 2:
                            found.append(mix(few))
                        else:
                            x, y = np.triu_indices(len(few), 1)
                            found.append(mix(few[x] * U(0x9E3779B97F4A7C15) + few[y]))
                whole = np.concatenate(found)
                out.append(whole)
                whose.append(np.full(len(whole), i))
                sent += len(whole)
                if sent >= SENT:
                    yield gathered()
                    sent = 0
            if out:
                yield gathered()

    return classes.select("node", "n", "rare", "often").mapInArrow(run, "key long, node long, size long")


@lru_cache(maxsize=FEW + 1)
def _pairs(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def candidates(index: DataFrame, s: Similarity) -> DataFrame:
    """(a, b): pairs of classes that share as many keys as similar ones must, or a key of many classes."""

    def paired(node: np.ndarray, n: np.ndarray, free: np.ndarray, at: np.ndarray, m: int):
        """All pairs of the groups of ``m`` that begin at ``at``."""
        x, y = _pairs(m)
        i, j = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
        fit = s.sizes_fit(n[i], n[j]) & (node[i] != node[j])
        i, j = i[fit], j[fit]
        need = s.shared(n[i], n[j]) - np.minimum(free[i], free[j])
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.maximum(need, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64) for _ in range(4)]
        hot: tuple[int, int] | None = None  # a key of many classes, and the class they are linked with

        def link(a: np.ndarray, b: int):
            a = a[a != b]
            return np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)

        def emit(columns, last: bool):
            nonlocal hot
            key, node, n, free = columns
            out = []
            if hot is not None:
                end = int(np.searchsorted(key, hot[0], side="right"))
                out.append(link(node[:end], hot[1]))
                key, node, n, free = key[end:], node[end:], n[end:], free[end:]
                if len(key) or last:
                    hot = None
            if not len(key):
                return out, [key, node, n, free]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(cut, len(key)))
            keep = 0
            if not last:  # the last key may go on
                if size[-1] > FEW:
                    hot = (int(key[-1]), int(node[cut[-1]]))
                else:
                    keep = int(size[-1])
                    cut, size = cut[:-1], size[:-1]
            for m in np.unique(size):
                at = cut[size == m]
                if m == 1:
                    continue
                if m <= FEW:
                    out.append(paired(node, n, free, at, int(m)))
                else:
                    out += [link(node[c : c + m], int(node[c])) for c in at]
            begin = len(key) - keep
            return out, [key[begin:], node[begin:], n[begin:], free[begin:]]

        def batch_of(out):
            a, b, need = (np.concatenate([o[q] for o in out]) for q in range(3))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], names=["a", "b", "need"])

        for batch in batches:
            key, node, size = (batch.column(q).to_numpy() for q in range(3))
            columns = [np.concatenate([k, x]) for k, x in zip(kept, (key, node, size >> 32, size & 0xFFFFFFFF), strict=True)]
            out, kept = emit(columns, False)
            if out:
                yield batch_of(out)
        out, _ = emit(kept, True)
        if out:
            yield batch_of(out)

    found = index.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, need int")
    counted = found.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("need").alias("need"))
    return counted.filter("common >= need").select("a", "b")


class Among:
    """A Bloom filter of ids, of a size that follows their number up to a bound: it lets others pass at times, and never stops one."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.bits, self.marks = bits, marks

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mix(ids.view(U) + U(0x51ED270B))
        return [(h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.places(ids, self.bits)
        return (self.marks[a] & self.marks[b]).astype(bool)


def among(nodes: DataFrame) -> Among:
    """The filter of a table's ids (its first column)."""
    n = int(nodes.count())
    bits = min(MOST_BITS, max(16, n.bit_length() + 4))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for place in Among.places(batch.column(0).to_numpy(), bits):
                marks[place] = 1
        if marks.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["marks"])

    marks = np.zeros(1 << bits, np.uint8)
    tasks = nodes.coalesce(max(8, n // MARKED))  # every task sends all marks
    for row in tasks.mapInArrow(mark, "marks binary").collect():
        marks |= np.unpackbits(np.frombuffer(row["marks"], np.uint8))
    return Among(bits, marks)


def cell_links(sets: list[np.ndarray], s: Similarity, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked sets; with ``left``, only pairs of one of the first ``left`` and one of the others."""
    n = np.array([len(x) for x in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), n)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    who, value = who[shared[value]], (np.cumsum(shared) - 1)[value[shared[value]]]
    width = int(shared.sum())
    rows = len(sets) if left is None else left
    base = 0 if left is None else left
    common = np.zeros((rows, len(sets) - base), np.float32)
    step = max(256, CELL_BYTES // (4 * max(1, len(sets))))
    order = np.argsort(value, kind="stable")
    who, value = who[order], value[order]
    for begin in range(0, width, step):
        x, y = np.searchsorted(value, [begin, begin + step])
        m = np.zeros((len(sets), min(step, width - begin)), np.float32)
        m[who[x:y], value[x:y] - begin] = 1
        common += m[:rows] @ m[base:].T
    i, j = np.nonzero(s.linked(common, n[:rows, None].astype(np.float64), n[None, base:].astype(np.float64)) & (common > 0))
    j = j + base
    keep = i < j
    return i[keep], j[keep]


def verified(clusters: DataFrame, docs: DataFrame, s: Similarity) -> DataFrame:
    """(a, b): links between classes, as many as connect what is linked in each cluster.

    ``clusters``: (node, cluster). The text of a class is that of the row whose id
    is the node.
    """
    size = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = (
        clusters.join(size, "cluster")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .select("node", "cluster", "block", F.explode(other).alias("other"))
        .select(
            "node",
            F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
            (F.col("block") == F.col("other")).alias("own"),
        )
    )

    inside = docs.sparkSession.sparkContext.broadcast(among(clusters.select("node")))  # bounded: see MOST_BITS

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(inside.value(batch.column(0).to_numpy())))

    held = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(those, "doc_id long, text string")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, node, side, own, found = None, [], [], True, []

        def close():
            if len(node) > 1:
                order = np.argsort(side, kind="stable")
                left = None if own else int(np.sum(np.array(side) == 0))
                if left is None or 0 < left < len(node):
                    i, j = cell_links([found[o] for o in order], s, left)
                    if len(i):
                        ids = np.array(node, np.int64)[order]
                        nodes, least = roots(ids[i], ids[j])
                        keep = nodes != least
                        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], names=["a", "b"])
            return None

        for batch in batches:
            sets: list[np.ndarray] = []
            for lo, hi, who, value in _stepped(batch.column(4), s.words):
                sets += np.split(value, np.cumsum(np.bincount(who, minlength=hi - lo))[:-1])
            for c, v, z, o, x in zip(*(batch.column(q).to_pylist() for q in range(4)), sets, strict=True):
                if c != cell:
                    if (done := close()) is not None:
                        yield done
                    cell, node, side, own, found = c, [], [], o, []
                node.append(v)  # rows of one id are entries of one node
                side.append(z)
                found.append(x)
        if (done := close()) is not None:
            yield done

    return (
        placed.join(held.withColumnRenamed("doc_id", "node"), "node")
        .select("cell", "node", "side", "own", "text")
        .repartition("cell")
        .sortWithinPartitions("cell", "node")
        .mapInArrow(link, "a long, b long")
    )


def joined(df: DataFrame, s: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(prefixes(docs, s, frequent_shingles(docs, s)), "prefixes")
    sets = rows.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    sets = stored(sets.filter("node IS NOT NULL"), "classes")
    # one row of each class: the one with its node's id
    first = rows.filter("n > 0").join(sets, ["set_a", "set_b"]).filter("doc_id = node").dropDuplicates(["set_a", "set_b"])
    near = candidates(keys(first, s), s)
    clusters = stored(components(near), "clusters").select("node", F.col("component").alias("cluster"))
    linked = components(stored(verified(clusters, docs, s), "verified"))
    named = rows.select("doc_id", "n", "set_a", "set_b").join(sets, ["set_a", "set_b"], "left")
    found = named.join(linked, "node", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents connected by links of similarity 0.9 or more of their three-word shingles."""
    return joined(table(spark, sf_dir, "documents"), Similarity(90, 100, 3))


def stage_ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): one with the least id, a null id last.

    Rows are told apart by a key of their own, so rows of one id and rows without an
    id are grouped by their texts like any others.
    """
    columns = docs.columns
    own = F.struct(*map(column, columns)).alias("own")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), own), "rows")
    texts = rows.select("_row", F.col("own.text").alias("text"))
    groups = joined(texts, Similarity(80, 100, 5), id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = groups.join(rows.select("_row", F.col("own.doc_id").alias("doc_id")), "_row").groupBy("component_id").agg(first.alias("least"))
    return rows.join(kept.select("least._row"), "_row", "left_semi").select("own.*")
