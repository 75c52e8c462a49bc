"""Removal of repeated passages with suffix arrays built by difference covers.

Every byte covered by a string of ``length`` bytes that starts anywhere else as
well is removed. The suffix array is built in parts that need nothing of each other:

* Each window of ``length`` bytes has an anchor, the least hash among its grams of
  ``gram`` bytes (the leftmost of equal ones). Equal windows have equal anchors,
  so they meet in the part of that anchor, and an anchor that stands once in the
  corpus has no repeated window. An anchor's context is the text of all its windows.
* Equal contexts of an anchor are counted before anything is moved; every window of a
  context that stands twice is repeated. Only anchors with several contexts go on,
  each context once, with its text.
* Contexts of whole anchors fill a buffer, whose suffixes are sorted by a
  difference-cover algorithm (:func:`suffix_array`): suffixes at places not divisible
  by three are sorted by triples, named, and by recursion on the names; the others
  are sorted by their first symbol and the rank behind it, and merged. Neighbours in
  the array that share ``length`` bytes, compared byte by byte, are repeated windows.
* An anchor of more contexts than a buffer takes is split by the windows themselves:
  their 128-bit hashes are counted, which gives the same answer.

A cover of every suffix of the corpus is not sorted as a whole: each of its places would
move several times with its name, which is many times the text. Parts hold only
what can repeat.

Equal texts are known by 128-bit hashes, as are contexts of an anchor. No key is a
task's burden: a text, anchor or context that holds more than one of :data:`SHARES`
parts of its table is hot, so there are at most as many as that; hot texts enter once,
with the weight of two, and hot anchors and contexts are joined under a salt.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; a text that
stands twice loses all if it has ``length`` bytes; rows of one id are separate texts;
very long texts are steps of their own; an empty table gives no rows; other columns
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, lean, prepare, steps, stored, table, utf8
from ._words import mix, prefix_sums, ranges, span_hash

U = np.uint64


@dataclass(frozen=True)
class Grain:
    """Bytes of a repeated string, and of the grams whose hashes choose its anchor."""

    length: int
    gram: int


#: What the query's contract asks for.
LONG = Grain(400, 64)
#: What the pipeline's stage removes: a passage of fifty short words and their blanks is longer.
PASSAGE = Grain(200, 48)
#: Symbols of a buffer whose suffixes are sorted at once; three of its names fit into 63 bits.
BUFFER = (1 << 21) - 8
#: Contexts of an anchor beyond which its windows are counted instead.
MANY = 1500
_BITS = 21
#: Neighbours of a suffix array that are compared at once.
COMPARED = 1 << 16
#: Bytes of text whose windows are hashed at once: a step holds some ninety bytes of numbers for each.
STEP = 1 << 18
#: Seed of the second hash of contexts and windows.
OTHER = 0xC0FFEE
#: A key with more than one of so many parts of its rows is hot; salts that a hot key is dealt over.
SHARES, SALTS = 2048, 64


# --- suffix arrays ------------------------------------------------------------------------------


def _named(s: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, int]:
    """The order of the triples at the places ``sample`` as names from 0, and how many differ."""
    triple = s[sample].astype(np.int64)
    for k in (1, 2):
        triple <<= _BITS
        triple |= s[sample + k]
    order = np.argsort(triple)
    triple = triple[order]
    new = np.zeros(len(order), np.int32)
    new[1:] = triple[1:] != triple[:-1]
    name = np.empty(len(order), np.int32)
    name[order] = np.cumsum(new, dtype=np.int32)
    return name, int(name[order[-1]]) + 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``symbols`` (from 1 to fewer than 2^21) in order.

    Places and names take 32 bits, and each level of the recursion holds its symbols alone.
    """
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int32)
    s = np.zeros(n + 4, np.int32)
    s[:n] = symbols
    del symbols
    # places 1 mod 3 and 2 mod 3; one place behind the end belongs to the cover
    sample = np.concatenate([np.arange(1, n + 1, 3, np.int32), np.arange(2, n + 1, 3, np.int32)])
    ones = (n + 2) // 3
    name, distinct = _named(s, sample)
    if distinct == len(sample):
        order = np.empty(len(name), np.int32)
        order[name] = np.arange(len(name), dtype=np.int32)
    else:
        # the names of all places 1 mod 3, then of those 2 mod 3: a suffix of these is a suffix of the text
        names = [np.concatenate([name[:ones], np.array([-1], np.int32), name[ones:]]) + np.int32(2)]
        del name, sample
        order = suffix_array(names.pop())
        order = order[order != ones]
        order -= order > ones
        sample = np.concatenate([np.arange(1, n + 1, 3, np.int32), np.arange(2, n + 1, 3, np.int32)])
    by_rank = sample[order]
    del sample, order
    rank = np.zeros(n + 4, np.int32)
    rank[by_rank] = np.arange(1, len(by_rank) + 1, dtype=np.int32)

    def key(at: np.ndarray, symbols: int) -> np.ndarray:
        """So many symbols from each place and the rank behind them."""
        out = s[at].astype(np.int64)
        for k in range(1, symbols):
            out <<= _BITS
            out |= s[at + k]
        out <<= _BITS
        out |= rank[at + symbols]
        return out

    rest = np.arange(0, n, 3, np.int32)
    short = key(rest, 1)
    order = np.argsort(short, kind="stable")
    rest, short = rest[order], short[order]
    del order
    is_one = by_rank % 3 == 1
    place = np.arange(len(rest), dtype=np.int32)  # of those in ``rest`` among all
    before = np.empty(len(by_rank), np.int32)  # how many of these stand before each of the others
    one_key = key(by_rank[is_one], 1)
    place += np.searchsorted(one_key, short).astype(np.int32)
    before[is_one] = np.searchsorted(short, one_key)
    del short, one_key
    long, two_key = key(rest, 2), key(by_rank[~is_one], 2)
    del s, rank
    place += np.searchsorted(two_key, long).astype(np.int32)
    before[~is_one] = np.searchsorted(long, two_key)
    del long, two_key
    out = np.empty(len(rest) + len(by_rank), np.int32)
    out[place] = rest
    before += np.arange(len(by_rank), dtype=np.int32)
    out[before] = by_rank
    return out[out < n]


def repeated_windows(texts: list[bytes], length: int = LONG.length) -> list[np.ndarray]:
    """For each text, which windows of ``length`` bytes start elsewhere in the texts as well."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    data = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
    symbols = data[:total].astype(np.int32) + np.int32(1)
    symbols[starts + sizes] = 257 + np.arange(len(texts))  # an end of its own for each text
    windows = np.maximum(sizes - length + 1, 0)
    is_window = np.zeros(total, bool)
    is_window[ranges(starts, windows)] = True
    order = suffix_array(symbols)
    del symbols
    order = order[is_window[order]]
    words = np.ndarray((total + 1,), np.uint64, data, strides=(1,))
    hit = np.zeros(total, bool)
    for lo in range(0, len(order) - 1, COMPARED):
        p, q = order[lo : lo + COMPARED], order[lo + 1 : lo + 1 + COMPARED]
        p = p[: len(q)]
        for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(0):
            same = words[p + at] == words[q + at]
            p, q = p[same], q[same]
        for at in range(length) if length < 8 else ():
            same = data[p + at] == data[q + at]
            p, q = p[same], q[same]
        hit[p] = True
        hit[q] = True
    return [hit[a : a + w] for a, w in zip(starts, windows, strict=True)]


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


# --- anchors ------------------------------------------------------------------------------------


def _least(value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every ``width`` numbers in a row: least of those up to each place's block end, and of those from its block's start."""
    padded = np.full(-(-len(value) // width) * width, ~U(0), U)
    padded[: len(value)] = value
    rows = padded.reshape(-1, width)
    return np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel(), np.minimum.accumulate(rows, axis=1).ravel()


def leftmost_least(value: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` numbers from ``start``: the place of its least, the leftmost of equals."""
    low = U((1 << int(len(value)).bit_length()) - 1)
    behind, ahead = _least((value & ~low) | np.arange(len(value)).astype(U), width)
    place = (np.minimum(behind[start], ahead[start + width - 1]) & low).astype(np.int64)
    # the place took the lowest bits' room: where these would have decided, the whole numbers do
    behind, ahead = _least(value, width)
    for w in np.flatnonzero(value[place] != np.minimum(behind[start], ahead[start + width - 1])).tolist():
        place[w] = start[w] + int(np.argmin(value[start[w] : start[w] + width]))
    return place


def anchors(data: np.ndarray, offsets: np.ndarray, grain: Grain = LONG) -> tuple[np.ndarray, ...]:
    """Of texts on end: text number, anchor hash, context hashes (two), first window, windows, anchor's place from there."""
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - grain.length + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    n = len(data)
    sums = prefix_sums(data)
    at = np.arange(n - grain.gram + 1)
    value = span_hash(sums, at, at + grain.gram)
    start = ranges(offsets[:-1], windows)
    anchor = leftmost_least(value, start, grain.length - grain.gram + 1)
    text = np.repeat(np.arange(len(sizes)), windows)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, anchor, text = start[first], anchor[first], text[first]
    end = begin + count - 1 + grain.length
    context = span_hash(sums, begin, end)
    other = span_hash(prefix_sums(data, OTHER), begin, end)
    shift = anchor - begin
    return text, value[anchor].view(np.int64), mix(context + shift.astype(U)).view(np.int64), other.view(np.int64), begin - offsets[text], count, shift


ANCHORS = "h1 long, h2 long, weight int, anchor long, c1 long, c2 long, lo int, n int"


def keyed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the text's two hashes ``h1`` and ``h2``; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(text, F.lit(1))})


def anchored(texts: DataFrame, grain: Grain) -> DataFrame:
    """The anchors of ``texts`` (h1, h2, weight, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for lo, hi in steps(np.diff(offsets), STEP):
                a, b = offsets[lo], offsets[hi]
                text, value, c1, c2, begin, count, _ = anchors(data[a:b], offsets[lo : hi + 1] - a, grain)
                if len(text):
                    who = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(who) for k in range(3)], pa.array(value), pa.array(c1), pa.array(c2),
                         pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))],
                        names=["h1", "h2", "weight", "anchor", "c1", "c2", "lo", "n"],
                    )

    return texts.select("h1", "h2", "weight", "text").mapInArrow(lean(run), ANCHORS)


def _context_texts(texts: DataFrame, wanted: DataFrame, grain: Grain) -> DataFrame:
    """``wanted`` contexts (anchor, c1, c2, copies, h1, h2, lo, n) with their bytes; of equal texts one at least is cut."""
    per_text = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "c1", "c2", "copies", "lo", "n", "many")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "c1", "c2", "copies", "lo", "n", "many", "h1", "h2", "bytes")}
            for h1, h2, text, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (h1, h2) == last:
                    continue
                last = (h1, h2)
                raw = text.encode("utf-8")
                for f in found:
                    for k in ("anchor", "c1", "c2", "copies", "lo", "n", "many"):
                        out[k].append(f[k])
                    out["h1"].append(h1)
                    out["h2"].append(h2)
                    out["bytes"].append(raw[f["lo"] : f["lo"] + f["n"] - 1 + grain.length])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return (
        texts.join(per_text, ["h1", "h2"])
        .select("h1", "h2", "text", "found")
        .mapInArrow(lean(run), "anchor long, c1 long, c2 long, copies long, lo int, n int, many boolean, h1 long, h2 long, bytes binary")
    )


def _sorted_spans(contexts: DataFrame, grain: Grain) -> DataFrame:
    """(h1, h2, start, windows): repeated windows of contexts that stand once, by suffix arrays of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # whole anchors
        group: dict[tuple, tuple] = {}  # contexts of the anchor being read

        def close() -> int:
            if len(group) > 1:
                done.extend(group.values())
            group.clear()
            return sum(len(d[-1]) + 1 for d in done)

        def flush() -> pa.RecordBatch | None:
            if not done:
                return None
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for (h1, h2, lo, copies, _), hit in zip(done, repeated_windows([d[-1] for d in done], grain.length), strict=True):
                if copies == 1 and hit.any():
                    start, count = runs(hit)
                    for column, v in zip(rows, (np.full(len(start), h1), np.full(len(start), h2), start + lo, count), strict=True):
                        column.append(v)
            done.clear()
            if not rows[0]:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(r).astype(np.int64)) for r in rows], names=["h1", "h2", "start", "windows"])

        anchor, filled = None, 0
        for batch in batches:
            for a, c1, c2, copies, lo, h1, h2, raw in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if a != anchor:
                    if (filled := close()) >= BUFFER - MANY * (2 * grain.length + 1):
                        if (out := flush()) is not None:
                            yield out
                    anchor = a
                group[c1, c2] = (h1, h2, lo, copies, raw)
        close()
        if (out := flush()) is not None:
            yield out

    return (
        contexts.filter(~F.col("many"))
        .select("anchor", "c1", "c2", "copies", "lo", "h1", "h2", "bytes")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(lean(run), "h1 long, h2 long, start long, windows long")
    )


def _counted_spans(contexts: DataFrame, grain: Grain) -> DataFrame:
    """The same for anchors of many contexts, by counting the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(6)
            offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(raw) else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            for lo, hi in steps(np.diff(offsets), STEP):
                a, b = offsets[lo], offsets[hi]
                sums = prefix_sums(data[a:b])
                count = np.diff(offsets[lo : hi + 1]) - grain.length + 1
                at = ranges(offsets[lo:hi] - a, count)
                who = np.repeat(np.arange(lo, hi), count)
                whole = span_hash(sums, at, at + grain.length)
                other = span_hash(prefix_sums(data[a:b], OTHER), at, at + grain.length)
                place = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), *[batch.column(k).take(place) for k in range(5)],
                     pa.array(ranges(np.zeros(hi - lo, np.int64), count).astype(np.int32)).cast(pa.int32())],
                    names=["w1", "w2", "h1", "h2", "lo", "copies", "anchor", "at"],
                )

    one = contexts.filter("many").dropDuplicates(["anchor", "c1", "c2"])
    windows = one.select("h1", "h2", "lo", "copies", "anchor", "n", "bytes").mapInArrow(
        lean(run), "w1 long, w2 long, h1 long, h2 long, lo int, copies long, anchor long, at int"
    )
    # what stands once in the group of equal windows, and what it stands beside
    group = windows.groupBy("w1", "w2", "anchor").agg(F.count("*").alias("times")).filter("times > 1")
    return dealt(windows.filter("copies = 1"), group, ["w1", "w2", "anchor"], "times", "h1", "left_semi").select(
        "h1", "h2", (F.col("lo") + F.col("at")).cast("long").alias("start"), F.lit(1).cast("long").alias("windows")
    )


def dealt(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, with its ``size``), the rows of hot keys dealt over salts by ``by``.

    A key is hot if its size is more than one of :data:`SHARES` parts of all sizes, so
    fewer than that are hot, whatever the table: these alone are broadcast.
    """
    groups = stored(groups, "groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * SHARES > F.lit(total)
    hot = groups.filter(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    own = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return own.join(groups.withColumn("_salt", F.explode(every)).drop(size), [*keys, "_salt"], how).drop("_salt")


def copies(texts: DataFrame, grain: Grain) -> tuple[DataFrame, DataFrame]:
    """(h1, h2) of texts that stand more than once, and of those among them that are hot (fewer than :data:`SHARES`)."""
    long = texts.filter(F.octet_length("text") >= grain.length)
    found = stored(long.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "copied")
    total = found.agg(F.sum("n")).first()[0] or 0
    return found.select("h1", "h2"), found.filter(F.col("n") * SHARES > F.lit(total)).select("h1", "h2")


def spans(texts: DataFrame, copied: DataFrame, hot: DataFrame, grain: Grain) -> DataFrame:
    """(h1, h2, whole, found): for each text that loses bytes, whether it loses all, or else its repeated windows.

    ``texts``: (h1, h2, text) of every row; ``copied``, ``hot``: of :func:`copies`.
    """
    prepare(texts.sparkSession)
    long = texts.select("h1", "h2", "text").filter(F.octet_length("text") >= grain.length)
    few = F.broadcast(hot)
    once = long.join(few, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    long = long.join(few, ["h1", "h2"], "left_anti").withColumn("weight", F.lit(1)).unionByName(once.withColumn("weight", F.lit(2)))
    rows = stored(anchored(long, grain), "anchors")
    twice = rows.groupBy("anchor").agg(F.sum("weight").alias("times"))
    near = stored(dealt(rows, twice.filter("times > 1"), ["anchor"], "times", "c1"), "repeated-anchors")
    first = [F.first(c).alias(c) for c in ("h1", "h2", "lo", "n")]
    contexts = stored(near.groupBy("anchor", "c1", "c2").agg(F.sum("weight").alias("copies"), *first), "contexts")
    groups = contexts.groupBy("anchor").agg(F.count("*").alias("members"), F.min("copies").alias("least"))
    open_ = groups.filter("members > 1 AND least = 1").select("anchor", "members", (F.col("members") > MANY).alias("many"))
    wanted = dealt(contexts, open_, ["anchor"], "members", "c1")
    cut = stored(_context_texts(long, wanted, grain), "context-texts")
    again = contexts.filter("copies > 1").select("anchor", "c1", "c2", "copies")
    same = dealt(near, again, ["anchor", "c1", "c2"], "copies", "h1", "left_semi").select(
        "h1", "h2", F.col("lo").cast("long").alias("start"), F.col("n").cast("long").alias("windows")
    )
    parts = same.union(_sorted_spans(cut, grain)).union(_counted_spans(cut, grain)).join(copied, ["h1", "h2"], "left_anti")
    per_text = parts.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    none = F.array().cast(FOUND)
    return copied.select("h1", "h2", F.lit(True).alias("whole"), none.alias("found")).union(
        per_text.select("h1", "h2", F.lit(False).alias("whole"), "found")
    )


FOUND = "array<struct<start:bigint,windows:bigint>>"


def with_spans(rows: DataFrame, grain: Grain) -> DataFrame:
    """``rows`` (with h1, h2, text) with ``whole`` and ``found``: what each row's text loses, null if nothing."""
    copied, hot = copies(rows, grain)
    lost = stored(spans(rows, copied, hot, grain), "spans")
    all_ = rows.join(F.broadcast(hot), ["h1", "h2"], "left_semi")  # copied texts: no need to meet what they lose
    rest = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(lost, ["h1", "h2"], "left")
    return rest.unionByName(all_.withColumns({"whole": F.lit(True), "found": F.array().cast(FOUND)}))


def removed(size: int, found: list[dict] | None, whole: bool | None, grain: Grain) -> list[tuple[int, int]]:
    """The maximal runs of bytes to remove, as starts and ends."""
    if whole:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for begin, end in sorted((f["start"], f["start"] + f["windows"] - 1 + grain.length) for f in found or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    """What is left."""
    parts, at = [], 0
    for begin, end in gone:
        parts.append(raw[at:begin])
        at = end
    return b"".join([*parts, raw[at:]])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings of 400 bytes cover."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, whole, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8")
                gone = removed(len(raw), found, whole, LONG)
                rows.append((doc, len(raw), sum(e - b for b, e in gone), len(gone), hashlib.sha256(kept(raw, gone)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return (
        with_spans(docs, LONG)
        .select("doc_id", "text", "whole", "found")
        .mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings of 200 bytes cover; one of which nothing is left goes.

    A character that loses a part of its bytes is lost; ``n_chars``, if there, follows the text.
    """
    columns, schema = docs.columns, docs.schema
    place, count = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    own = keyed(docs.select(F.struct(*map(column, columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keep, texts = batch.column(0), [], []
            for k, (text, whole, found) in enumerate(zip(*(batch.column(q).to_pylist() for q in (1, 2, 3)), strict=True)):
                raw = text.encode("utf-8")
                gone = removed(len(raw), found, whole, PASSAGE)
                left = kept(raw, gone).decode("utf-8", "ignore")
                if left or not gone:
                    keep.append(k)
                    texts.append(left)
            out = [c.take(pa.array(keep, pa.int64())) for c in row.flatten()]
            out[place] = pa.array(texts, pa.string())
            if count is not None:
                out[count] = pa.array([len(t) for t in texts], pa.int64()).cast(out[count].type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return with_spans(own, PASSAGE).select("row", "text", "whole", "found").mapInArrow(lean(run), schema)
