"""Best-fit packing of tokenised documents by exact-complement hashing.

Each text becomes token ids and an end mark; a document longer than a sequence is
cut into pieces of the full length, of which the first may be shorter. Packing
needs nothing but how many pieces there are of each length: at most
``capacity`` numbers, whatever the size of the table. On these counts the driver
makes a plan: from the longest length down, it fills what is left of a sequence
exactly with one piece, with two or with three (indexed by the sum of their
lengths, under the counts still available), and what finds no exact complement
takes the longest pieces that fit. The plan says which sequence the r-th piece of
a length goes to; executors number their pieces by length and look their places up.

Defined cases: a null or empty text is one end mark; a very long text is as many pieces as
it needs, and one without a break is merged as a single word; pieces of equal length are
interchangeable, so which of them stands in which sequence is free; repeated rows are packed as
often as they stand there; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import prepare, steps, stored, table
from ._words import distinct, mix, powers, ranges

U = np.uint64
CAPACITY = 2048
END = 0
#: Words whose ids a Python worker remembers, at most.
REMEMBERED = 400_000
#: Code points whose class this module knows for sure; texts with others go through the tokenizer as they are.
_KNOWN = 0x530
_L, _N, _S, _O, _UNKNOWN = range(5)
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]  # fixed values: white space below _KNOWN


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, _UNKNOWN, np.uint8)
    for c in range(_KNOWN):
        s = chr(c)
        if regex.match(r"\p{Cn}", s):
            continue
        out[c] = _S if c in _SPACES else _L if regex.match(r"\p{L}", s) else _N if regex.match(r"\p{N}", s) else _O
    for c in (0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC):  # fixed values: usual punctuation
        out[c] = _O
    return out


#: Larger code points share a letter: texts that hold them are tokenised as a whole.
_LAST = 0x2100


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(2).integers(0, 1 << 64, _LAST + 1, dtype=U)


class Tokenizer:
    """Ids of a byte-level BPE file, word by word: each distinct word of a step is merged once."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer as Whole

        self.whole = Whole.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known: dict[int, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and how many each text has."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        kinds = _classes()[points]
        odd = np.zeros(len(texts), bool)
        if (kinds == _UNKNOWN).any():
            odd[np.unique(np.searchsorted(offsets, np.flatnonzero(kinds == _UNKNOWN), side="right") - 1)] = True
        for s in self.special:
            if s in joined:
                odd |= np.fromiter((s in t for t in texts), bool, len(texts))
        start = _word_starts(points, kinds, offsets)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(points))
        words, per_text = self._words(joined, points, begin, end, offsets)
        if not odd.any():
            return words, per_text
        parts = np.split(words, np.cumsum(per_text)[:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _words(self, joined, points, begin, end, offsets):
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, U)
        np.cumsum(_letters()[np.minimum(points, _LAST)] * up[: len(points)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
        codes, first = distinct(hashes)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        keys = hashes[first].tolist()
        found = list(map(known.get, keys))
        for k, ids in enumerate(found):
            if ids is None:
                word = joined[begin[first[k]] : end[first[k]]].encode("utf-8", "replace")
                found[k] = known[keys[k]] = array("I", self.merge(word)).tobytes()
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        at = np.cumsum(lengths) - lengths
        out = flat[ranges(at[codes], lengths[codes])] if len(codes) else flat
        total = np.concatenate([[0], np.cumsum(lengths[codes])])
        bounds = np.searchsorted(begin, offsets)
        return out, np.diff(total[bounds])


def _word_starts(points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words begin into which the vocabulary's pattern splits texts.

    Runs of one class are words; a space before a run of another class belongs to
    it, a longer white space gives up its last character; an apostrophe that begins
    a word takes one of the seven English endings with it.
    """
    n = len(points)
    start = np.ones(n, bool)
    if not n:
        return start
    start[1:] = kinds[1:] != kinds[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    is_first = np.zeros(n + 4, bool)
    is_first[offsets] = True
    start[first] = True
    after = np.flatnonzero((kinds[1:] != _S) & (kinds[:-1] == _S) & ~is_first[1:n]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    p = np.flatnonzero((points == 39) & start)
    p = p[p + 1 < n]
    p = p[(kinds[p + 1] == _L) & ~is_first[p + 1]]
    if len(p):
        a = points[p + 1]
        b = np.where((p + 2 < n) & ~is_first[p + 2], points[np.minimum(p + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(p), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        took = np.where(one, 1, np.where(two, 2, 0))
        p, took = p[took > 0], took[took > 0]
        start[p + 1] = False
        rest = p + 1 + took
        start[rest[rest < n]] = True
    return start


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, piece number, start and length of every piece."""
    count = np.maximum(1, -(-lengths // capacity))
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = ranges(np.zeros(len(lengths), np.int64), count)
    head = lengths - (count - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def plan(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """Sequences to make from ``histogram[length]`` pieces: lengths in order, and how many such sequences."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    made: list[tuple[list[int], int]] = []

    def take(items: list[int], most: int | None = None) -> int:
        need = {x: items.count(x) for x in items}
        k = min(left[x] // c for x, c in need.items())
        k = k if most is None else min(k, most)
        if k > 0:
            for x, c in need.items():
                left[x] -= k * c
            made.append((items, int(k)))
        return int(k)

    def pair(total: int, most: int, taken: list[int]) -> tuple[int, int] | None:
        """Two lengths of that sum, available beside those ``taken``, the longer at most ``most`` and as long as can be."""
        free = left.copy()
        for x in taken:
            free[x] -= 1
        a = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        ok = (free[a] > 0) & (free[total - a] > np.where(a * 2 == total, 1, 0))
        return (int(a[k := int(np.argmax(ok))]), int(total - a[k])) if len(a) and ok.any() else None

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if left[length] and not gap:
            take([length])
        if left[length] and gap and gap <= length:
            take([length, gap])
        while left[length] and gap >= 2 and (found := pair(gap, length, [length])):
            take([length, *found])
        blocked: set[int] = set()
        while left[length] and gap >= 3:
            for a in np.flatnonzero(left[: min(gap - 2, length) + 1])[::-1].tolist():
                if a in blocked or 3 * a < gap:
                    continue
                if left[a] > (a == length) and (found := pair(gap - a, a, [length, a])):
                    take([length, a, *found])
                    break
                blocked.add(a)
            else:
                break
        while left[length]:
            items, free = [length], gap
            while free > 0:
                have = np.flatnonzero(left[1 : free + 1]) + 1
                have = [x for x in have[::-1].tolist() if left[x] > items.count(x)][:1]
                if not have:
                    break
                items.append(have[0])
                free -= have[0]
            take(items)
    return made


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, made: list[tuple[list[int], int]], capacity: int):
        used = np.zeros(capacity + 1, np.int64)
        rows, base = [], 0
        for items, count in made:
            at = 0
            for x in items:
                rows.append((x, used[x], base, at))
                used[x] += count
                at += x
            base += count
        rows = sorted(rows)
        self.length, self.rank, self.base, self.at = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.sequences = base
        self.shift = int(used.max()) + 1 if len(used) else 1
        self.keys = self.length * self.shift + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset."""
        k = np.searchsorted(self.keys, length * self.shift + rank, side="right") - 1
        return self.base[k] + rank - self.rank[k], self.at[k]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its number ``nth`` among those of its length in its partition ``part``."""
    prepare(df.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part, tok = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId(), tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in steps(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 20):
                ids, per = tok.encode(texts[lo:hi])
                ends = np.cumsum(per)
                ids = np.insert(ids, ends, END)
                doc, piece, start, length = cut(per + 1, capacity)
                first = (np.concatenate([[0], ends[:-1]]) + np.arange(hi - lo))[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run = length[order]
                nth = np.empty(len(run), np.int64)
                nth[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, PIECES)


def packed(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents with the sequence and the place there of each."""
    cuts = stored(pieces(df, path, capacity, id_col, text_col), "pieces")
    by_part = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = stored(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    places = Places(plan(histogram), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = places.find(length, rank)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # the counts grow with the partitions: both sides are dealt out
    ranked = cuts.join(by_part.select("part", "length", "before").hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stage_best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
