"""SentencePiece encoding and decoding with weighted finite-state transducers.

Three transducers (:class:`Fst`) are compiled from a model file: the normaliser (spaces to the
space mark, a mark in front, runs of spaces to one if the model says so), the lexicon (a
trie of pieces, closed, whose final states give a piece's id) and the byte fallback (a
character that no piece is to the ids of its bytes). An input is a chain of characters.
Composed with the normaliser it is another chain; composed with the closure of lexicon and
fallback it is a path graph whose arcs are pieces (:meth:`Encoder.arcs`), and its encoding
is that graph's shortest path in the tropical semiring (:meth:`Encoder.shortest`).

A unigram model's arcs weigh what its scores say. A merge model (BPE) orders merges, and
no weight of single pieces gives its encodings. Its graph has a state for each place and the
piece that ends there: going on from one piece to the next weighs nothing if merging the
characters of both leaves just these two pieces, and infinity otherwise. The merge encoding is
the one path of finite weight, as merges of a whole text do in each pair of
neighbours what they do in the pair alone.

If no piece has a space mark behind another character, no arc crosses the beginning of a
word; then a text is composed word by word, each distinct word once as long as it is
remembered, and a very long text costs what its words cost. A normaliser with a table of
character maps is refused: no such model is at hand to test one with.

Defined cases: a null or empty text has no id and decodes to the empty text; repeated
rows encode alike; a model
without byte pieces gives its unknown id, which decodes to U+2047; other columns take no
part, but one of the name that is added gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, others, prepare, steps, table, unused

MARK = "▁"
#: Words, and pairs of pieces, that a Python worker remembers, at most.
REMEMBERED, REMEMBERED_PAIRS = 600_000, 400_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = number(at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.merges, self.front, self.collapse, charsmap = False, True, True, b""
        for field, value in _fields(open(path, "rb").read()):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 2:
                self.merges = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.front, self.collapse = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap:
            raise ValueError("a normaliser with a table of character maps is not supported")
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (NORMAL, USER)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}


#: Any character without an arc of its own; and, at the end of an output, the character that was read.
OTHER, SELF = "", "\0"


@dataclass
class Fst:
    """A transducer of characters: ``arcs[state][character]`` is (next state, output).

    ``final[state]``: an output (a piece's id) and its weight.
    """

    arcs: list[dict[str, tuple[int, str]]]
    final: dict[int, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        # a state that nothing leaves maps what is left of a text at once
        self.loops = [
            [(c, out) for c, (_, out) in arcs.items() if c] if arcs.get(OTHER) == (k, SELF) and all(to == k and c not in out for a in [arcs] for c in a if c for to, out in a.values()) else None
            for k, arcs in enumerate(self.arcs)
        ]

    def applied(self, text: str) -> str:
        """The output of composing a text with the transducer, where one path only is possible."""
        state, out = 0, []
        for at, c in enumerate(text):
            if self.loops[state] is not None:
                rest = text[at:]
                for read, made in self.loops[state]:
                    rest = rest.replace(read, made)
                out.append(rest)
                break
            arcs = self.arcs[state]
            if c in arcs:
                state, made = arcs[c]
                out.append(made)
            else:
                state, made = arcs[OTHER]
                out.append(made[:-1] + c)
        return "".join(out)


def normaliser(model: Model) -> Fst:
    """States: nothing read, inside, and a gap that becomes a mark if something follows."""
    front = MARK if model.front else ""
    if model.collapse:
        return Fst([{" ": (0, ""), OTHER: (1, front + SELF)}, {" ": (2, ""), OTHER: (1, SELF)}, {" ": (2, ""), OTHER: (1, MARK + SELF)}])
    return Fst([{" ": (1, front + MARK), OTHER: (1, front + SELF)}, {" ": (1, MARK), OTHER: (1, SELF)}])


def lexicon(pieces: dict[str, int], scores: list[float]) -> Fst:
    """The trie of pieces; back from a final state to the first is its closure."""
    arcs: list[dict] = [{}]
    final = {}
    for piece, k in pieces.items():
        state = 0
        for c in piece:
            if c not in arcs[state]:
                arcs.append({})
                arcs[state][c] = (len(arcs) - 1, "")
            state = arcs[state][c][0]
        final[state] = (k, -scores[k])
    return Fst(arcs, final)


class Encoder:
    """Normaliser, lexicon and byte fallback of a model, and their composition with an input."""

    def __init__(self, model: Model):
        self.model = model
        self.known = frozenset(model.ids.values())
        self.beyond = 10.0 - min(model.scores, default=0.0)  # more than any piece weighs
        self.outputs = [
            bytes([model.byte_of[k]]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"" if kind == CONTROL else piece.encode()
            for k, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True))
        ]
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        pieces = dict(model.ids)
        if model.merges:
            for piece in self._order():
                del pieces[piece]
        self.normaliser, self.lexicon = normaliser(model), lexicon(pieces, model.scores)
        self.next = [{c: to for c, (to, _) in arcs.items()} for arcs in self.lexicon.arcs]
        self.final = [self.lexicon.final.get(k) for k in range(len(self.next))]
        self.done = [f[0] if f else -1 for f in self.final]
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces)

    def _order(self) -> list[str]:
        """Each piece's place in the order of merges and the two pieces it is merged from; returns the pieces that merging never makes."""
        model, never = self.model, []
        self.place = [0] * len(model.pieces)
        self.halves: list[tuple[int, int] | None] = [None] * len(model.pieces)
        scores = sorted({-model.scores[k] for k in model.ids.values()})
        where = {score: n + 1 for n, score in enumerate(scores)}  # merges of one score come from left to right
        for k in model.ids.values():
            if len(model.pieces[k]) > 1:
                self.place[k] = where[-model.scores[k]]
                parts = self.merged(model.pieces[k], least=2)
                if len(parts) == 2 and all(x in model.ids for x in parts):
                    self.halves[k] = (model.ids[parts[0]], model.ids[parts[1]])
                else:
                    never.append(model.pieces[k])
        return never

    def normalised(self, text: str) -> str:
        """The text composed with the normaliser."""
        return self.normaliser.applied(text)

    def fallback(self, c: str) -> tuple[int, ...]:
        """The byte fallback's arc for a character: the ids of its bytes."""
        return tuple(self.model.bytes.get(b, self.model.unknown) for b in c.encode("utf-8", "replace"))

    def arcs(self, word: str, at: int) -> list[tuple[int, tuple[int, ...], float]]:
        """Arcs that leave a place of the composed graph: where they end, their ids and weight."""
        state, end, found, size, out = 0, at, False, len(word), []
        following, final = self.next, self.final
        while end < size:
            to = following[state].get(word[end])
            if to is None:
                break
            state, end = to, end + 1
            if (done := final[state]) is not None:
                found = found or end == at + 1
                out.append((end, (done[0],), done[1]))
        if not found:  # no piece is this character
            out.append((at + 1, self.fallback(word[at]), self.beyond))
        return out

    def merged(self, text: str, least: int = 1) -> list[str]:
        """What merging leaves of some characters, or the last ``least`` pieces: the best score first, the leftmost of equals."""
        parts = list(text)
        ids, scores = self.model.ids, self.model.scores
        while len(parts) > least:
            best, where = -math.inf, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and scores[k] > best:
                    best, where = scores[k], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def goes(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces leaves just the two.

        Undoes the merges of both from the last to the first, and asks at each
        moment whether the two that then met would have merged before.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        ids, pieces, place, halves = self.model.ids, self.model.pieces, self.place, self.halves
        x, y, limit, known = a, b, math.inf, True
        while True:
            both = ids.get(pieces[x] + pieces[y])
            if both is not None and place[both] < limit:
                known = False
                break
            in_x, in_y = halves[x], halves[y]
            if in_x is None and in_y is None:
                break
            # of two merges of one place the left one comes first
            if in_y is None or (in_x is not None and place[x] > place[y]):
                limit, x = place[x], in_x[1]
            else:
                limit, y = place[y] + 1, in_y[0]
        self.pairs[key] = known
        return known

    def step(self, a: int, ids: tuple[int, ...]) -> float:
        """What going on from piece ``a`` (-1: bytes, or the start) to an arc weighs besides the arc itself."""
        if not self.model.merges or a < 0 or ids[0] not in self.known or self.goes(a, ids[0]):
            return 0.0
        return math.inf

    def shortest(self, word: str) -> list[int]:
        """Ids along the shortest path of the graph of ``word``, by tropical weights.

        A unigram model's places are settled from left to right. A merge model's finite weights
        are all zero: Dijkstra's queue is one bucket then, and which of equals comes first is
        free, so it is the longest arc of the place reached last. On every path of finite
        weight one and the same piece ends at a place, so a place is settled once.
        """
        n = len(word)
        back: list[tuple[int, tuple[int, ...]] | None] = [None] * (n + 1)
        if self.model.merges:
            goes, pairs, following, done = self.goes, self.pairs, self.next, self.done
            bucket, at, last = [], 0, -1  # last: the piece that ends at the place, -1 at the start and behind bytes
            while at < n:
                # the arcs that leave the place (see :meth:`arcs`), the longest on top
                state, end, found = 0, at, False
                while end < n and (state := following[state].get(word[end], -1)) >= 0:
                    end += 1
                    if (k := done[state]) >= 0:
                        found = found or end == at + 1
                        if back[end] is None:
                            bucket.append((at, last, end, k))
                if not found and back[at + 1] is None:
                    bucket.append((at, last, at + 1, -1))
                while True:
                    at, last, end, k = bucket.pop()
                    if back[end] is None:
                        if k >= 0 and last >= 0:
                            ok = pairs.get(last << 20 | k)
                            if not (goes(last, k) if ok is None else ok):
                                continue  # infinity
                        back[end] = (at, (k,) if k >= 0 else self.fallback(word[at]))
                        at, last = end, k
                        break
        else:
            far = [0.0] + [math.inf] * n
            for at in range(n):
                for end, ids, weight in self.arcs(word, at):
                    if far[at] + weight < far[end]:
                        far[end], back[end] = far[at] + weight, (at, ids)
        out, at = [], n
        while at:
            at, ids = back[at]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers on end."""
        words = self.words
        out = []
        chain = self.normalised(text)
        for word in _WORDS.findall(chain) if self.cut else [chain] if chain else []:
            ids = words.get(word)
            if ids is None:
                if len(words) > REMEMBERED:
                    words.clear()
                ids = words[word] = array("I", self.shortest(word)).tobytes()
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces as UTF-8, byte pieces as they are, marks as spaces but for the one in front."""
        text = b"".join(map(self.outputs.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.front and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Encoder:
    return Encoder(Model(path))


def encoded(df: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with an array ``into`` of each text's ids."""
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    keep = others(df, into)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for lo, hi in steps(np.array([len(x or "") for x in texts], np.int64)):
                raw = [t.encode(x or "") for x in texts[lo:hi]]
                cut = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], ids], names=[*keep, into])

    return df.select(*map(column, keep), column(text_col).alias(unused(df, "_text"))).mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the text ``into`` of an array of ids; a null array stays null."""
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    keep = others(df, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts = [None if ids is None else t.decode(ids) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, into])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.StringType())])
    return df.select(*map(column, keep), column(ids_col).alias(unused(df, "_ids"))).mapInArrow(run, schema)


def op8_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids (how many, their crc32 as little-endian 32-bit numbers, byte pieces) and what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        is_byte = np.array([k == BYTE for k in t.model.kinds])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode(text or "")
                ids = np.frombuffer(raw, np.uint32)
                back = t.decode(ids.tolist())
                rows.append((doc, len(ids), zlib.crc32(raw), int(is_byte[ids].sum()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (text or "")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = ["doc_id", "n_ids", "ids_crc32", "n_bytes", "decoded_sha256", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names=names)

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, decoded_sha256 string, exact boolean"
    )
