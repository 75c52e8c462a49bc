"""Toxicity from two class-conditional Kneser-Ney models of the characters of words.

Expressions are words. Each class, toxic and ordinary, has an interpolated
Kneser-Ney model of a word's characters given those before, the word's start
included; orders above :data:`SHARED` are counted in the class, the orders below
come from continuation counts of both classes together, so that an expression that
one class never showed is smoothed by what is common to both. A word's score is its
log-likelihood under the toxic model less that under the ordinary one, each by
character; a text's features are its length-normalised log-likelihood ratio and its
strongest words' ratios. A logistic curve fitted on the labelled rows, scored by
models that left them out (two folds), turns these into a score from 0 to 1.

Counts run over all labelled rows given. Grams are counted exactly, each under its
own bytes, in a grouped table; the table of distinct grams is collected and sent to
executors, and grows with the labelled rows (see :class:`Counts`). The curve is fitted on about :data:`CURVE_ROWS`
rows. Every word of every whole text is scored.

Defined cases: a null or empty text, or one without a word, has no ratio and gets
the curve's value for zero words; with labels of one class only, every score is
0.0 (none toxic) or 1.0 (none ordinary); a null id or label teaches nothing but is
scored; of labels of one id that differ, toxic counts; repeated rows score alike; words and
texts may be of any length; other columns take no part, but one of the name that is added
gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, crc_bucket, others, prepare, steps, table, unused, utf8
from ._words import distinct, prefix_sums, ranges, span_hash, spans

U = np.uint64
ORDER, SHARED = 6, 2
DISCOUNT = 0.75
CURVE_ROWS = 6000
#: Distinct grams that a task holds before it hands their counts on.
HELD = 1 << 20
#: Shares of a toxic text's words that are taken to be toxic expressions; the others are ordinary.
SHARES = (0.01, 0.05)
#: How many of a text's strongest words are averaged.
TOP = 10
THRESHOLD = 0.7
#: Bytes of labelled text that one task counts, at most, where there are more of them than tasks at once.
TASK_BYTES = 1 << 28
#: A column of texts' sizes that labelled rows may have.
SIZE = "_bytes"

KINDS = [f"n{k}" for k in range(4)]
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    return utf8(pc.utf8_lower(column.cast(pa.large_string())))


@dataclass
class Words:
    """The distinct words of some texts on end, and which of them each text has, in order."""

    letters: np.ndarray  # of each word ORDER zeros, the start mark 1, its bytes, and a zero for its end
    length: np.ndarray
    code: np.ndarray
    text: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, text = spans(_WORD, data, offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), start, text)
    code, first = distinct(span_hash(prefix_sums(data), start, end))
    begin, length = start[first], (end - start)[first]
    at = np.cumsum(length + ORDER + 2) - (length + ORDER + 2)
    letters = np.zeros(int((length + ORDER + 2).sum()), np.uint8)
    letters[at + ORDER] = 1
    letters[ranges(at + ORDER + 1, length)] = data[ranges(begin, length)]
    return Words(letters, length, code, text)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word of every predicted character (the end counts as one) and its gram of the highest order.

    A gram is the character with ``ORDER - 1`` before it, its bytes as one number;
    before the start mark stand zeros, so the highest order sees the whole beginning
    of a word. The last bytes are the grams of the lower orders.
    """
    size = words.length + ORDER + 2
    at = ranges(np.cumsum(size) - size + ORDER + 1, words.length + 1)
    gram = np.zeros(len(at), U)
    for k in reversed(range(ORDER)):
        gram = gram << U(8) | words.letters[at - k].astype(U)
    return np.repeat(np.arange(len(size)), words.length + 1), gram


def _last(gram: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` characters."""
    return gram & U((1 << 8 * n) - 1)


def counted(words: Words, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams and how often each stands in the texts of each kind; ``kind`` of a text: 2 * fold + class."""
    row, gram = grams(words)
    own, where = np.unique(gram, return_inverse=True)
    seen = np.zeros((4, len(own)), np.int64)
    for y in np.unique(kind):
        weight = np.bincount(words.code[kind[words.text] == y], minlength=len(words.length))[row]
        seen[y] = np.bincount(where, weight, len(own)).astype(np.int64)
    return own, seen


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several parts as one."""
    gram, seen = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    return gram[first], np.add.reduceat(seen[:, order], first, axis=1)


@dataclass
class Level:
    """The distinct grams of an order, and of each how often it was seen, its context and the gram without its first character."""

    gram: np.ndarray
    seen: np.ndarray  # (4, grams)
    context: np.ndarray  # distinct
    where: np.ndarray  # of each gram, its context's place
    lower: np.ndarray  # of each gram, its place in the level below


class Counts:
    """Exact counts of every distinct gram by class and fold, as levels from the lowest order to the highest."""

    def __init__(self, gram: np.ndarray, seen: np.ndarray):
        order = np.argsort(gram)
        gram, seen, levels = gram[order], seen[:, order], []
        for k in reversed(range(ORDER)):
            context, where = np.unique(gram >> U(8), return_inverse=True)
            below, lower = np.unique(_last(gram, k), return_inverse=True)
            levels.append(Level(gram, seen, context, where, lower))
            gram, seen = below, np.stack([np.bincount(lower, s, len(below)) for s in seen])
        self.levels = levels[::-1]


class Model:
    """Interpolated Kneser-Ney probabilities of both classes from the folds given."""

    def __init__(self, counts: Counts, folds: tuple[int, ...]):
        self.keys, self.gain, self.rest = [], [], []
        for k, level in enumerate(counts.levels):
            gain, rest = np.zeros((2, len(level.gram)), np.float32), np.ones((2, len(level.context)), np.float32)
            for y in (0, 1):
                kinds = [2 * f + z for f in folds for z in ((0, 1) if k < SHARED else (y,))]
                if k + 1 < ORDER:  # how many different characters stand before it
                    above = counts.levels[k + 1]
                    c = np.bincount(above.lower[above.seen[kinds].sum(0) > 0], minlength=len(level.gram))
                else:
                    c = level.seen[kinds].sum(0)
                has = c > 0
                where = level.where[has]
                total = np.bincount(where, c[has], len(level.context))
                kinds_of = np.bincount(where, minlength=len(level.context))
                rest[y] = np.where(total > 0, np.minimum(1.0, DISCOUNT * kinds_of / np.maximum(total, 1)), 1.0)
                gain[y][has] = (c[has] - DISCOUNT) / total[where]
            self.keys.append((level.gram, level.context))
            self.gain.append(gain)
            self.rest.append(rest)
        top = counts.levels[-1].seen
        self.learned = [bool(any(top[2 * f + y].any() for f in folds)) for y in (0, 1)]

    def ratios(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word's log-likelihood ratio, toxic over ordinary, and the characters it was made of."""
        row, gram = grams(words)
        own, where = np.unique(gram, return_inverse=True)
        p = np.full((2, len(own)), 1 / 256, np.float32)
        for k, (known, contexts) in enumerate(self.keys):
            g = _last(own, k + 1)
            p = _found(known, self.gain[k], g, 0) + _found(contexts, self.rest[k], g >> U(8), 1) * p
        logs = np.log(np.minimum(p, 1.0))
        return np.bincount(row, (logs[1] - logs[0])[where], len(words.length)), words.length + 1


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The values of both classes at ``wanted``, ``default`` where ``keys``, in order, lack it."""
    if not len(keys):
        return np.full((2, len(wanted)), default, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[:, at], np.float32(default))


def features(words: Words, ratio: np.ndarray, size: np.ndarray, texts: int) -> np.ndarray:
    """(texts, features): length-normalised and whole log-likelihood ratios, and the strongest words'.

    A toxic text is mostly ordinary words, so besides the plain mean of ratios there
    is, for each of :data:`SHARES`, the log-likelihood ratio of a mixture.
    """
    r, text = ratio[words.code], words.text
    n = np.bincount(text, minlength=texts)
    root = np.sqrt(np.maximum(n, 1))
    columns = [100 * np.bincount(text, r, texts) / np.maximum(np.bincount(text, size[words.code], texts), 1)]
    for share in SHARES:
        whole = np.bincount(text, np.log1p(share * np.expm1(ratio))[words.code], texts)
        columns += [100 * whole / root**2, whole / root, np.sign(whole) * np.log1p(np.abs(whole)), np.maximum(whole, 0) ** 0.5]
    order = np.lexsort((-r, text))
    first = np.cumsum(n) - n
    top = np.zeros((texts, TOP))
    for k in range(TOP):
        has = n > k
        top[has, k] = r[order[first[has] + k]]
    return np.column_stack([*columns, top[:, 0], top.mean(1), np.log1p(n)])


class Curve:
    """A logistic curve over standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        ridge = np.diag([1e-6, *[1.0] * (z.shape[1] - 1)])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (y - p) - ridge @ self.weights
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, gradient)
            self.weights += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -20, 20)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _stepped(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = lowered(column)
    for lo, hi in steps(np.diff(offsets)):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, words_of(data[a:b], offsets[lo : hi + 1] - a)


def _pieces(gram: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(gram), 1 << 16):
        cut = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (gram.view(np.int64), *seen)], names=["gram", *KINDS])


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> tuple[Model, object]:
    """The models of all labelled rows and the curve from their ratios to a score."""
    spark = labelled.sparkSession
    prepare(spark)
    h = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 20))
    # measured below a join, so that the sum of sizes moves no text
    size = F.col(SIZE) if SIZE in labelled.columns else F.octet_length(text_col).cast("long")
    rows = labelled.filter(F.col(label_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), (h % 2).cast("int").alias("fold"), h.alias("h"), size.alias("size")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            kind = 2 * batch.column("fold").to_numpy() + (batch.column("toxic").to_numpy() == 1)
            for lo, hi, words in _stepped(batch.column("text")):
                if len(words.code):
                    held.append(counted(words, kind[lo:hi]))
                    size += len(held[-1][0])
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from _pieces(*held[0])
                        held, size = [], 0
        if held:
            yield from _pieces(*summed(held))

    per = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    wide = max(2 * spark.sparkContext.defaultParallelism, -(-sum(r["bytes"] or 0 for r in per) // TASK_BYTES))
    parts = rows.coalesce(wide).mapInArrow(count, "gram long, " + ", ".join(f"{n} long" for n in KINDS))
    found = parts.groupBy("gram").agg(*[F.sum(n).alias(n) for n in KINDS]).toArrow()  # grows with the distinct grams
    counts = Counts(found.column("gram").to_numpy().view(U), np.stack([found.column(n).to_numpy() for n in KINDS]))
    model = Model(counts, (0, 1))
    if not all(model.learned):
        return model, Constant(float(model.learned[1]))

    # by the fold of the row to score: it left that fold out
    shared = spark.sparkContext.broadcast([Model(counts, (1,)), Model(counts, (0,))])

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for lo, hi, words in _stepped(batch.column("text")):
                x = [features(words, *half.ratios(words), hi - lo) for half in shared.value]
                both = np.where((fold[lo:hi] == 0)[:, None], x[0], x[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(both), pa.list_(pa.float64())), batch.column("toxic").slice(lo, hi - lo)], names=["x", "toxic"]
                )

    share = min(1.0, CURVE_ROWS / max(1, sum(r["n"] for r in per)))
    picked = rows.filter(F.col("h") < int(share * (1 << 20)))
    found = picked.coalesce(wide).mapInArrow(example, "x array<double>, toxic int").collect()
    y = np.array([r["toxic"] == 1 for r in found], float)
    if not 0 < y.sum() < len(y):
        return model, Constant(float(len(y) > 0 and y[0]))
    order = np.lexsort(np.array([r["x"] for r in found]).T)
    return model, Curve(np.array([found[i]["x"] for i in order]), y[order])


def scored(df: DataFrame, model: Model, curve, text_col: str = "text", into: str = "_toxicity") -> DataFrame:
    """``df`` with a double ``into``: how likely the text is toxic."""
    from pyspark.sql import types as T

    spark = df.sparkSession
    prepare(spark)
    keep = others(df, into)
    shared = spark.sparkContext.broadcast((model, curve))  # grows with the distinct grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, words in _stepped(batch.column(len(keep))):
                out[lo:hi] = curve(features(words, *model.ratios(words), hi - lo))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*keep, into])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.DoubleType())])
    return df.select(*map(column, keep), column(text_col).alias(unused(df, "_text"))).mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their labels, without the rows that are held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias(SIZE))
    return own.filter(crc_bucket("doc_id", 3) != 1).join(known.hint("merge"), "doc_id")  # labels grow with the texts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labelled two thirds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, curve = learn(labelled(docs, table(spark, sf_dir, "labels")))
    return scored(docs, model, curve).select(
        "doc_id",
        (crc_bucket("doc_id", 3) == 1).alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model, curve = learn(labelled(docs, table(spark, sf_dir, "labels")))
    into = unused(docs, "_toxicity")
    return scored(docs, model, curve, into=into).filter(F.col(into) < THRESHOLD).select(*map(column, docs.columns))
