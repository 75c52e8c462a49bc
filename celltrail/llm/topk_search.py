"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

Vectors are cut into chunks by length, the longest first. Every query meets the first
chunk and takes its k-th best score from there as a threshold. Then rounds of more and more
chunks follow: a query needs a chunk only if the longest vector in it can reach the
query's threshold (Cauchy-Schwarz on whole lengths), queries of like need form blocks, and a
chunk is sent only to the blocks that need it; each round raises the thresholds, and the
search ends when nothing is needed any more. In a cell candidates come by descending
length. A query that the longest of a run of candidates cannot lift
over its threshold skips the run; for the others
the leading coordinates of the rotated vectors are multiplied, and a candidate is
scored exactly only if that partial sum and the product of both residual lengths
reach the threshold. The rotation is the right singular basis of all vectors, from
the sum of their outer products.

Components are whole numbers; scores are exact: in floating point while the product of two
lengths stays under 2^52, else in Python's integers. Bounds of longer vectors are taken on
vectors scaled by a power of two, so that no product leaves the range of floating point.

Defined cases: vectors that are null or hold a null or a component that is not
finite take no part, nor do rows without an id; a shorter vector counts as ending in zeros; a
query's own row is any row of its id; equal scores rank by the smaller id; with fewer
than k candidates there are fewer rows; scores beyond 64 bits rank by what they are and are cut to the nearest
such number; rows of one id are a candidate each and one query, that of the least vector; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import prepare, stored, table

#: Candidates of a chunk, queries of a block, candidates multiplied at once.
CHUNK, BLOCK, RUN = 1 << 15, 1024, 2048
MOST_CHUNKS = 2048
#: Leading coordinates that are multiplied first, as a share of all.
LEADING = 0.25
_EXACT = 2.0**52
LARGEST = 1.7e308
#: Vectors of which one task sums the outer products.
SUMMED = 1 << 22
#: How many times more chunks a round takes than the one before.
FASTER = 4


def length(x: np.ndarray) -> float:
    """The length of a vector, at most the largest finite number, rounded up a little."""
    most = float(np.abs(x).max(initial=0.0))
    if not most:
        return 0.0
    scale = math.ldexp(1.0, min(1023, math.frexp(most)[1]))
    return min(float(np.sqrt(((x / scale) ** 2).sum())) * (1 + 1e-12), LARGEST / scale) * scale


def shifted(score: int, by: int) -> float:
    """``score`` times 2^-by as a floating number, whatever its size."""
    bits = max(0, abs(score).bit_length() - 64)
    return math.ldexp(float(score >> bits), bits - by)


def whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector, norm): floor(scale * x) as doubles, of vectors that take part."""
    for batch in batches:
        ids, vectors, norms = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if not np.isfinite(x).all():
                continue
            x = np.floor(scale * x)
            if not np.isfinite(x).all():
                continue
            ids.append(i)
            vectors.append(x.tobytes())
            norms.append(length(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "vector", "norm"])


def matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for k, r in enumerate(raw):
        x = np.frombuffer(r)
        out[k, : len(x)] = x
    return out


def rotation(vectors: DataFrame, width: int, size: int = 0) -> np.ndarray:
    """The right singular vectors of all rows, those of large singular values first; what a task sends are width^2 numbers, summed in a tree."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0).to_pylist(), width)
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0.0), 1e-300)  # first to components of 1
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["outer"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw).reshape(width, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["outer"])

    tasks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, size // SUMMED)
    parts = vectors.select("vector").coalesce(tasks).mapInArrow(outer, "outer binary")
    total = np.zeros((width, width))
    for row in parts.repartition(16).mapInArrow(summed, "outer binary").collect():
        total += np.frombuffer(row["outer"]).reshape(width, width)
    _, basis = np.linalg.eigh(total)
    return np.ascontiguousarray(basis[:, ::-1])


class Best:
    """The k best candidates of each query of a cell so far; bounds and thresholds are of vectors times 2^-shift."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, basis: np.ndarray, floor: np.ndarray, k: int, shift: int):
        self.ids, self.queries, self.k, self.shift = ids, queries, k, shift
        small = np.ldexp(queries, -shift)
        self.turned = small @ basis
        self.lead = max(1, int(queries.shape[1] * LEADING))
        self.length = np.linalg.norm(small, axis=1)
        self.rest = np.linalg.norm(self.turned[:, self.lead :], axis=1)
        self.basis, self.floor = basis, floor.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A run of candidates by descending length."""
        small = np.ldexp(vectors, -self.shift)
        length = np.linalg.norm(small, axis=1)
        slack = 1e-9 * (1 + self.length * length.max(initial=0))
        live = np.flatnonzero(self.length * length.max(initial=0) + slack >= self.floor)
        if not len(live) or not len(ids):
            return
        turned = small @ self.basis
        rest = np.linalg.norm(turned[:, self.lead :], axis=1)
        bound = self.turned[live, : self.lead] @ turned[:, : self.lead].T + np.outer(self.rest[live], rest)
        maybe = bound + slack[live, None] >= self.floor[live, None]
        most = self.length[live].max() * length.max()
        exact = most == 0 or math.log2(most) + 2 * self.shift < math.log2(_EXACT)
        for row, q in enumerate(live.tolist()):
            take = np.flatnonzero(maybe[row] & (ids != self.ids[q]))
            if not len(take):
                continue
            if exact and (self.shift == 0 or np.abs(vectors[take]).max(initial=0) < _EXACT):
                score = vectors[take] @ self.queries[q]
                if len(take) > self.k:  # what is under the k-th of these cannot stay
                    cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                    take, score = take[score >= cut], score[score >= cut]
                pairs = zip((-score).astype(np.int64).tolist(), ids[take].tolist(), strict=True)
            else:
                own = [int(x) for x in self.queries[q]]
                pairs = [(-sum(a * int(b) for a, b in zip(own, vectors[t], strict=True)), int(ids[t])) for t in take]
            best = sorted([*self.found[q], *pairs])[: self.k]
            self.found[q] = best
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], shifted(-best[-1][0], 2 * self.shift))

    def rows(self) -> tuple[list[int], list[int], list[int], list[float]]:
        cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        out = [(int(q), v, cut(-s), shifted(-s, 2 * self.shift)) for q, best in zip(self.ids, self.found, strict=True) for s, v in best]
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [], [])


FOUND = "query_id long, vec_id long, score long, high double"


def _searched(cells: DataFrame, basis: np.ndarray, k: int, shift: int) -> DataFrame:
    """(query_id, vec_id, score, high) of each cell, ``high`` the score times 2^-2shift; ``cells``: (cell, side, order, id, vector, floor), side 0 are queries."""
    width = len(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, side = None, None, 0
        ids, raw, floors = [], [], []

        def take():
            nonlocal best, ids, raw, floors
            if ids and side == 0:
                best = Best(np.array(ids), matrix(raw, width), basis, np.array(floors), k, shift)
            elif ids and best is not None:
                best.add(np.array(ids), matrix(raw, width))
            ids, raw, floors = [], [], []

        def close():
            take()
            *whole_, high = best.rows() if best is not None else ([], [], [], [])
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in whole_], pa.array(high, pa.float64())], names=["query_id", "vec_id", "score", "high"])

        for batch in batches:
            for c, z, i, r, f in zip(*(batch.column(q).to_pylist() for q in range(5)), strict=True):
                if c != cell:
                    if cell is not None:
                        yield close()
                    cell, best, side = c, None, z
                elif z != side or (z and len(ids) == RUN):
                    take()
                    side = z
                ids.append(i)
                raw.append(r)
                floors.append(f)
        if cell is not None:
            yield close()

    return (
        cells.repartition("cell")
        .sortWithinPartitions("cell", "side", "order")
        .select("cell", "side", "id", "vector", "floor")
        .mapInArrow(run, FOUND)
    )


def searched(df: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``is_query`` (a predicate of ``vec_id``)."""
    spark = df.sparkSession
    prepare(spark)
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    vectors = stored(raw.mapInArrow(lambda b: whole(b, scale), "vec_id long, vector binary, norm double"), "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    fractions = [i / MOST_CHUNKS for i in range(1, MOST_CHUNKS)]
    size, width, longest, bounds = vectors.agg(
        F.count("*"), F.max(F.octet_length("vector") / 8).cast("int"), F.max("norm"), F.percentile_approx("norm", fractions, 4 * MOST_CHUNKS)
    ).first()
    if not size or not width:
        return none
    basis = rotation(vectors, width, size)
    shift = 0 if longest < 2.0**26 else math.frexp(longest)[1]
    chunks = max(1, min(MOST_CHUNKS, -(-size // CHUNK)))
    bounds = sorted({bounds[-(i * MOST_CHUNKS // chunks)] for i in range(1, chunks)}, reverse=True)
    chunk = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: F.col("norm") < b))
    placed = vectors.withColumn("chunk", chunk)
    held = placed.groupBy("chunk").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy("chunk").collect()  # at most MOST_CHUNKS
    counts, most = [r["n"] for r in held], [math.ldexp(r["most"], -shift) for r in held]
    # a chunk of more vectors than a task takes, as one length may have, is split by id
    splits = [max(1, -(-n // CHUNK)) for n in counts]
    rank = F.element_at(F.create_map(*[F.lit(x) for c, r in enumerate(held) for x in (r["chunk"], c)]), F.col("chunk"))
    placed = placed.withColumn("chunk", rank)
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("chunk"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), of(splits)).cast("int"))
    asked = vectors.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("vector", "norm")).alias("q")).select("vec_id", "q.*")

    def met(first: int, end: int, queries: DataFrame, blocks: list[int]) -> DataFrame:
        """What queries (block, floor) find in the chunks from ``first`` to before ``end``; ``blocks``: how many of the first blocks need each."""
        lasts = F.array(*[F.lit(b) for b in blocks])
        needed = F.get(lasts, F.col("chunk") - first)
        other = placed.filter((F.col("chunk") >= first) & (F.col("chunk") < end) & (needed > 0))
        other = other.withColumn("block", F.explode(F.sequence(F.lit(0), needed - 1))).withColumn("floor", F.lit(float("-inf")))
        pieces = F.explode(F.filter(F.sequence(F.lit(first), F.lit(end - 1)), lambda c: F.get(lasts, c - first) > F.col("block")))
        own = queries.withColumn("chunk", pieces).withColumn("part", F.explode(F.sequence(F.lit(0), of(splits) - 1)))
        shape = ["chunk", "part", "block", "side", "order", F.col("vec_id").alias("id"), "vector", "floor"]
        both = own.withColumns({"side": F.lit(0), "order": F.lit(0.0)}).select(*shape).unionByName(other.withColumns({"side": F.lit(1), "order": -F.col("norm")}).select(*shape))
        cell = F.concat_ws(".", "chunk", "part", "block")
        return _searched(both.withColumn("cell", cell), basis, k, shift)

    def dealt(queries: DataFrame, needs: dict[int, int]) -> tuple[DataFrame, list[int]]:
        """Queries (need) in blocks, those of the most need first, and how far each block's need goes; ``needs``: how many have each."""
        block, classes, size_ = 0, [], 0
        first: dict[int, tuple[int, int]] = {}
        ends: list[int] = []
        for need in sorted(needs, reverse=True):  # at most one a chunk
            classes.append(need)
            size_ += needs[need]
            if size_ >= BLOCK or need == min(needs):
                many = -(-size_ // BLOCK)
                first |= {n: (block, many) for n in classes}
                ends += [classes[0]] * many
                block, classes, size_ = block + many, [], 0
        pick = lambda k_: F.element_at(F.create_map(*[F.lit(x) for n in first for x in (n, first[n][k_])]), F.col("need"))
        return queries.withColumn("block", (pick(0) + F.pmod(F.xxhash64("vec_id", F.lit(1)), pick(1))).cast("int")), ends

    total = asked.count()
    if not total:
        return none
    start, _ = dealt(asked.withColumns({"floor": F.lit(float("-inf")), "need": F.lit(1)}), {1: total})
    found = stored(met(0, 1, start, [max(1, -(-total // BLOCK))]), "found")
    begin, width_ = 1, FASTER
    while begin < len(held):
        kth = F.element_at(F.sort_array(F.collect_list("high"), asc=False), k)
        best = Window.partitionBy("query_id").orderBy(F.col("high").desc(), "vec_id")
        top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
        floors = top.groupBy("query_id").agg(F.count("*").alias("n"), kth.alias("floor")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor")
        open_ = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        # the last chunk whose longest vector can reach the threshold; lengths fall from chunk to chunk
        own = F.col("norm") * F.lit(math.ldexp(1.0, -shift)) if shift < 1000 else F.col("norm") * F.lit(math.ldexp(1.0, -900)) * F.lit(math.ldexp(1.0, 900 - shift))
        reach = F.size(F.filter(F.array(*[F.lit(m) for m in most]), lambda m: own * m * (1 + 1e-9) + 1e-9 >= F.col("floor")))
        open_ = open_.withColumn("need", reach.cast("int")).filter(F.col("need") > begin)
        needs = {r["need"]: r["n"] for r in open_.groupBy("need").agg(F.count("*").alias("n")).collect()}  # at most one a chunk
        if not needs:
            break
        end = min(len(held), begin + width_)
        queries, ends = dealt(open_, needs)
        blocks = [sum(e > c for e in ends) for c in range(begin, end)]
        found = found.unionByName(stored(met(begin, end, queries, blocks), "found"))
        begin, width_ = end, width_ * FASTER
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("high").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector."""
    return searched(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
