"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the least node that each is connected with by them."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as one link from each node to the least that it is connected with there."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        x, y = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        nodes, least = roots(x, y)
        a, b = nodes[nodes != least], least[nodes != least]
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _starred(links: DataFrame) -> DataFrame:
    """Links (a > b): every neighbour of a node, and the node itself, linked with the least of them all."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    each = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return each.union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the links ``a``, ``b`` and the least node it is connected with.

    Each round first contracts what each partition holds, then links every node's
    neighbourhood with its least node; it ends when every node is linked with
    nothing but its least. Rounds are written out, so a lost executor costs no more
    than a round.
    """
    # written first: each round reads its links several times
    now = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    while True:
        now = stored(now.mapInArrow(_contracted, "a long, b long"), "contracted-links")
        now = stored(_starred(now), "links")
        # done when no node is linked with two nodes, and none that others are linked with is linked itself
        twice = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
        chain = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if not twice.select(F.lit(1)).union(chain.select(F.lit(1))).take(1):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
