"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A text is the multiset of its paragraphs (the pieces between line feeds). Each
paragraph hashes to eight 32-bit numbers; a text's *strong* vector is their sum
modulo 2^32, lane by lane. Many texts are one paragraph, of which a part may stand in another
text, so paragraphs are hashed once more by clause (a piece up to ``. , ; : ! ?`` and white
space): each clause gives 128 bits, and the *wide* vector counts the set bits modulo 2^32,
lane by lane. All of it is addition, so the vector of a union is the sum of the
vectors: paragraphs can come in any order, and be put in or taken out later
(:func:`merged`, :func:`removed`) without the rest of the text.

A fingerprint is all of these lanes as text (:func:`digest`), so fingerprints alone can be
compared, merged and taken apart again (:func:`parsed`). Equal texts have equal
fingerprints; texts of which one is not the other's paragraphs in another order differ but
for a chance of 2^-256.

Read as random signs, the wide lanes estimate the squared distance of two
multisets of clauses; :func:`likeness` is one less that distance over the sum of both norms,
with a standard error of about 0.1.

The sums run as ordinary aggregates over exploded clauses, so they stay in
generated code, and they group by the ranges that the rows are sorted in, so they
need no exchange of their own.

Defined cases: a null text is the empty text; an empty text has one empty
paragraph and one empty clause; a very long text is many clauses of one group, summed as they
come. Rows with equal ids follow each other by text; repeated rows are rows each; a
null id stands before all others. Columns besides the two named ones take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

SEEDS, WIDE_SEEDS = 4, 2
#: Lanes of 32 bits, two to a number; steps of a hash's bits that one number counts.
BITS, STEPS = 32, 32
_ONES = 1 << BITS | 1
_LOW = 0xFFFFFFFF
CLAUSE = r"(?<=[.,;:!?])\s+"
#: Bytes of text that one task sorts, and bounds of ids between which its ranges are dealt evenly.
RANGE_BYTES, KNOTS = 1 << 24, 256
VECTOR = ("strong", "wide", "paragraphs", "clauses")


def vectors(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """``keys`` with ``strong`` and ``wide`` arrays and the numbers of ``paragraphs`` and ``clauses``.

    ``keys`` must tell rows apart; rows of equal keys are summed as one text.
    """
    head = (F.col("_nth") == 0).cast("long")
    strong = [
        F.sum(head * F.shiftrightunsigned(F.col(f"_p{s}"), half).bitwiseAND(F.lit(_LOW))).alias(f"s{s}_{half}")
        for s in range(SEEDS)
        for half in (0, 32)
    ]
    # a number's two halves cannot meet: no text has 2^32 clauses
    wide = [
        F.sum(F.shiftrightunsigned(F.col(f"_c{s}"), i).bitwiseAND(F.lit(_ONES))).alias(f"w{s}_{i}")
        for s in range(WIDE_SEEDS)
        for i in range(STEPS)
    ]
    pieces = (
        df.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_p"))
        .select(*keys, *[F.xxhash64("_p", F.lit(s)).alias(f"_p{s}") for s in range(SEEDS)], F.posexplode(F.split("_p", CLAUSE)).alias("_nth", "_c"))
        .select(*keys, *[f"_p{s}" for s in range(SEEDS)], "_nth", *[F.xxhash64("_c", F.lit(SEEDS + s)).alias(f"_c{s}") for s in range(WIDE_SEEDS)])
    )
    summed = pieces.groupBy(*keys).agg(*strong, *wide, F.sum(head).alias("paragraphs"), F.count("*").alias("clauses"))
    return summed.select(
        *keys,
        F.array(*[F.col(f"s{s}_{half}").bitwiseAND(F.lit(_LOW)) for s in range(SEEDS) for half in (0, 32)]).alias("strong"),
        F.array(*[F.col(f"w{s}_{i}") for s in range(WIDE_SEEDS) for i in range(STEPS)]).alias("wide"),
        "paragraphs",
        "clauses",
    )


def _halves(p: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(p, BITS), p.bitwiseAND(F.lit(_LOW))


def _combined(a: Column, b: Column, sign: int) -> Column:
    def lane(x: Column, y: Column) -> Column:
        return (x + F.lit(sign) * y).bitwiseAND(F.lit(_LOW))

    def wide(x: Column, y: Column) -> Column:
        (xh, xl), (yh, yl) = _halves(x), _halves(y)
        return F.shiftleft(lane(xh, yh), BITS).bitwiseOR(lane(xl, yl))

    return F.struct(
        F.zip_with(a["strong"], b["strong"], lane).alias("strong"),
        F.zip_with(a["wide"], b["wide"], wide).alias("wide"),
        (a["paragraphs"] + F.lit(sign) * b["paragraphs"]).alias("paragraphs"),
        (a["clauses"] + F.lit(sign) * b["clauses"]).alias("clauses"),
    )


def merged(a: Column, b: Column) -> Column:
    """The vector (a struct of :func:`vectors`' columns) of the paragraphs of both."""
    return _combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``, which must be among them."""
    return _combined(a, b, -1)


def digest(v: Column) -> Column:
    """The vector as text: strong lanes, paragraphs, clauses and wide lanes, eight hexadecimal digits each."""

    def hexed(c: Column, width: int) -> Column:
        return F.lpad(F.lower(F.hex(c)), width, "0")

    strong = [hexed(v["strong"][k], 8) for k in range(2 * SEEDS)]
    return F.concat(*strong, hexed(v["paragraphs"], 8), hexed(v["clauses"], 8), F.array_join(F.transform(v["wide"], lambda p: hexed(p, 16)), ""))


def parsed(fingerprint: Column) -> Column:
    """The vector that a fingerprint is the text of."""
    lane = lambda at: F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("long")
    first = 8 * (2 * SEEDS + 2) + 1
    wide = [
        F.shiftleft(lane(first + 16 * k), BITS).bitwiseOR(lane(first + 16 * k + 8)) for k in range(WIDE_SEEDS * STEPS)
    ]
    strong = [lane(8 * k + 1) for k in range(2 * SEEDS)]
    return F.struct(
        F.array(*strong).alias("strong"), F.array(*wide).alias("wide"), lane(16 * SEEDS + 1).alias("paragraphs"), lane(16 * SEEDS + 9).alias("clauses")
    )


def likeness(a: Column, b: Column) -> Column:
    """From 0 (nothing in common) to 1 (equal multisets), estimated from 128 lanes; arguments as in :func:`merged`."""
    zero = F.lit(0.0)

    def squared(x: Column) -> Column:
        x = x.cast("double")
        return x * x

    def norm(v: Column) -> Column:
        return F.aggregate(v["wide"], zero, lambda s, p: s + sum((squared(F.lit(2) * h - v["clauses"]) for h in _halves(p)), zero))

    def gap(p: Column, q: Column) -> Column:
        d = a["clauses"] - b["clauses"]
        return sum((squared(F.lit(2) * (x - y) - d) for x, y in zip(_halves(p), _halves(q), strict=True)), zero)

    apart = F.aggregate(F.zip_with(a["wide"], b["wide"], gap), zero, lambda s, x: s + x)
    same = (a["strong"] == b["strong"]) & (a["wide"] == b["wide"])
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(zero, F.lit(1.0) - apart / F.greatest(norm(a) + norm(b), F.lit(1.0))))


def ranged(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Rows with the range of ``key`` they sort in; the first rows of a range are also ``_guest`` in the range before.

    So the row after any row stands in its own range, and no task sorts the whole
    table: there are as many ranges as the texts have :data:`RANGE_BYTES`. A few bounds are
    quantiles of the keys, and between two of them ranges are of equal width. The last
    range's guest is the table's first row. Adds ``_range``, ``_guest`` and ``_order``.
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    keyed = df.withColumn("_order", order)
    quantiles = [k / KNOTS for k in range(KNOTS)]
    size, low, high, found = keyed.agg(
        F.sum(F.octet_length(text_col).cast("long") + 100), F.min("_order"), F.max("_order"), F.percentile_approx("_order", quantiles, 16 * KNOTS)
    ).first()
    ranges = max(1, (size or 0) // RANGE_BYTES)
    found = sorted({low or 0, *(found or [])})
    bounds = found[:: max(1, -(-len(found) // ranges))]
    inner = max(1, -(-ranges // len(bounds)))
    ends = [*bounds[1:], max(bounds[-1], high or 0)]
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    width = F.array(*[F.lit(max(1.0, (float(e) - float(b)) / inner)) for b, e in zip(bounds, ends, strict=True)])
    at = F.size(F.filter(held, lambda b: b <= F.col("_order"))) - 1
    keyed = keyed.withColumn("_knot", at)
    within = F.floor((F.col("_order").cast("double") - F.get(held, F.col("_knot")).cast("double")) / F.get(width, F.col("_knot")))
    own = (F.col("_knot").cast("long") * inner + F.least(F.lit(inner - 1), within)).alias("_own")
    keyed = keyed.select("*", own).drop("_knot")
    # a row a range: sixteen bytes for RANGE_BYTES of text
    firsts = keyed.groupBy("_own").agg(F.min("_order").alias("_order"))
    before = F.coalesce(F.lag("_own").over(Window.orderBy("_own")), F.max("_own").over(Window.partitionBy()))
    firsts = firsts.select(F.col("_own").alias("_f"), F.col("_order").alias("_o"), before.alias("_before"))
    firsts = F.broadcast(firsts) if ranges <= 1 << 20 else firsts
    joined = keyed.join(firsts, (F.col("_own") == F.col("_f")) & (F.col("_order") == F.col("_o")), "left")
    place = F.struct(F.col("_own").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("range"), F.lit(True).alias("guest"))
    both = joined.withColumn("_at", F.explode(F.when(F.col("_before").isNotNull(), F.array(place, guest)).otherwise(F.array(place))))
    return both.withColumns({"_range": F.col("_at.range"), "_guest": F.col("_at.guest")}).drop("_own", "_at", "_f", "_o", "_before")


def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint beside those of its half-replaced text and of the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("_range").orderBy("_guest", "_order", "text")
    n, half = F.char_length("text"), F.floor(F.col("n_chars") / F.lit(2)).cast("int")
    both = (
        ranged(docs, "doc_id")
        .withColumns({"next_text": F.lead("text", 1, "").over(w), "_row": F.row_number().over(w)})
        .withColumn("n_chars", n)
        .withColumn(
            "edited",
            F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)),
        )
        .select(
            "_range", "_row", "_guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("_t"),
        )
        .withColumns({"_which": F.col("_t.which"), "text": F.col("_t.text")})
    )
    kept = ("_range", "_row", "_which", "_guest", "doc_id", "n_chars", "edited_sha256")
    follow = Window.partitionBy("_range").orderBy("_row", "_which")
    v = F.struct(*VECTOR)
    return (
        vectors(both, *kept)
        .withColumn("own", v)
        .withColumns({"edited": F.lead("own", 1).over(follow), "next": F.lead("own", 2).over(follow)})
        .filter(~F.col("_guest") & (F.col("_which") == 0))
        .select(
            "doc_id",
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            digest(F.col("own")).alias("fingerprint"),
            digest(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("next")).alias("near_next"),
        )
    )
