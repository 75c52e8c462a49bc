"""Which format a file has: scored candidates and what to do with them.

Detection reads a bounded sample, the first rows of a file; all signals of all formats
are one aggregate over it. :func:`routed` does the same for many files in one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.times import with_time
from .formats import BUILT_IN, Format, plain, position

# Thresholds, weights and sample sizes.
AUTO, CANDIDATE, APART = 0.9, 0.35, 0.1
WEIGHTS = {"required": 0.35, "optional": 0.15, "delimiter": 0.10, "contents": 0.25, "timestamp": 0.10, "filename": 0.05}
CONTENT_SAMPLE = 50
#: A column whose values look like its identifier in this share does; what a format without identifiers gets.
LOOKS_LIKE, NO_IDENTIFIERS = 0.8, 0.6


@dataclass
class Candidate:
    format: Format
    confidence: float
    signals: dict[str, float]
    notes: list[str]


def header_signals(fmt: Format, headers: list[str], delimiter: str | None, filename: str = "") -> dict[str, float] | None:
    """The signals that need no rows; None if the headers rule the format out."""
    have = {plain(h) for h in headers}
    if any(plain(h) in have for h in fmt.forbidden) or not all(plain(h) in have for h in fmt.required):
        return None
    out = {"required": 1.0, "optional": sum(plain(h) in have for h in fmt.optional) / len(fmt.optional) if fmt.optional else 1.0}
    out["delimiter"] = 1.0 if delimiter is None or delimiter == fmt.delimiter else 0.2
    if fmt.filename:
        out["filename"] = 1.0 if re.search(fmt.filename, filename, re.I) else 0.5
    return out


def _field(k: int | None):
    return F.get("fields", F.lit(k)) if k is not None else F.lit(None).cast("string")


def _time_column(fmt: Format, headers: list[str]):
    """The text of a format's times; None if the headers hold no column for it."""
    if fmt.split_time:
        d, t = position(fmt.date, headers), position(fmt.time, headers)
        if d is None and t is None:
            return None
        return F.concat_ws(" ", F.nullif(F.trim(_field(d)), F.lit("")), F.nullif(F.trim(_field(t)), F.lit("")))
    p = position(fmt.timestamp, headers) if fmt.timestamp else None
    return None if p is None else _field(p)


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, by their numbers where they have one."""
    return (rows.orderBy("row") if "row" in rows.columns else rows).limit(n)


def contents(formats: list[Format], rows: DataFrame, headers: list[str]) -> dict[str, tuple[float, float]]:
    """By format id: the share of identifier columns whose values look like it (0.6 if it has none), and of times that parse (0 without a time column)."""
    sample = sampled(rows, CONTENT_SAMPLE).select("fields")
    aggregates, kinds = [], {}
    for k, fmt in enumerate(formats):
        if (raw := _time_column(fmt, headers)) is not None:
            sample = with_time(sample.withColumn("_raw", raw), "_raw", into=f"_time_{k}", package_zone="UTC").drop("_raw")
            time = F.col(f"_time_{k}")
            aggregates.append(F.avg(F.when(time["original"] != "", time["utc"].isNotNull().cast("double"))).alias(f"time_{k}"))
        kinds[k] = [(kind, p) for kind in ("imsi", "imei", "msisdn") if kind in fmt.fields and (p := position(fmt.fields[kind], headers)) is not None]
        for kind, p in kinds[k]:
            looks = F.coalesce((ids.inferred(_field(p))["type"] == kind.upper()).cast("double"), F.lit(0.0))
            aggregates.append(F.avg(F.when(~ids.is_null_token(_field(p)), looks)).alias(f"{kind}_{k}"))
    found = sample.agg(F.count("*"), *aggregates).first().asDict() if aggregates else {}
    return {
        fmt.id: (sum((found[f"{kind}_{k}"] or 0.0) >= LOOKS_LIKE for kind, _ in kinds[k]) / len(kinds[k]) if kinds[k] else NO_IDENTIFIERS, found.get(f"time_{k}") or 0.0)
        for k, fmt in enumerate(formats)
    }


def detect(rows: DataFrame, headers: list[str], delimiter: str | None, filename: str = "", formats: tuple[Format, ...] = BUILT_IN) -> list[Candidate]:
    """Formats of at least :data:`CANDIDATE`, the likeliest first: the weighted mean of each one's signals."""
    named = {f.id: s for f in formats if (s := header_signals(f, headers, delimiter, filename)) is not None}
    open_ = [f for f in formats if f.id in named]
    out = []
    for fmt, (held, times) in zip(open_, contents(open_, rows, headers).values(), strict=True):
        signals = named[fmt.id] | {"contents": held, "timestamp": times}
        weight = sum(WEIGHTS[k] for k in signals)
        confidence = sum(WEIGHTS[k] * v for k, v in signals.items()) / weight
        out.append(Candidate(fmt, confidence, signals, [f"{k}: {v:.2f}" for k, v in signals.items() if v < 1]))
    return sorted((c for c in out if c.confidence >= CANDIDATE), key=lambda c: -c.confidence)


def route(candidates: list[Candidate]) -> str:
    """AUTO for one clear format, NEEDS_CONFIRMATION for a doubtful one, NEEDS_MAPPING for none."""
    if not candidates:
        return "NEEDS_MAPPING"
    second = candidates[1].confidence if len(candidates) > 1 else 0.0
    clear = candidates[0].confidence >= AUTO and (len(candidates) < 2 or candidates[0].confidence - second >= APART)
    return "AUTO" if clear else "NEEDS_CONFIRMATION"


def headers_scored(headers: DataFrame, formats: tuple[Format, ...] = BUILT_IN) -> DataFrame:
    """(file, format, required, optional, fits) for many files' ``headers`` arrays at once, in one plan."""
    own = F.transform("headers", lambda h: F.regexp_replace(F.lower(F.trim(h)), r"[\s_.\-]+", ""))
    each = []
    for fmt in formats:
        lists = {k: F.array(*[F.lit(plain(h)) for h in v]).cast("array<string>") for k, v in (("r", fmt.required), ("o", fmt.optional), ("f", fmt.forbidden))}
        n = len(fmt.optional)
        each.append(
            F.struct(
                F.lit(fmt.id).alias("format"),
                F.size(F.array_intersect(lists["r"], F.col("_own"))).alias("required"),
                (F.size(F.array_intersect(lists["o"], F.col("_own"))) / n if n else F.lit(1.0)).alias("optional"),
                ((F.size(F.array_except(lists["r"], F.col("_own"))) == 0) & (F.size(F.array_intersect(lists["f"], F.col("_own"))) == 0)).alias("fits"),
            )
        )
    return headers.withColumn("_own", own).select("file", F.explode(F.array(*each)).alias("_s")).select("file", "_s.*")


def _place(fmt: Format, aliases: tuple[str, ...]):
    """The place of the first alias that a file's plain headers ``_own`` hold, null if none; of equal headers the last."""
    back = F.reverse("_own")
    each = [F.nullif(F.array_position(back, F.lit(plain(a))), F.lit(0)) for a in aliases]
    return (F.size("_own") - F.coalesce(*each)).cast("int") if each else F.lit(None).cast("int")


def routed(rows: DataFrame, delimiter: str = "delimiter", formats: tuple[Format, ...] = BUILT_IN) -> DataFrame:
    """(source_file_id, decision, format, confidence, second) of many files' rows (source_file_id, row, header, fields, delimiter), in one plan.

    The first rows of each file by number are the sample, so no file is sorted; each
    sampled row meets the formats whose headers its file has, and what they say is
    one aggregate a file and format.
    """
    own = F.transform("header", lambda h: F.regexp_replace(F.lower(F.trim(h)), r"[\s_.\-]+", ""))
    # the first non-blank record is the header: numbers of rows begin behind it
    sample = rows.filter(F.col("row") <= CONTENT_SAMPLE + 1).withColumn("_own", own)
    name = F.regexp_extract("source_file_id", r"[^/]*$", 0)
    each = []
    for fmt in formats:
        lists = {k: F.array(*[F.lit(plain(h)) for h in v]).cast("array<string>") for k, v in (("r", fmt.required), ("o", fmt.optional), ("f", fmt.forbidden))}
        fits = (F.size(F.array_except(lists["r"], F.col("_own"))) == 0) & (F.size(F.array_intersect(lists["f"], F.col("_own"))) == 0)
        n = len(set(map(plain, fmt.optional)))
        value = lambda aliases, fmt=fmt: F.get("fields", _place(fmt, aliases))
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        time = F.concat_ws(" ", blank(value(fmt.date)), blank(value(fmt.time))) if fmt.split_time else value(fmt.timestamp)
        timed = _place(fmt, (*fmt.date, *fmt.time) if fmt.split_time else fmt.timestamp).isNotNull()
        kinds = [
            F.when(_place(fmt, fmt.fields[kind]).isNotNull(), F.struct(F.lit(kind.upper()).alias("kind"), value(fmt.fields[kind]).alias("value")))
            for kind in ("imsi", "imei", "msisdn") if kind in fmt.fields
        ]
        each.append(
            F.when(
                fits,
                F.struct(
                    F.lit(fmt.id).alias("format"),
                    (F.size(F.array_intersect(lists["o"], F.col("_own"))) / n if n else F.lit(1.0)).alias("optional"),
                    F.when(F.col(delimiter).isNull() | (F.col(delimiter) == fmt.delimiter), F.lit(1.0)).otherwise(F.lit(0.2)).alias("delimiter"),
                    (F.when(F.regexp_like(name, F.lit(f"(?i){fmt.filename}")), F.lit(1.0)).otherwise(F.lit(0.5)) if fmt.filename else F.lit(None).cast("double")).alias("filename"),
                    F.when(timed, time).alias("raw"),
                    F.filter(F.array(*kinds).cast("array<struct<kind:string,value:string>>"), lambda x: x.isNotNull()).alias("kinds"),
                ),
            )
        )
    shapes = sample.withColumn("_f", ids.once(F.filter(F.array(*each), lambda x: x.isNotNull()))).select("source_file_id", F.explode("_f").alias("_f")).select("source_file_id", "_f.*")
    looked = with_time(shapes, "raw", into="time", package_zone="UTC")
    # a row for each identifier column, or one if a format has none
    cells = looked.select(
        "source_file_id", "format", "optional", "delimiter", "filename", (F.col("time.original") != "").alias("timed"), F.col("time.utc").isNotNull().cast("double").alias("parsed"), F.posexplode_outer("kinds").alias("nth", "k")
    )
    value = F.col("k.value")
    looks = F.when(~ids.is_null_token(value), F.coalesce((ids.inferred(value)["type"] == F.col("k.kind")).cast("double"), F.lit(0.0)))
    keys = ("source_file_id", "format", "optional", "delimiter", "filename")
    first = F.coalesce("nth", F.lit(0)) == 0
    per_kind = cells.withColumn("looks", looks).groupBy(*keys, "nth").agg(
        F.avg("looks").alias("share"), F.sum(F.when(first & F.col("timed"), F.col("parsed"))).alias("parsed"), F.count_if(first & F.col("timed")).alias("timed")
    )
    per = per_kind.groupBy(*keys).agg(
        F.avg(F.when(F.col("nth").isNotNull(), (F.coalesce("share", F.lit(0.0)) >= LOOKS_LIKE).cast("double"))).alias("contents"),
        (F.sum("parsed") / F.nullif(F.sum("timed"), F.lit(0))).alias("timestamp"),
    )
    signals = {
        "required": F.lit(1.0), "optional": F.col("optional"), "delimiter": F.col("delimiter"), "filename": F.col("filename"),
        "contents": F.coalesce("contents", F.lit(NO_IDENTIFIERS)), "timestamp": F.coalesce("timestamp", F.lit(0.0)),
    }
    total = sum((F.coalesce(v * WEIGHTS[k], F.lit(0.0)) for k, v in signals.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(WEIGHTS[k])).otherwise(F.lit(0.0)) for k, v in signals.items()), F.lit(0.0))
    scored = per.select("source_file_id", "format", (total / weight).alias("confidence")).filter(F.col("confidence") >= CANDIDATE)
    best = scored.groupBy("source_file_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("confidence", "format")), asc=False), 1, 2).alias("b"))
    files = rows.select("source_file_id").distinct().join(best, "source_file_id", "left")
    top, second = F.get("b", 0), F.get("b", 1)
    clear = (top["confidence"] >= AUTO) & (F.coalesce(top["confidence"] - second["confidence"], F.lit(1.0)) >= APART)
    decision = F.when(top.isNull(), "NEEDS_MAPPING").when(clear, "AUTO").otherwise("NEEDS_CONFIRMATION")
    return files.select("source_file_id", decision.alias("decision"), top["format"].alias("format"), top["confidence"].alias("confidence"), second["confidence"].alias("second"))
