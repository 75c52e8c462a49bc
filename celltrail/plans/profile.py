"""Files of no known format: what their columns hold, and a mapping to propose."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.times import with_time

# Sample sizes, thresholds, and which headers hint at which field.
SAMPLE, VOTES, PARSED, APPROVAL = 200, 50, 30, 0.85
HINTS = (
    ("timestamp", 0.45, ("date.*time", "timestamp", "^date$", "event.*d(t|tm|ate)", "call.*date")),
    ("msisdn", 0.45, ("msisdn", "mdn", "^min$", "subscriber.*n(br|um)", "target.*num", "phone", "mobile.*num")),
    ("imsi", 0.5, ("imsi",)),
    ("imei", 0.5, ("imei", "equipment.*id", "esn", "meid")),
    ("iccid", 0.5, ("iccid", "sim.*(id|serial)")),
    ("raw_cell_id", 0.45, ("cell.*id", "cgi", "cell.*identity", "^cell$")),
    ("site_id", 0.4, ("site", "enodeb", "^enb$", "cell.*site", "tower")),
    ("sector_id", 0.4, ("sector", "^sect", "face")),
    ("lac", 0.5, ("^lac$", "location.*area")),
    ("tac", 0.5, ("^tac$", "tracking.*area")),
    ("technology", 0.45, ("^rat$", "technology", "network.*type", "air.*interface")),
    ("event_kind", 0.4, ("call.*type", "event.*type", "seizure", "^type$", "event.*cd")),
    ("direction", 0.45, ("direction", "^dir", "in.*out", "orig.*term")),
    ("duration_sec", 0.45, ("duration", "^dur", "elapsed", "call.*length")),
    ("other_party", 0.4, ("other.*(party|num)", "dialed", "called.*num", "calling.*num", "correspondent")),
    ("timing_advance", 0.5, ("timing.*advance", "^ta$", "ta.*val", "^ta_")),
    ("lat", 0.5, ("lat(itude)?", "lat.*dec")),
    ("lon", 0.5, ("lon(gitude)?", "^lng$", "lon.*dec")),
    ("azimuth", 0.5, ("azimuth", "bearing", "orientation")),
    ("beam_width", 0.5, ("beam.*width", "^bw$", "horiz.*beam")),
)
DEVICE_FIELDS = ("msisdn", "imsi", "imei", "iccid")


def profile(rows: DataFrame) -> DataFrame:
    """(position, header, populated, distinct_ratio, samples, kind, identifier_type) of each column of sampled rows (row, header, fields)."""
    sample = rows.orderBy("row").limit(SAMPLE)
    cells = sample.select("row", "header", F.posexplode("fields").alias("position", "value")).withColumn("header", F.get("header", "position"))
    used = ~ids.is_null_token(F.col("value"))
    cells = with_time(cells.withColumn("used", used), "value", package_zone="UTC")
    nth = F.row_number().over(Window.partitionBy("position", "used").orderBy("row"))
    first = F.row_number().over(Window.partitionBy("position", "used", "value").orderBy("row"))
    number = F.regexp_replace("value", r"[^0-9.eE+-]", "").try_cast("double")
    cells = cells.withColumns({"nth": nth, "first": first, "vote": F.when(F.col("used"), ids.inferred(F.col("value"))["type"]), "number": number})
    voting, timing = F.col("used") & (F.col("nth") <= VOTES), F.col("used") & (F.col("nth") <= PARSED)
    votes = cells.filter(voting & F.col("vote").isNotNull()).groupBy("position", "vote").agg(F.count("*").alias("n"), F.min("row").alias("at"))
    top = votes.groupBy("position").agg(F.max_by("vote", F.struct("n", -F.col("at"))).alias("vote"), F.max("n").alias("votes"))
    # the column has ``value`` text of 200 rows at most: the distinct ones are few
    per = cells.groupBy("position", "header").agg(
        F.count("*").alias("rows"),
        F.count_if("used").alias("used"),
        F.count_if(F.col("used") & (F.col("first") == 1)).alias("distinct"),
        F.count_if(voting).alias("voters"),
        F.count_if(timing & F.col("time.utc").isNotNull()).alias("times"),
        F.count_if(timing).alias("timed"),
        F.count_if(voting & F.col("number").isNotNull()).alias("numbers"),
        F.coalesce(F.bool_and(F.when(voting & F.col("number").isNotNull(), F.abs("number") <= 180)), F.lit(True)).alias("degrees"),
        F.coalesce(F.bool_or(voting & F.col("value").rlike(r"\.[0-9]{3,}")), F.lit(False)).alias("fine"),
        F.max(F.when(F.col("used"), F.length("value"))).alias("longest"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("used") & (F.col("first") == 1), F.struct("row", "value")))), lambda s: s["value"]), 1, 5).alias("samples"),
    )
    numeric = F.col("numbers") >= 0.9 * F.col("voters")
    kind = (
        F.when(F.col("used") == 0, "EMPTY")
        .when(F.coalesce(F.col("votes"), F.lit(0)) >= 0.7 * F.col("voters"), "IDENTIFIER")
        .when(F.col("times") >= 0.8 * F.col("timed"), "TIMESTAMP")
        .when(numeric & F.col("degrees") & F.col("fine"), "COORDINATE")
        .when(numeric, "NUMERIC")
        .when((F.col("distinct") <= 12) & (F.col("longest") <= 20), "CODE")
        .otherwise("TEXT")
    )
    return per.join(top, "position", "left").withColumn("kind", kind).select(
        "position", "header", (F.col("used") / F.col("rows")).alias("populated"),
        F.when(F.col("used") > 0, F.col("distinct") / F.col("used")).otherwise(F.lit(0.0)).alias("distinct_ratio"),
        "samples", "kind", F.when(F.col("kind") == "IDENTIFIER", F.col("vote")).alias("identifier_type"),
    )


def agreement(field: Column) -> Column:
    """How well a column's values agree with a field, from its profile."""
    kind, kind_of_id = F.col("kind"), F.coalesce(F.col("identifier_type"), F.lit(""))
    wanted = F.when(field.isin("msisdn", "other_party"), "MSISDN").when(field.isin("imsi", "imei", "iccid"), F.upper(field))
    return (
        F.when((field == "timestamp") & (kind == "TIMESTAMP"), 1.0)
        .when(wanted == kind_of_id, 1.0)
        .when(field.isin("lat", "lon") & (kind == "COORDINATE"), 1.0)
        .when(field.isin("duration_sec", "timing_advance", "azimuth", "beam_width") & (kind == "NUMERIC"), 0.7)
        .when(field.isin("direction", "event_kind", "technology") & (kind == "CODE"), 0.7)
        .otherwise(0.0)
    )


def candidates(profiles: DataFrame) -> DataFrame:
    """(field, position, header, confidence, order) of every field that a header or the values hint at."""
    hints = F.array(*[F.struct(F.lit(f).alias("field"), F.lit("(?i)" + "|".join(f"(?:{p})" for p in ps)).alias("pattern"), F.lit(w).alias("weight"), F.lit(k).alias("order")) for k, (f, w, ps) in enumerate(HINTS)])
    pairs = profiles.withColumn("h", F.explode(hints)).select("*", "h.*")
    named = F.regexp_like(F.col("header"), F.col("pattern"))
    value = agreement(F.col("field"))
    scored = pairs.withColumns({"named": named, "value": value}).filter("named OR value >= 0.9")
    return scored.select(
        "field", "position", "header", F.least(F.lit(1.0), F.col("weight") * F.col("named").cast("double") + F.lit(0.55) * F.col("value")).alias("confidence"), "order", "named", "value", "samples"
    )


def suggest(profiles: DataFrame) -> dict:
    """A one-to-one proposal: pairs by descending confidence as long as both sides are free, and what stands in its way.

    The pairs of one file are few (columns times twenty), so they are matched here.
    """
    taken: dict[str, dict] = {}
    columns: set[int] = set()
    for row in candidates(profiles).orderBy(F.col("confidence").desc(), "order", "position").collect():
        if row["field"] in taken or row["position"] in columns:
            continue
        columns.add(row["position"])
        reason = " and ".join(filter(None, [row["named"] and f"the header {row['header']!r} says so", row["value"] > 0 and f"values such as {', '.join(row['samples'][:3])} agree"]))
        taken[row["field"]] = {"header": row["header"], "confidence": row["confidence"], "requires_approval": row["confidence"] < APPROVAL, "reason": reason}
    blockers = [] if "timestamp" in taken else ["no timestamp column"]
    blockers += [] if any(f in taken for f in DEVICE_FIELDS) else ["no column identifies a device"]
    return {"mapping": taken, "blockers": blockers}


def matches(field: str, header: str) -> bool:
    """Whether a header hints at a field."""
    return any(re.search(p, header, re.I) for f, _, ps in HINTS if f == field for p in ps)
