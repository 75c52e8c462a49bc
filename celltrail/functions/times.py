"""Source timestamps: formats, zones and daylight-saving hazards, without Python on the way.

Parsing happens once, into columns that the later steps read, so that the ladder of
formats stands in the plan a single time.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identifiers import lookup, once, one_of, trimmed

# Zone abbreviations of source files and the regions whose rules they follow.
ZONES = {
    "UTC": "UTC", "GMT": "UTC", "Z": "UTC",
    "EST": "America/New_York", "EDT": "America/New_York", "ET": "America/New_York",
    "CST": "America/Chicago", "CDT": "America/Chicago", "CT": "America/Chicago",
    "MST": "America/Denver", "MDT": "America/Denver", "MT": "America/Denver",
    "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "PT": "America/Los_Angeles",
    "AKST": "America/Anchorage", "AKDT": "America/Anchorage", "HST": "Pacific/Honolulu", "AST": "America/Puerto_Rico",
}
# Formats in the order they are tried; the three with the day first are tried first if asked.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy hh:mm a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
    "MM/dd/yy hh:mm:ss a", "MM/dd/yy HH:mm:ss",
    "dd-MMM-yy hh.mm.ss.SSS a", "dd-MMM-yy hh.mm.ss a", "dd-MMM-yy HH.mm.ss.SSS", "dd-MMM-yy HH.mm.ss", "dd-MMM-yyyy HH:mm:ss",
    "yyyyMMddHHmmss", "yyyyMMddHHmmss.SSS", "dd.MM.yyyy HH:mm:ss", "MM-dd-yyyy HH:mm:ss",
)
DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm")
# Two-digit years over this one are of the last century.
PIVOT = 60
#: Shapes of the ladder that one step of the plan tries.
RUNGS = 8
OLDEST = "1990-01-01 00:00:00"

METHODS = ("SOURCE_EXPLICIT_OFFSET", "SOURCE_DECLARED_ZONE", "PACKAGE_DECLARED_ZONE", "CARRIER_DOCUMENTED_DEFAULT", "NATIVE_UTC", "ASSUMED_UTC", "UNRESOLVED")
CONFIDENCES = ("EXACT", "ZONE_DECLARED", "ZONE_ASSUMED", "DST_AMBIGUOUS", "DST_NONEXISTENT", "UNRESOLVED")

# How a part of a format looks once digits are 9 and letters are A.
_SHAPES = (
    ("yyyy", "9999"), ("yy", "99"), ("MMM", "AAA"), ("MM", "99"), ("dd", "99"), ("HH", "99"), ("hh", "99"), ("mm", "99"), ("SSS", "999"), ("ss", "99"), ("XXX", "-99:99"), (" a", " AA"), ("'T'", "A"),
)
_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def shape(pattern: str) -> str:
    """What a text of a format looks like; Spark's own parser is laxer."""
    out, at = "", 0
    while at < len(pattern):
        for token, looks in _SHAPES:
            if pattern.startswith(token, at):
                out, at = out + looks, at + len(token)
                break
        else:
            out, at = out + pattern[at], at + 1
    return out


def shape_of(text: Column) -> Column:
    """The shape of a text; the sign of an offset at its end is always a minus."""
    plain = F.translate(text, _DIGITS + _LETTERS, "9" * len(_DIGITS) + "A" * len(_LETTERS))
    return F.when(F.left(F.right(plain, F.lit(6)), F.lit(1)) == "+", F.concat(F.left(plain, F.length(plain) - 6), F.lit("-"), F.right(plain, F.lit(5)))).otherwise(plain)


def canonical_zone(text: str | None) -> str | None:
    """A zone that Spark knows, of an abbreviation, an offset or a region's name; None if it is none."""
    import re

    name = (text or "").strip()
    if not name:
        return None
    if name.upper() in ZONES:
        return ZONES[name.upper()]
    if m := re.fullmatch(r"(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?", name.upper()):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if not hours and not minutes:
            return "UTC"
        return f"UTC{m[1]}{hours}" + (f":{minutes:02d}" if minutes else "") if hours <= 18 else None
    return name if name in available_timezones() else None


def zone_column(raw: Column) -> Column:
    """:func:`canonical_zone` of a column."""
    text = trimmed(raw)
    upper = F.upper(text)
    sign = F.regexp_extract(upper, r"^(?:UTC|GMT)?\s*([+-])([0-9]{1,2})(?::?([0-9]{2}))?$", 1)
    hours = F.regexp_extract(upper, r"^(?:UTC|GMT)?\s*([+-])([0-9]{1,2})(?::?([0-9]{2}))?$", 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(upper, r"^(?:UTC|GMT)?\s*([+-])([0-9]{1,2})(?::?([0-9]{2}))?$", 3).try_cast("int"), F.lit(0))
    offset = F.when((hours == 0) & (minutes == 0), F.lit("UTC")).otherwise(
        F.concat(F.lit("UTC"), sign, hours.cast("string"), F.when(minutes > 0, F.concat(F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise(F.lit("")))
    )
    known = one_of(text, tuple(sorted(available_timezones())))
    return F.coalesce(lookup(upper, ZONES), F.when((sign != "") & (hours <= 18), offset), F.when(known, text))


def _local(text: Column, pattern: str) -> Column:
    """The wall clock that a text of a format's shape shows, null if it is none."""
    if "MMM" in pattern:  # months in any case, halves of the day in capitals
        text = F.initcap(F.lower(text))
    if pattern.endswith(" a"):
        text = F.concat(F.left(text, F.length(text) - 2), F.upper(F.right(text, F.lit(2))))
    if "yyyy" not in pattern:  # two-digit years by a pivot of our own
        place = pattern.index("yy")
        two = F.substring(text, place + 1, 2)
        century = F.when(two.try_cast("int") > PIVOT, F.lit("19")).otherwise(F.lit("20"))
        text = F.concat(F.left(text, F.lit(place)), century, F.substring(text, place + 1, 64))
        pattern = pattern.replace("yy", "yyyy")
    return F.try_to_timestamp(text, F.lit(pattern))


def _tried(text: Column, looks: Column, ladder: tuple[str, ...]) -> list[Column]:
    """struct(local, format) of the first format that a text fits, in a few columns of which one at most is not null.

    A text's shape leaves one or two formats to try. Each column is code of its own: the
    whole ladder at once is more than a method of generated code may hold.
    """
    by: dict[str, list[str]] = {}
    for pattern in ladder:
        by.setdefault(shape(pattern), []).append(pattern)
    out, keys = [], list(by)
    for at in range(0, len(keys), RUNGS):
        found = None
        for key in keys[at : at + RUNGS]:
            each = [F.struct(_local(text, p).alias("local"), F.lit(p).alias("format")) for p in by[key]]
            first = F.coalesce(*[F.when(e["local"].isNotNull(), e) for e in each])
            found = F.when(looks == key, first) if found is None else found.when(looks == key, first)
        out.append(found)
    return out


#: Texts of the last resort: ISO, a mail's date, and a web server's dates of now and of old, with what parses them.
_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?))?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
_MAIL = r"^(?:[A-Za-z]{3}, *)?([0-9]{1,2} +[A-Za-z]{3} +[0-9]{2,4} +[0-9]{2}:[0-9]{2}(?::[0-9]{2})?) +(UT|GMT|UTC|Z|[ECMP][SD]T|[+-][0-9]{4})$"
_WEB = r"^(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, ([0-9]{2}-[A-Za-z]{3}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$"
_C = r"^[A-Za-z]{3} ([A-Za-z]{3} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4})$"
# Hours that a mail's zone names stand for.
_MAIL_ZONES = {"UT": "+00:00", "GMT": "+00:00", "UTC": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}


def _last_resort(text: Column) -> Column:
    """struct(local, format, offset) of an ISO, mail or web date; ``local`` is already UTC if there is an offset."""
    mail = F.regexp_replace(F.regexp_extract(text, _MAIL, 1), " +", " ")
    zone = F.regexp_extract(text, _MAIL, 2)
    offset = F.coalesce(lookup(zone, _MAIL_ZONES), F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2))))
    years = F.regexp_extract(mail, "^[0-9]+ [A-Za-z]+ ([0-9]{2}) ", 1).try_cast("int")
    two = F.regexp_replace(mail, F.lit("^([0-9]+ [A-Za-z]+) ([0-9]{2}) "), F.when(years > PIVOT, "$1 19$2 ").otherwise("$1 20$2 "))
    full = F.when(two.rlike(":[0-9]{2}:"), two).otherwise(F.concat(two, F.lit(":00")))
    web, c = F.regexp_extract(text, _WEB, 1), F.regexp_extract(text, _C, 1)

    def is_(local: Column, name: str, at: Column) -> Column:
        return F.struct(local.alias("local"), F.lit(name).alias("format"), at.alias("offset"))

    return (
        F.when(text.rlike(_ISO), is_(text.try_cast("timestamp"), "ISO-8601 (permissive)", F.lit(None).cast("string")))
        .when(text.rlike(_MAIL), is_(F.try_to_timestamp(F.concat(full, F.lit(" "), offset), F.lit("d MMM yyyy HH:mm:ss xxx")), "RFC 2822", offset))
        .when(text.rlike(_WEB), is_(_local(web, "dd-MMM-yy HH:mm:ss"), "HTTP date", F.lit("+00:00")))
        .when(text.rlike(_C), is_(F.try_to_timestamp(F.regexp_replace(c, " +", " "), F.lit("MMM d HH:mm:ss yyyy")), "HTTP date", F.lit("+00:00")))
    )


def with_time(
    df: DataFrame, raw: str, into: str = "time", row_zone: str | None = None, package_zone: str | None = None,
    carrier_zone: str | None = None, day_first: bool = False,
) -> DataFrame:
    """``df`` with a struct ``into``: original, utc, source_zone, method, confidence, matched_format, alternatives, warning.

    Needs the session's time zone to be UTC. A text that no format fits keeps its
    original and is UNRESOLVED.
    """
    names = df.columns
    text = trimmed(F.col(raw).cast("string"))
    epoch = F.when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("long"))).when(
        text.rlike("^[0-9]{13}$"), F.timestamp_millis(text.try_cast("long"))
    )
    cut = F.regexp_replace(text, r"([.,][0-9]{3})[0-9]+(?=[^0-9]|$)", "$1")
    abbreviation = F.regexp_extract(cut, r"\s+\(?([A-Z]{1,4})\)?$", 1)
    named = lookup(abbreviation, ZONES)
    bare = F.when(named.isNotNull(), trimmed(F.regexp_replace(cut, r"\s+\(?[A-Z]{1,4}\)?$", ""))).otherwise(cut)
    zulu = bare.rlike("[0-9][Zz]$")
    body = F.when(zulu, F.regexp_replace(bare, "[Zz]$", "")).otherwise(bare)
    body = F.when(body.rlike("^[0-9]{17}$"), F.concat(F.left(body, F.lit(14)), F.lit("."), F.right(body, F.lit(3)))).otherwise(body)
    df = df.select("*", text.alias("_text"), epoch.alias("_epoch"), once(named).alias("_named"), F.coalesce(zulu, F.lit(False)).alias("_zulu"), once(body).alias("_body"))

    ladder = (*DAY_FIRST, *FORMATS) if day_first else (*FORMATS, *DAY_FIRST)
    df = df.withColumn("_looks", once(shape_of(F.col("_body"))))
    steps = _tried(F.col("_body"), F.col("_looks"), ladder)
    for k, step in enumerate(steps):
        df = df.withColumn(f"_tried_{k}", once(step))
    first = F.coalesce(*[F.col(f"_tried_{k}") for k in range(len(steps))])
    df = df.withColumn("_first", once(first))
    known = F.struct(F.col("_first.local").alias("local"), F.col("_first.format").alias("format"), F.lit(None).cast("string").alias("offset"))
    df = df.withColumn("_last", once(F.when(F.col("_first").isNull(), _last_resort(F.col("_text")))))
    df = df.withColumn("_hit", once(F.coalesce(F.when(F.col("_first").isNotNull(), known), F.when(F.col("_last.local").isNotNull(), F.col("_last")))))

    row = zone_column(F.col(row_zone)) if row_zone else F.lit(None).cast("string")
    package, carrier = canonical_zone(package_zone), canonical_zone(carrier_zone)
    choice = [
        (F.col("_zulu"), F.lit("UTC"), "NATIVE_UTC", "EXACT"),
        (F.col("_named").isNotNull(), F.col("_named"), "SOURCE_DECLARED_ZONE", "ZONE_DECLARED"),
        (row.isNotNull(), row, "SOURCE_DECLARED_ZONE", "ZONE_DECLARED"),
        (F.lit(package is not None), F.lit(package), "PACKAGE_DECLARED_ZONE", "ZONE_DECLARED"),
        (F.lit(carrier is not None), F.lit(carrier), "CARRIER_DOCUMENTED_DEFAULT", "ZONE_ASSUMED"),
    ]
    zone, method, sure = F.lit("UTC"), F.lit("ASSUMED_UTC"), F.lit("ZONE_ASSUMED")
    for condition, z, m, c in reversed(choice):
        zone, method, sure = F.when(condition, z).otherwise(zone), F.when(condition, F.lit(m)).otherwise(method), F.when(condition, F.lit(c)).otherwise(sure)
    offset = F.regexp_extract(F.col("_text"), r"([+-][0-9]{2}:?[0-9]{2})$", 1)
    iso = (F.col("_hit.format") == "ISO-8601 (permissive)") & F.col("_text").rlike(r"[+-][0-9]{2}:?[0-9]{2}$|[Zz]$")
    carried = F.col("_hit.format").endswith("XXX") | F.col("_hit.offset").isNotNull() | iso
    df = df.select(
        "*",
        F.coalesce(carried, F.lit(False)).alias("_carried"),
        F.coalesce(zone, F.lit("UTC")).alias("_zone"), method.alias("_method"), sure.alias("_sure"),
        F.concat(F.lit("UTC"), F.coalesce(F.nullif("_hit.offset", F.lit("+00:00")), offset)).alias("_offset"),
    )
    df = df.withColumn("_utc", once(F.when(F.col("_carried"), F.col("_hit.local")).otherwise(F.to_utc_timestamp(F.col("_hit.local"), F.col("_zone")))))
    hour = F.expr("INTERVAL 1 HOUR")
    local, utc = F.col("_hit.local"), F.col("_utc")
    gap = ~F.col("_carried") & (F.from_utc_timestamp(utc, F.col("_zone")) != local)
    # a zone that goes back by half an hour needs its own test
    again = ~F.col("_carried") & ~gap & ((F.from_utc_timestamp(utc + hour, F.col("_zone")) == local) | (F.from_utc_timestamp(utc - hour, F.col("_zone")) == local))
    early = F.when(F.from_utc_timestamp(utc - hour, F.col("_zone")) == local, utc - hour).otherwise(utc)
    hit, on_epoch = F.col("_hit").isNotNull(), F.col("_epoch").isNotNull()
    confidence = (
        F.when(on_epoch, "EXACT").when(~hit, "UNRESOLVED").when(F.col("_carried"), "EXACT").when(again, "DST_AMBIGUOUS").when(gap, "DST_NONEXISTENT").otherwise(F.col("_sure"))
    )
    df = df.withColumn("_confidence", confidence)
    sure = F.col("_confidence")
    warning = (
        F.when(sure == "UNRESOLVED", F.when(F.coalesce(F.col("_text"), F.lit("")) == "", "no timestamp").otherwise("no known format; kept as it is"))
        .when(sure == "DST_AMBIGUOUS", "this local time comes twice; both readings are kept")
        .when(sure == "DST_NONEXISTENT", "this local time was skipped; the declared zone may be wrong")
        .when((sure == "ZONE_ASSUMED") & (F.col("_method") == "ASSUMED_UTC"), "no zone was stated anywhere; UTC was assumed")
        .when(sure == "ZONE_ASSUMED", "no zone was stated; the format's default was assumed")
    )
    out = F.struct(
        F.coalesce(F.col("_text"), F.lit("")).alias("original"),
        F.coalesce(F.col("_epoch"), utc).alias("utc"),
        F.when(on_epoch, "UTC").when(F.col("_carried"), F.col("_offset")).when(hit, F.col("_zone")).alias("source_zone"),
        F.when(on_epoch, "NATIVE_UTC").when(~hit, "UNRESOLVED").when(F.col("_carried"), "SOURCE_EXPLICIT_OFFSET").otherwise(F.col("_method")).alias("method"),
        sure.alias("confidence"),
        F.when(F.col("_text").rlike("^[0-9]{10}$") & on_epoch, "epoch seconds").when(on_epoch, "epoch milliseconds").otherwise(F.col("_hit.format")).alias("matched_format"),
        F.when(sure == "DST_AMBIGUOUS", F.array(early, early + hour)).alias("alternatives"),
        warning.alias("warning"),
    )
    return df.select(*[c for c in names if c != into], out.alias(into))


def display(utc: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC time as a zone's clock shows it, with the zone's name."""
    return F.concat(F.date_format(F.from_utc_timestamp(utc, zone), pattern), F.lit(f" {zone}"))


def window(start: Column, end: Column) -> Column:
    """struct(start, end), both inclusive; a window that ends before it starts is an error."""
    return F.when(end >= start, F.struct(start.alias("start"), end.alias("end"))).otherwise(
        F.raise_error(F.lit("a time window ends before it starts")).cast("struct<start:timestamp,end:timestamp>")
    )


def window_around(instant: Column, before_minutes: int, after_minutes: int) -> Column:
    minute = F.expr("INTERVAL 1 MINUTE")
    return F.struct((instant - minute * before_minutes).alias("start"), (instant + minute * after_minutes).alias("end"))


def window_holds(w: Column, instant: Column) -> Column:
    return instant.between(w["start"], w["end"])


def window_seconds(w: Column) -> Column:
    return w["end"].cast("double") - w["start"].cast("double")
