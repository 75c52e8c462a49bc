"""CSV, KML and GeoJSON with their caveats in the file.

Every row's text is a column. Lines are written by Spark's text sink, sorted by range, as part
files whose order is their names'; :func:`write` then streams the parts into one file, so that
no task and no driver holds an export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evidence import LABELS

CAVEATS = (
    "A record served by a sector says which antenna carried it, not where the device was.",
    "An identifier of a device or subscription does not name a person.",
)
SECTOR_CAVEAT = "The drawn shape of a sector is computed from its azimuth and width; it is not measured coverage."
COLORS = {"OBSERVED": "ff2f7d31", "CALCULATED": "ffb5651d", "INFERRED": "ff8a2be2", "ANALYST_ASSERTED": "ff1f4e9e"}


def xml(c: Column) -> Column:
    """Text with the five characters of markup escaped."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def csv_field(c: Column) -> Column:
    """A field that no spreadsheet takes for a formula, quoted where it must be; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(df: DataFrame, columns: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns.values()])


def csv_head(case: str, title: str, generated: str, headers: list[str], notes: tuple[str, ...] = ()) -> list[str]:
    """The lines in front of the rows."""
    quoted = ['"' + h.replace('"', '""') + '"' if any(c in h for c in '",\r\n') else h for h in headers]
    return [f"# Export {case}: {title}", f"# Generated {generated}", *[f"# {c}" for c in (*CAVEATS, *notes)], ",".join(quoted)]


def ring_text(ring: Column) -> Column:
    """KML coordinates of a ring of struct(x, y)."""
    return F.array_join(F.transform(ring, lambda p: F.concat(F.format_string("%.6f", p["x"]), F.lit(","), F.format_string("%.6f", p["y"]), F.lit(",0"))), " ")


def _point(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("<Point><coordinates>"), F.format_string("%.6f", lon), F.lit(","), F.format_string("%.6f", lat), F.lit(",0</coordinates></Point>"))


def placemark(name: Column, layer: Column, lat: Column, lon: Column, detail: Column, when: Column | None = None) -> Column:
    """A KML point, with the time it stands for if there is one."""
    stamp = F.concat(F.lit("<TimeStamp><when>"), xml(when), F.lit("</when></TimeStamp>")) if when is not None else F.lit("")
    return F.concat(
        F.lit("<Placemark><name>"), xml(name), F.lit("</name><styleUrl>#"), layer, F.lit("</styleUrl>"), stamp, F.lit("<description>"), cdata(detail),
        F.lit("</description>"), _point(lat, lon), F.lit("</Placemark>"),
    )


def table_html(**rows: Column) -> Column:
    """A table of names and values for a placemark; rows without a value are left out."""
    each = [F.concat(F.lit(f"<tr><td>{k.replace('_', ' ')}</td><td>"), xml(v), F.lit("</td></tr>")) for k, v in rows.items()]
    held = [F.when(v.isNotNull(), e) for v, e in zip(rows.values(), each, strict=True)]
    return F.concat(F.lit("<table>"), F.concat_ws("", *held), F.lit("</table>"))


def site_mark() -> Column:
    """The placemark of a carrier's site (site_key, name, carrier, address, lat, lon)."""
    words = F.lit(f"<p>{LABELS['OBSERVED']}: the position is the carrier's, and that of the antennas, not of a device.</p>")
    detail = F.concat(words, table_html(site=F.col("site_key"), carrier=F.col("carrier"), address=F.col("address")))
    return placemark(F.coalesce("name", "site_key"), F.lit("OBSERVED"), F.col("lat"), F.col("lon"), detail)


def observation_mark() -> Column:
    """The placemark of an event at its serving site (identifier_key, ts_utc, sector_key, event_kind, source_file_id, row, lat, lon)."""
    words = F.lit(f"<p>{LABELS['OBSERVED']}: the network noted this identifier in this sector at this time. The mark stands at the site; where in the sector the device was is not known.</p>")
    when = F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    source = F.concat(F.col("source_file_id"), F.lit(" row "), F.col("row").cast("string"))
    detail = F.concat(words, table_html(identifier=F.col("identifier_key"), time=when, sector=F.col("sector_key"), kind=F.col("event_kind"), source=source))
    return placemark(F.concat(F.col("identifier_key"), F.lit(" @ "), when), F.lit("OBSERVED"), F.col("lat"), F.col("lon"), detail, when)


def rounded(c: Column) -> Column:
    """To a whole number, halves up."""
    return F.floor(c + F.lit(0.5)).cast("long")


def wedge(name: Column, azimuth: Column, width: Column, range_m: Column, ring: Column, disclosures: Column | None = None) -> Column:
    """A KML sector; one without an azimuth is said to be a circle of unknown direction. ``disclosures``: an array of what else must be said."""
    known = F.concat(F.lit("azimuth "), rounded(azimuth).cast("string"), F.lit("°, width "), rounded(width).cast("string"), F.lit("°, range "), rounded(range_m).cast("string"), F.lit(" m. "))
    text = F.concat(F.coalesce(known, F.lit("direction unknown, drawn as a circle. ")), F.lit(SECTOR_CAVEAT))
    if disclosures is not None:
        said = F.array_join(F.transform(disclosures, lambda x: F.concat(F.lit("<li>"), xml(x), F.lit("</li>"))), "")
        text = F.concat(text, F.when(F.size(disclosures) > 0, F.concat(F.lit("<ul>"), said, F.lit("</ul>"))).otherwise(F.lit("")))
    return F.concat(
        F.lit("<Placemark><name>"), xml(name), F.lit("</name><styleUrl>#CALCULATED</styleUrl><description>"), cdata(text),
        F.lit("</description><Polygon><altitudeMode>clampToGround</altitudeMode><outerBoundaryIs><LinearRing><coordinates>"), ring_text(ring), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )


def kml_head(case: str, title: str, generated: str = "", zone: str = "UTC") -> list[str]:
    styles = [f'<Style id="{k}"><IconStyle><color>{v}</color></IconStyle><LineStyle><color>{v}</color><width>2</width></LineStyle><PolyStyle><color>4d{v[2:]}</color></PolyStyle></Style>' for k, v in COLORS.items()]
    words = " ".join((*CAVEATS, SECTOR_CAVEAT, "Marks of events stand at the serving site.", f"Times are UTC; the case shows them in {zone}."))
    made = f" Generated {generated}." if generated else ""
    plain = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return ['<?xml version="1.0" encoding="UTF-8"?>', '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', f"<name>{plain(title)} ({plain(case)})</name>", f"<description>{plain(words + made)}</description>", *styles]


KML_FOOT = ["</Document></kml>"]
FOLDERS = ("Cell sites (from the carrier)", "Sector shapes (calculated)", "Observations (from the carrier)")


def kml_lines(sites: DataFrame, sectors: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """(folder, place, order, line): the folders of a KML document with the ``line`` of each of their rows (order, line); no folder without observations."""
    spark = sites.sparkSession
    out = []
    for k, (title, rows) in enumerate(zip(FOLDERS, (sites, sectors, observations), strict=True)):
        if rows is None:
            continue
        ends = spark.createDataFrame([(k, 0, None, f"<Folder><name>{title}</name>"), (k, 2, None, "</Folder>")], "folder int, place int, order string, line string")
        out += [ends, rows.select(F.lit(k).alias("folder"), F.lit(1).alias("place"), F.col("order").cast("string"), "line")]
    held = out[0]
    for more in out[1:]:
        held = held.unionByName(more)
    return held


def feature(lat: Column, lon: Column, properties: Column, pretty: bool = False) -> Column:
    """A GeoJSON feature of a point; over several lines, two blanks a level, if ``pretty``."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
            properties.alias("properties"),
        ),
        {"pretty": "true"} if pretty else {},
    )


def indented(text: Column, blanks: int = 4) -> Column:
    """Every line of a text further in."""
    return F.regexp_replace(text, "(?m)^", " " * blanks)


def geojson_head(case: str, source: str, generated: str = "") -> list[str]:
    import json

    about = json.dumps({"source": source, "case": case, "generated": generated, "caveats": [*CAVEATS, SECTOR_CAVEAT]}, indent=2, ensure_ascii=False)
    return ["{", '  "type": "FeatureCollection",', '  "properties": ' + about.replace("\n", "\n  ") + ",", '  "features": [']


GEOJSON_FOOT = ["  ]", "}"]


def write(lines: DataFrame, path: str, order: str | list[str], head: list[str], foot: list[str] = (), separator: str = "", end: str = "\n") -> None:
    """Write ordered lines (``order``, ``line``) as one file between ``head`` and ``foot``; an older file at ``path`` goes.

    Rows are sorted by range and written as parts beside ``path``; their bytes are then copied
    into the file one after the other.
    """
    spark = lines.sparkSession
    by = [order] if isinstance(order, str) else list(order)
    text = F.col("line")
    if separator:
        last = lines.select(F.max(F.struct(*by)).alias("last")).first()[0]
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.lit(last[c]) if last is not None else F.lit(None))
        text = F.when(same, F.col("line")).otherwise(F.concat("line", F.lit(separator)))
    parts = f"{path}.parts"
    lines.select(*by, text.alias("line")).repartitionByRange(*by).sortWithinPartitions(*by).select("line").write.mode("overwrite").option("lineSep", end).text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    files = target.getFileSystem(conf)
    out = files.create(target, True)
    try:
        out.write(bytearray("".join(x + end for x in head).encode()))
        for part in sorted(s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")):
            held = files.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
            finally:
                held.close()
        out.write(bytearray("".join(x + end for x in foot).encode()))
    finally:
        out.close()
    files.delete(folder, True)


def write_csv(df: DataFrame, path: str, order: str | list[str], columns: dict[str, Column], case: str, title: str, generated: str, notes: tuple[str, ...] = ()) -> None:
    """One CSV file with its caveats in front; lines end in CR and LF."""
    by = [order] if isinstance(order, str) else list(order)
    write(df.select(*by, csv_lines(df, columns).alias("line")), path, by, csv_head(case, title, generated, list(columns), notes), end="\r\n")


def write_kml(sites: DataFrame, sectors: DataFrame, path: str, case: str, title: str, generated: str, observations: DataFrame | None = None, zone: str = "UTC") -> None:
    """One KML document of rows (order, line), in folders."""
    write(kml_lines(sites, sectors, observations), path, ["folder", "place", "order"], kml_head(case, title, generated, zone), KML_FOOT)


def write_geojson(features: DataFrame, path: str, order: str | list[str], case: str, source: str, generated: str) -> None:
    """One GeoJSON collection of rows with a ``line`` of :func:`feature` (``pretty``)."""
    write(features.withColumn("line", indented(F.col("line"))), path, order, geojson_head(case, source, generated), GEOJSON_FOOT, separator=",")
