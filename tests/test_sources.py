"""Delimited text, archives, workbooks, formats and exports on files made here."""

import csv
import io
import json
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from celltrail.operators import normalize
from celltrail.plans import detect, formats
from celltrail.sources import archive, export, tabular, workbook


def split_by_hand(line, d):
    """Quotes toggle; two inside are one."""
    out, field, inside, k = [], "", False, 0
    while k < len(line):
        c = line[k]
        if c == '"':
            if inside and line[k + 1 : k + 2] == '"':
                field, k = field + '"', k + 1
            else:
                inside = not inside
        elif c == d and not inside:
            out.append(field)
            field = ""
        else:
            field += c
        k += 1
    return [*out, field]


@pytest.mark.parametrize("d", [",", "\t", "|"])
def test_fields(spark, d):
    rnd = random.Random(1)
    lines = ["".join(rnd.choice(["a", d, '"', '""', " ", "é", "x"]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select("l", tabular.fields(F.col("l"), d).alias("f")).collect()
    for r in rows:
        assert r.f == split_by_hand(r.l, d), r.l


def test_rows(spark):
    text = '﻿H1,"H,2"\r\n1,"a\nb"\r\n\r\n  \r\n2\n3,4,5'
    rows = tabular.rows(spark.createDataFrame([("f", text)], "file string, text string"), ",").orderBy("row").collect()
    assert [(r.row, r.fields, r.ragged) for r in rows] == [(2, ["1", "a\nb"], False), (3, ["2"], True), (4, ["3", "4", "5"], True)]
    assert rows[0].header == ["H1", "H,2"] and rows[0].raw == '1,"a\nb"'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def test_archive():
    inner = zipped(**{"b.csv": "x,y\n1,2\n"})
    deep = zipped(**{"l2.zip": zipped(**{"l3.zip": inner})})
    data = zipped(**{"a.csv": "x", "../up.csv": "x", "C:\\x.csv": "x", "in.zip": inner, "deep.zip": deep, "bomb.txt": "a" * 2_000_000, "none.txt": ""})
    found = {(o, p): c for o, p, c, *_ in archive.members(data)}
    assert ("MEMBER", "a.csv") in found and ("MEMBER", "in.zip!/b.csv") in found and ("NOTE", "bomb.txt") in found
    assert found["REJECTED", "../up.csv"] == "PATH_TRAVERSAL" and found["REJECTED", "C:\\x.csv"] == "ABSOLUTE_PATH"
    assert "NESTING_TOO_DEEP" in found.values() and not any("none" in p for _, p in found)
    assert [c for *_, c, _, _, _ in archive.members(b"junk")] == ["UNREADABLE"]
    few = [o[2] for o in archive.members(zipped(**{f"{k}.txt": "x" * 50 for k in range(9)}), archive.Limits(members=3))]
    assert few.count(None) == 3 and "TOO_MANY_MEMBERS" in few
    assert [o[2] for o in archive.members(zipped(**{"a.txt": "x" * 50}), archive.Limits(member=10))] == ["MEMBER_TOO_LARGE"]


def book():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped(
        **{
            "[Content_Types].xml": "<Types/>",
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Calls" sheetId="1" r:id="r1"/><sheet name="Blank" sheetId="2" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
            "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>Name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>When</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45366.5</v></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
        }
    )


def test_workbook(spark):
    files = spark.createDataFrame([("f.xlsx", bytearray(book()))], "path string, content binary")
    rows = workbook.read(files).orderBy("sheet").collect()
    assert [r.empty for r in rows] == [True, False]
    assert rows[1].fields == ["rich", "2024-03-15T12:00:00.000Z"] and rows[1].row == 3 and rows[1].formulas and rows[1].raw == "rich\t2024-03-15T12:00:00.000Z\t2"
    assert files.select(workbook.is_workbook(F.lit("x.bin"), F.col("content")).alias("x")).first().x


def calls(n=8):
    head = ["Target Number", "IMSI", "IMEI", "Date/Time", "Cell ID", "Call Type", "Direction", "Duration (sec)", "Other Party", "Site", "Sector", "Technology", "Timing Advance", "RSRP", "Extra"]
    body = [["303555%04d" % k, "310410%09d" % k, "490154203237518", f"03/15/2024 02:{k:02d}:00 PM", f"c{k}", "VOICE", "MO", "10", "611", "100", "A", "LTE", "5", "-85", "note" if k == 1 else ""] for k in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([head, *body, body[0], ["x"] * 3])
    return head, out.getvalue()


def test_file_to_events(spark, tmp_path):
    head, text = calls()
    (tmp_path / "att_dump.csv").write_text(text)
    rows = tabular.read(spark, str(tmp_path), ",")
    found = detect.detect(rows, head, ",", "att_dump.csv")
    assert found[0].format.id == "att.tower-dump" and detect.route(found) == "AUTO"
    events = normalize.events(rows, found[0].format, head, zone="America/New_York")
    kept = {r.row: r for r in normalize.accepted(events).collect()}
    assert str(kept[2].ts_utc) == "2024-03-15 18:00:00" and kept[2].sector_key == "ATT:100:A" and kept[2].technology == "LTE" and kept[2].rsrp == -85
    assert kept[3].unmapped_fields == {"Extra": "note"} and "DUPLICATE_ROW" in kept[10].quality_flags and "DUPLICATE_ROW" not in kept[2].quality_flags
    assert [r.row for r in normalize.rejections(events).collect()] == [11]
    rolled = normalize.warnings(events, normalize.unmapped_columns(found[0].format, head)).collect()
    codes = {r.code: r["count"] for r in rolled}
    order = [("ERROR", "WARNING", "INFO").index(r.severity) for r in rolled]
    assert order == sorted(order) and all(a["count"] >= b["count"] for a, b in zip(rolled, rolled[1:]) if a.severity == b.severity)
    assert next(r.message for r in rolled if r.code == "UNMAPPED_COLUMNS").endswith("their rows: Extra")
    assert next(r.message for r in rolled if r.code == "UNPARSEABLE_TIMESTAMP").endswith("for example x") if "UNPARSEABLE_TIMESTAMP" in codes else True
    assert normalize.summary(events, ["Extra"]).first().unmapped_columns == ["Extra"]
    assert codes["DUPLICATE_ROW"] == 1 and codes["RAGGED_ROW"] == 1 and codes["MISSING_IDENTIFIERS"] == 1
    assert len({r.event_id for r in kept.values()}) == len(kept)


def test_site_lists_are_never_automatic(spark):
    head = ["Cell ID", "Latitude", "Longitude", "Site", "Sector", "Site Name", "Street Address", "Azimuth", "Technology"]
    rows = spark.createDataFrame([(2, ["c", "39.7", "-105.0", "100", "A", "n", "s", "90", "LTE"])], "row int, fields array<string>")
    found = detect.detect(rows, head, ",", "att_cell_sites.csv")
    assert found[0].format.id == "att.cell-site-list" and found[0].confidence == pytest.approx(0.8) and detect.route(found) == "NEEDS_CONFIRMATION"
    sectors = normalize.sectors(rows.withColumn("raw", F.lit("r")), found[0].format, head).first()
    assert (sectors.lat, sectors.lon, sectors.sector_key, sectors.warnings, sectors.dropped) == (39.7, -105.0, "ATT:100:A", ["MISSING_BEAMWIDTH"], False)


def test_exports(spark, tmp_path):
    assert export.csv_head("c", "t", "now", ["a,b"])[-1] == '"a,b"'
    lines = spark.createDataFrame([(k, f"l{k}") for k in range(20)], "o int, line string").repartition(5)
    path = tmp_path / "out.txt"
    for _ in range(2):  # an older file goes
        export.write(lines, str(path), "o", ["head"], ["foot"], separator=",")
    assert path.read_text().splitlines() == ["head", *[f"l{k}," for k in range(19)], "l19", "foot"]
    assert not (tmp_path / "out.txt.parts").exists()
    assert spark.range(1).select(export.cdata(F.lit("a]]>b")).alias("x")).first().x == "<![CDATA[a]]]]><![CDATA[>b]]>"
    assert spark.range(1).select(export.csv_field(F.lit(-85)).alias("x")).first().x == "'-85"


def test_export_files(spark, tmp_path):
    """Whole files: CSV with CR and LF, KML in folders, GeoJSON that a parser reads."""
    rows = spark.createDataFrame([(k, f"n{k}", 40.0 + k, -100.0 - k) for k in range(7)], "k int, name string, lat double, lon double").repartition(3)
    export.write_csv(rows, str(tmp_path / "a.csv"), "k", {"Key": F.col("k"), "Name, full": F.col("name")}, "C-1", "title", "now", ("a note",))
    text = (tmp_path / "a.csv").read_bytes().decode()
    lines = text.split("\r\n")
    assert text.count("\n") == text.count("\r\n") and lines[0].startswith("# ") and "# a note" in lines
    assert list(csv.reader(lines[5:-1])) == [["Key", "Name, full"], *[[str(k), f"n{k}"] for k in range(7)]]

    export.write_geojson(rows.select("k", export.feature(F.col("lat"), F.col("lon"), F.struct("name"), pretty=True).alias("line")), str(tmp_path / "a.json"), "k", "C-1", "here", "now")
    found = json.loads((tmp_path / "a.json").read_text())
    assert [f["geometry"]["coordinates"] for f in found["features"]] == [[-100.0 - k, 40.0 + k] for k in range(7)] and found["properties"]["caveats"]

    sites = rows.withColumns({"site_key": F.col("name"), "carrier": F.lit("X&Y"), "address": F.lit(None).cast("string")})
    sites = sites.select(F.col("k").alias("order"), export.site_mark().alias("line"))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (0, 1), (0, 0))])
    wedges = rows.select(F.col("k").alias("order"), export.wedge(F.col("name"), F.lit(89.5), F.lit(65.0), F.lit(1000.4), ring, F.array(F.lit("a < b"))).alias("line"))
    seen = rows.withColumns(
        {"identifier_key": F.lit("IMEI:1"), "ts_utc": F.lit("2024-01-01 00:00:00").cast("timestamp"), "sector_key": F.col("name"), "event_kind": F.lit("SMS"), "source_file_id": F.lit("f"), "row": F.col("k")}
    ).select(F.col("k").alias("order"), export.observation_mark().alias("line"))
    export.write_kml(sites, wedges, str(tmp_path / "a.kml"), "C-1", "t & u", "now", seen)
    ns = "{http://www.opengis.net/kml/2.2}"
    document = ElementTree.parse(tmp_path / "a.kml").getroot()[0]
    folders = document.findall(f"{ns}Folder")
    assert [f.find(f"{ns}name").text for f in folders] == list(export.FOLDERS) and [len(f.findall(f"{ns}Placemark")) for f in folders] == [7, 7, 7]
    assert "azimuth 90°" in folders[1][1].find(f"{ns}description").text and "<li>a &lt; b</li>" in folders[1][1].find(f"{ns}description").text
    assert folders[2][1].find(f"{ns}TimeStamp/{ns}when").text == "2024-01-01T00:00:00.000Z"
    export.write_kml(sites, wedges, str(tmp_path / "b.kml"), "C-1", "t", "now")
    assert len(ElementTree.parse(tmp_path / "b.kml").getroot()[0].findall(f"{ns}Folder")) == 2


def test_workbook_notes(spark):
    files = spark.createDataFrame([("f.xlsx", bytearray(book()))], "path string, content binary")
    noted = workbook.notes(files)
    codes = {(r.sheet, r.code) for r in noted.collect()}
    assert codes == {("Calls", "FORMULAS"), ("Calls", "DATES"), ("Calls", "CUT_COLUMNS"), ("Blank", "EMPTY"), (None, "SHEETS"), (None, "HASHES")}
    assert [(r.source_file_id, r.sheets) for r in workbook.formula_sheets(noted).collect()] == [("f.xlsx", ["Calls"])]


def test_many_records(spark):
    """Twice the records take about twice as long, and offsets are sums of what stands before."""
    text = "h1,h2\n" + "".join(f'{k},"a\nb{k}"\r\n' for k in range(60_000))
    df = spark.createDataFrame([("f", text)], "file string, text string")
    rows = tabular.rows(df, ",").select("row", "offset", "raw", F.get("fields", 1).alias("second")).collect()
    assert len(rows) == 60_000 and [r.row for r in rows[:3]] == [2, 3, 4] and rows[-1].second == "a\nb59999"
    assert all(text.startswith(r.raw, r.offset) for r in rows[::997])
    assert [r.row for r in tabular.rows(df, ",", limit=5).collect()] == [2, 3, 4, 5, 6]
    assert tabular.rows(df, ",", skip=2).first().row == 4


def test_routes_of_many_files(spark, tmp_path):
    """One plan over many files decides as file by file."""
    head, text = calls()
    (tmp_path / "att_dump.csv").write_text(text)
    (tmp_path / "other.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "att_odd.csv").write_text(text.replace("310410", "9x"))
    sites = "Cell ID,Latitude,Longitude,Site,Sector,Site Name,Street Address,Azimuth,Technology\nc,39.7,-105.0,100,A,n,s,90,LTE\n"
    (tmp_path / "att_cell_sites.csv").write_text(sites)
    rows = tabular.read(spark, str(tmp_path), ",").withColumn("delimiter", F.lit(","))
    found = {r.source_file_id.rsplit("/", 1)[1]: r for r in detect.routed(rows).collect()}
    assert len(found) == 4 and found["other.csv"].decision == "NEEDS_MAPPING" and found["att_dump.csv"].decision == "AUTO"
    for name in ("att_dump.csv", "att_odd.csv", "att_cell_sites.csv"):
        own = rows.filter(F.col("source_file_id").endswith(name))
        one = detect.detect(own, own.first().header, ",", name)
        assert (found[name].decision, found[name].format) == (detect.route(one), one[0].format.id)
        assert found[name].confidence == pytest.approx(one[0].confidence)


def test_stream(spark, tmp_path):
    from celltrail.streaming import ingest

    fmt = next(f for f in formats.BUILT_IN if f.id == "uscellular.tower-dump")
    head = [*fmt.required]
    (tmp_path / "in").mkdir()
    rows = ["|".join(head), "3035550123|310730123456789|20240315143000|c1", "3035550123|310730123456789|20240315143000|c1", "3035550124|310730123456780|20240315143100|c2"]
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows))
    stream = ingest.timed(ingest.rows(spark.readStream.text(str(tmp_path / "in")), fmt), fmt, head, zone="UTC")
    q = ingest.distinct(stream).select("raw", "ts_utc").writeStream.format("memory").queryName("live_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(str(r.ts_utc) for r in spark.table("live_rows").collect()) == ["2024-03-15 14:30:00", "2024-03-15 14:31:00"]
