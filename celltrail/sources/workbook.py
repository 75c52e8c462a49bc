"""XLSX workbooks with the standard library: every sheet as rows of text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def is_workbook(name: Column, content: Column | None = None) -> Column:
    """By its name, or by its first bytes."""
    named = F.lower(name).rlike(r"\.(xlsx|xlsm)$")
    if content is None:
        return named
    head = F.substring(content, 1, 200)
    part = "[Content_Types].xml".encode().hex().upper()
    return named | (F.hex(F.substring(content, 1, 4)).isin("504B0304") & F.contains(F.hex(head), F.lit(part)))


def canonical_row(cells: Column) -> Column:
    """Cells with tabs between, empty ones at the end left out; rows of sheets are hashed in this form."""
    return F.regexp_replace(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "\t"), "\t+$", "")


def row_hash(cells: Column) -> Column:
    return F.sha2(canonical_row(cells), 256)


def _text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _date(text: str, from_1904: bool) -> str:
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(milliseconds=round(float(text) * 86_400_000))
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def _column(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]*", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def sheets(data: bytes) -> Iterator[tuple[str, list[tuple[int, list[str]]], bool, bool]]:
    """(name, rows with their worksheet numbers, whether there are formulas, whether there are dates) of each sheet; blank rows are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())

    def part(name: str):
        return ElementTree.fromstring(z.read(name)) if name in names else None

    shared = [_text_of(s) for s in part("xl/sharedStrings.xml") or ()]
    dates: list[bool] = []
    if (styles := part("xl/styles.xml")) is not None:
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        formats = styles.find(f"{_MAIN}cellXfs")
        for x in formats if formats is not None else ():
            k = int(x.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
            dates.append(k in DATE_FORMATS or (k in own and bool(re.search("[dmyhs]", code, re.I)) and "General" not in code))
    book = part("xl/workbook.xml")
    from_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr"))
    targets = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels") or ()}
    for sheet in book.iter(f"{_MAIN}sheet"):
        target = targets.get(sheet.get(f"{_REL}id"), "").lstrip("/")
        root = part(target if target.startswith("xl/") else f"xl/{target}")
        rows, formulas, dated = [], False, False
        for number, row in enumerate(root.iter(f"{_MAIN}row") if root is not None else (), 1):
            cells: dict[int, str] = {}
            for place, c in enumerate(row.iter(f"{_MAIN}c")):
                value, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
                formulas = formulas or c.find(f"{_MAIN}f") is not None
                raw = value.text or "" if value is not None else ""
                if kind == "inlineStr":
                    text = _text_of(c)
                elif kind == "s":
                    text = shared[int(raw)] if raw else ""
                elif kind == "b":
                    text = "true" if raw == "1" else "false"
                elif kind in ("str", "e", "d") or not raw:
                    text = raw
                else:
                    style = int(c.get("s", 0))
                    is_date = style < len(dates) and dates[style]
                    dated = dated or is_date
                    text = _date(raw, from_1904) if is_date else _number(raw)
                cells[_column(c.get("r", "")) if c.get("r") else place] = text
            if any(t.strip() for t in cells.values()):
                rows.append((int(row.get("r", number)), [cells.get(k, "") for k in range(max(cells) + 1)]))
        yield sheet.get("name"), rows, formulas, dated


SCHEMA = "source_file_id string, sheet string, row int, header array<string>, fields array<string>, raw string, formulas boolean, empty boolean"


def read(files: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of all sheets of a ``binaryFile`` scan; the first populated row behind ``skip`` ones is a sheet's header.

    Columns behind the last named one are cut from the fields and stay in ``raw``; a sheet
    without rows is one row that is ``empty``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for name, rows, formulas, _ in sheets(bytes(content)):
                    rows = rows[skip:]
                    if not rows:
                        out.append((path, name, None, [], [], None, formulas, True))
                        continue
                    header = [h.strip() for h in rows[0][1]]
                    while header and not header[-1]:
                        header.pop()
                    for number, cells in rows[1 : None if limit is None else limit + 1]:
                        padded = (cells + [""] * len(header))[: len(header)]
                        out.append((path, name, number, header, padded, re.sub("\t+$", "", "\t".join(cells)), formulas, False))
            if out:
                yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype({"row": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


NOTES = {
    "EMPTY": "the sheet has no row with a value",
    "CUT_COLUMNS": "{n} columns at the right have no name: they take no part in the mapping, their values stay with the rows",
    "FORMULAS": "the sheet holds formulas, which a carrier's own export does not: the file was made or changed afterwards; the stored results were read, find out where it comes from",
    "DATES": "date cells are given in ISO form from the stored numbers, as what a spreadsheet shows depends on the machine",
    "SHEETS": "the workbook has {n} sheets ({names}); each is a table of its own",
    "HASHES": "rows of a workbook have no bytes of their own: their hashes are taken over the cells with tabs between, without empty ones at the end; the file's hash is over its bytes",
}


def notes(files: DataFrame, skip: int = 0) -> DataFrame:
    """(source_file_id, sheet, code, note) of every workbook of a ``binaryFile`` scan; a note on the whole file has no sheet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                names = []
                for name, rows, formulas, dated in sheets(bytes(content)):
                    names.append(name)
                    rows = rows[skip:]
                    if not rows:
                        out.append((path, name, "EMPTY", NOTES["EMPTY"]))
                        continue
                    width = max(len(cells) for _, cells in rows)
                    named = max((k + 1 for k, h in enumerate(rows[0][1]) if h.strip()), default=0)
                    if named < width:
                        out.append((path, name, "CUT_COLUMNS", NOTES["CUT_COLUMNS"].format(n=width - named)))
                    out += [(path, name, code, NOTES[code]) for code, holds in (("FORMULAS", formulas), ("DATES", dated)) if holds]
                if len(names) > 1:
                    out.append((path, None, "SHEETS", NOTES["SHEETS"].format(n=len(names), names=", ".join(names))))
                out.append((path, None, "HASHES", NOTES["HASHES"]))
            if out:
                yield pd.DataFrame(out, columns=["source_file_id", "sheet", "code", "note"])

    return files.select("path", "content").mapInPandas(run, "source_file_id string, sheet string, code string, note string")


def formula_sheets(noted: DataFrame) -> DataFrame:
    """(source_file_id, sheets) of the workbooks with formulas."""
    return noted.filter("code = 'FORMULAS'").groupBy("source_file_id").agg(F.array_sort(F.collect_set("sheet")).alias("sheets"))
