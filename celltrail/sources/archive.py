"""ZIP productions: members, rejections and notes, from untrusted files."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default limits.
MAX_TOTAL, MAX_MEMBER, MAX_MEMBERS, MAX_DEPTH, NOTED_RATIO = 2 << 30, 512 << 20, 10_000, 2, 200
REJECTIONS = (
    "PATH_TRAVERSAL", "ABSOLUTE_PATH", "MEMBER_TOO_LARGE", "TOTAL_TOO_LARGE",
    "TOO_MANY_MEMBERS", "NESTING_TOO_DEEP", "SUSPICIOUS_RATIO", "UNREADABLE",
)
OFFICE = r"\.(xlsx|xlsm|xltx|docx|pptx)$"


@dataclass(frozen=True)
class Limits:
    total: int = MAX_TOTAL
    member: int = MAX_MEMBER
    members: int = MAX_MEMBERS
    depth: int = MAX_DEPTH
    ratio: int = NOTED_RATIO


def path_problem(path: Column) -> Column:
    """ABSOLUTE_PATH, PATH_TRAVERSAL, or null for a path that stays inside."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.rlike("^(/|[A-Za-z]:)"), "ABSOLUTE_PATH").when(F.array_contains(F.split(p, "/"), ".."), "PATH_TRAVERSAL")


def is_zip(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506")


def is_office(name: Column) -> Column:
    return F.lower(name).rlike(OFFICE)


def member_kind(name: Column) -> Column:
    """struct(kind, parseable, note) of a file by its name's end; what is not parsed stays evidence, and the note says what to do."""
    n = F.lower(name)

    def is_(kind: str, note: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(note is None).alias("parseable"), F.lit(note).cast("string").alias("note"))

    return (
        F.when(n.rlike(r"\.(csv|tsv|txt|tab|dat)$"), is_("TABULAR"))
        .when(n.rlike(r"\.(xlsx|xlsm)$"), is_("SPREADSHEET"))
        .when(n.rlike(r"\.xls$"), is_("SPREADSHEET", "an old binary workbook: save it as .xlsx or CSV, note that in the case, then import"))
        .when(n.rlike(r"\.(xml|json)$"), is_("STRUCTURED", "needs a mapping before it can be imported"))
        .when(n.rlike(r"\.(kml|kmz)$"), is_("GEOSPATIAL", "kept as evidence; maps are loaded as layers"))
        .when(n.rlike(r"\.(pdf|docx?|rtf)$"), is_("DOCUMENT", "kept beside the records; a cover letter often says which time zone they are in, so read it first"))
        .otherwise(is_("UNKNOWN", "kept, not parsed: of no known kind"))
    )


def _unsafe(name: str) -> str | None:
    p = name.replace("\\", "/")
    if re.match(r"/|[A-Za-z]:", p):
        return "ABSOLUTE_PATH"
    return "PATH_TRAVERSAL" if ".." in p.split("/") else None


def members(data: bytes, limits: Limits = Limits()) -> Iterator[tuple[str, str, str | None, bytes | None, str | None, int]]:
    """(outcome, path, code, content, sha256, depth) of everything in an archive, nested ones included.

    Sizes are taken from the directory before anything is inflated, and checked again
    while reading, so a lying directory costs no more than the limit.
    """
    used = {"total": 0, "members": 0}

    def walk(raw: bytes, prefix: str, depth: int):
        try:
            held = zipfile.ZipFile(io.BytesIO(raw))
            entries = held.infolist()
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
            yield "REJECTED", prefix.rstrip("!/") or "archive", "UNREADABLE", None, None, depth
            return
        for entry in entries:
            if entry.is_dir() or not entry.file_size:
                continue
            path = prefix + entry.filename
            if problem := _unsafe(entry.filename):
                yield "REJECTED", path, problem, None, None, depth
                continue
            if entry.file_size > limits.member:
                yield "REJECTED", path, "MEMBER_TOO_LARGE", None, None, depth
                continue
            if used["members"] >= limits.members:
                yield "REJECTED", path, "TOO_MANY_MEMBERS", None, None, depth
                return
            if used["total"] + entry.file_size > limits.total:
                yield "REJECTED", path, "TOTAL_TOO_LARGE", None, None, depth
                return
            try:
                with held.open(entry) as f:
                    content = f.read(limits.member + 1)
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError):
                yield "REJECTED", path, "UNREADABLE", None, None, depth
                continue
            if len(content) > limits.member:
                yield "REJECTED", path, "MEMBER_TOO_LARGE", None, None, depth
                continue
            used["total"] += len(content)
            used["members"] += 1
            if entry.compress_size and len(content) / entry.compress_size > limits.ratio:
                yield "NOTE", path, "SUSPICIOUS_RATIO", None, None, depth
            if content[:4] in (b"PK\x03\x04", b"PK\x05\x06") and not re.search(OFFICE, entry.filename.lower()):
                if depth + 1 > limits.depth:
                    yield "REJECTED", path, "NESTING_TOO_DEEP", None, None, depth
                else:
                    yield from walk(content, path + "!/", depth + 1)
                continue
            yield "MEMBER", path, None, content, hashlib.sha256(content).hexdigest(), depth

    yield from walk(data, "", 0)


SCHEMA = "source_file_id string, outcome string, path string, code string, content binary, sha256 string, depth int"


def extracted(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Members, rejections and notes of a ``binaryFile`` scan's archives; an archive is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = [(path, *m) for m in members(bytes(content), limits)]
                if found:
                    yield pd.DataFrame(found, columns=["source_file_id", "outcome", "path", "code", "content", "sha256", "depth"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
