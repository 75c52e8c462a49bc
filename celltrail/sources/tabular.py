"""Delimited text as evidence: raw rows, their numbers and places are kept.

Spark's own CSV reader drops raw text and row numbers, so records and fields are split
here, with possessive patterns that a quoted field of any length does not slow down.
Records are split in one pass over a text, in Arrow batches: their offsets are running
sums, for which arrays in the plan would be copied once a record. Fields are split in the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records that leave a text together.
BATCH = 8192
DELIMITERS = (",", "\t", "|", ";")
#: A record up to its end; quotes toggle, so line ends inside them are text.
RECORD = r'([^"\r\n]*+(?:"[^"]*+(?:""[^"]*+)*+"?+[^"\r\n]*+)*+)(\r\n|\n|\r|$)'


def line_ending(text: Column) -> Column:
    """CRLF, LF, CR, or MIXED."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("\n")) - crlf, F.regexp_count(text, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds > 1, "MIXED").when(crlf > 0, "CRLF").when(cr > 0, "CR").otherwise("LF")


def fields(line: Column, delimiter: str) -> Column:
    """A record's fields: a quote anywhere toggles, two of them inside are one; an open quote is tolerated."""
    d = {"\t": "\\t", "|": "\\|"}.get(delimiter, delimiter)
    one = rf'{d}([^"{d}]*+(?:"[^"]*+(?:""[^"]*+)*+"?+[^"{d}]*+)*+)'
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(one), F.lit(1))
    return F.transform(raw, lambda x: F.replace(F.regexp_replace(x, r'"([^"]*+(?:""[^"]*+)*+)"?+', "$1"), F.lit('""'), F.lit('"')))


_RECORD = re.compile(RECORD)


def records(files: DataFrame, text_col: str = "text", skip: int = 0, limit: int | None = None) -> DataFrame:
    """``files`` without the text, one row a record: _head (the header's raw text), _row, _raw, _offset.

    A text is walked once, and its records leave in batches. Blank records have no number; the
    first one behind ``skip`` is the header and no row.
    """
    kept = [f for f in files.schema.fields if f.name != text_col]
    more = [T.StructField("_head", T.StringType()), T.StructField("_row", T.IntegerType()), T.StructField("_raw", T.StringType()), T.StructField("_offset", T.LongType())]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(len(kept))[k].as_py() or ""
                text = text[1:] if text.startswith("\ufeff") else text
                own = [c.slice(k, 1) for c in batch.columns[: len(kept)]]
                head, number, seen, rows = None, 1, 0, []

                def out(own=own):
                    many = pa.array([0] * len(rows), pa.int64())
                    columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)]
                    rows.clear()
                    return pa.RecordBatch.from_arrays([*[c.take(many) for c in own], *columns], names=[*names, "_head", "_row", "_raw", "_offset"])

                for m in _RECORD.finditer(text):
                    raw = m[1]
                    if not raw:
                        continue
                    seen += 1
                    if seen <= skip or not raw.strip(" "):
                        continue
                    if head is None:
                        head = raw
                        continue
                    if limit is not None and number > limit:
                        break
                    number += 1
                    rows.append((head, number + skip, raw, m.start()))
                    if len(rows) == BATCH:
                        yield out()
                if rows:
                    yield out()

    return files.select(*names, text_col).mapInArrow(run, T.StructType([*kept, *more]))


def delimiter(text: Column, lines: int = 20) -> Column:
    """The delimiter that splits the first lines most evenly, a comma if none does; of equals the earlier listed."""
    sample = F.slice(F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), 1, lines)

    def score(d: str) -> Column:
        counts = F.transform(sample, lambda x: F.size(fields(x, d)))
        first = F.get(counts, 0)
        even = F.size(F.filter(counts, lambda c: c == first)) / F.greatest(F.size(counts), F.lit(1))
        return F.when(first >= 2, even * 100 + first).otherwise(F.lit(-1.0))

    each = F.array(*[F.struct(score(d).alias("score"), F.lit(-k).alias("order"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)])
    best = F.array_max(each)
    return F.when(best["score"] > 0, best["d"]).otherwise(F.lit(","))


def rows(files: DataFrame, d: str, text_col: str = "text", skip: int = 0, limit: int | None = None) -> DataFrame:
    """(all columns but the text, row, raw, fields, offset, header, ragged) of texts of one delimiter each.

    The first record behind ``skip`` ones is the header; blank records have no number.
    Offsets count characters, and are null if records were skipped.
    """
    kept = [c for c in files.columns if c != text_col]
    each = records(files, text_col, skip, limit)
    header = F.transform(fields(F.col("_head"), d), lambda h: F.btrim(h, F.lit(" \t\r\n")))
    return each.select(
        *kept,
        F.col("_row").alias("row"),
        F.col("_raw").alias("raw"),
        fields(F.col("_raw"), d).alias("fields"),
        (F.col("_offset") if not skip else F.lit(None).cast("long")).alias("offset"),
        header.alias("header"),
    ).withColumn("ragged", F.size("fields") != F.size("header"))


def read(spark: SparkSession, paths: str | list[str], d: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of whole files, each with its path as ``source_file_id``."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file_id"), F.col("value").alias("text"))
    return rows(files, d, skip=skip, limit=limit)


def header_index(header: list[str]) -> dict[str, int]:
    """Places of the columns by trimmed, lower-case name; of equal names the last."""
    return {h.strip().lower(): k for k, h in enumerate(header)}


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Row numbers by file for rows that come without: the window sorts within a file."""
    return df.withColumn("row", F.row_number().over(Window.partitionBy("source_file_id").orderBy(*order)) + 1)
