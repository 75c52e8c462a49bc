"""Live ingest of delimited rows: the same columns as in batch, with watermarked duplicates and counts.

The batch rule marks a duplicate by its row's number. A stream has no such number: here
the first to arrive is kept, within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.integrity import row_hash
from ..functions.times import with_time
from ..plans.formats import Format, position
from ..sources.tabular import fields


def rows(lines: DataFrame, fmt: Format, line: str = "value") -> DataFrame:
    """Streamed lines as rows of one format, the header line left out."""
    out = lines.select(F.col(line).alias("raw"), fields(F.col(line), fmt.delimiter).alias("fields"))
    return out.filter(F.get("fields", 0) != F.lit(fmt.required[0])).withColumn("row_hash", row_hash(F.col("raw")))


def timed(stream: DataFrame, fmt: Format, headers: list[str], zone: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows with ``ts_utc`` and a watermark on it."""
    p = position(fmt.timestamp, headers)
    parsed = with_time(stream.withColumn("_raw", F.get("fields", F.lit(p))), "_raw", package_zone=zone)
    return parsed.withColumn("ts_utc", F.col("time.utc")).drop("_raw", "time").withWatermark("ts_utc", late)


def distinct(stream: DataFrame) -> DataFrame:
    """The first of each row within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["row_hash"])


def counts(stream: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(start, end, rows) of tumbling windows."""
    held = stream.groupBy(F.window("ts_utc", width).alias("w")).agg(F.count("*").alias("rows"))
    return held.select("w.start", "w.end", "rows")
