"""Raw, deliberately messy call rows made from the events table, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.formats import Format

_TS = {
    "iso": "concat(cast(year(ts) AS string),'-',lpad(cast(month(ts) AS string),2,'0'),'-',lpad(cast(day(ts) AS string),2,'0'),' ',{clock})",
    "us": "concat(lpad(cast(month(ts) AS string),2,'0'),'/',lpad(cast(day(ts) AS string),2,'0'),'/',cast(year(ts) AS string),' ',{clock})",
    "compact": "concat(cast(year(ts) AS string),lpad(cast(month(ts) AS string),2,'0'),lpad(cast(day(ts) AS string),2,'0'),replace({clock},':',''))",
}
_CLOCK = "concat(lpad(cast(hour(ts) AS string),2,'0'),':',lpad(cast(minute(ts) AS string),2,'0'),':',lpad(cast(second(ts) AS string),2,'0'))"
_USER = "cast(user_id AS string)"

#: SQL that both engines run; {events} is the events table.
CARRIER_ROWS = f"""
SELECT event_id AS src_row,
 CASE event_id % 7 WHEN 0 THEN concat('+1 (303) 555-', lpad({_USER},4,'0'))
  WHEN 1 THEN concat('303555', lpad({_USER},4,'0'))
  WHEN 2 THEN concat('1-303-555-', lpad({_USER},4,'0'))
  WHEN 3 THEN concat('011442079', lpad({_USER},6,'0'))
  WHEN 4 THEN 'RESTRICTED' WHEN 5 THEN '611'
  ELSE concat('44207946', lpad({_USER},3,'0')) END AS msisdn_raw,
 CASE event_id % 5 WHEN 0 THEN concat('310410', lpad({_USER},9,'0'))
  WHEN 1 THEN concat('310-260-', lpad({_USER},9,'0'))
  WHEN 2 THEN concat('310999', lpad({_USER},9,'0'))
  WHEN 3 THEN concat('23415', lpad({_USER},10,'0')) ELSE 'N/A' END AS imsi_raw,
 CASE WHEN event_id % 140 = 4 THEN 'UNKNOWN'
  ELSE concat('35209900', lpad({_USER},6,'0'), cast(event_id % 10 AS string)) END AS imei_raw,
 CASE event_id % 4 WHEN 0 THEN {_TS['iso'].format(clock=_CLOCK)}
  WHEN 1 THEN {_TS['us'].format(clock=_CLOCK)}
  WHEN 2 THEN {_TS['compact'].format(clock=_CLOCK)}
  ELSE 'not a time' END AS ts_raw,
 CASE WHEN event_id % 11 = 0 THEN '' ELSE cast(100000 + user_id % 40 AS string) END AS site,
 substr('ABC', cast(event_id % 3 AS int) + 1, 1) AS sector,
 CASE event_type WHEN 'click' THEN 'VOICE' WHEN 'view' THEN 'SMS' WHEN 'purchase' THEN 'data' WHEN 'signup' THEN 'REG' ELSE 'zzz' END AS kind_code,
 CASE event_id % 4 WHEN 0 THEN 'MO' WHEN 1 THEN 'MT' WHEN 2 THEN 'In-coming' ELSE '' END AS dir_code,
 CASE event_id % 3 WHEN 0 THEN 'LTE' WHEN 1 THEN '2G' ELSE '5G' END AS rat,
 cast(event_id % 4200 AS string) AS ta_raw,
 cast(event_id % 90 - 5 AS string) AS dur_raw,
 CASE WHEN event_id % 9 = 0 THEN concat('note ', cast(event_id % 4 AS string)) ELSE '' END AS remark,
 39.0e0 + (user_id % 40) * 0.01e0 AS lat, -105.0e0 + (user_id % 37) * 0.01e0 AS lon
FROM {{events}}
"""

COLUMNS = ["msisdn_raw", "imsi_raw", "imei_raw", "ts_raw", "site", "sector", "kind_code", "dir_code", "rat", "ta_raw", "dur_raw", "remark"]

FORMAT = Format(
    "fixture.rows", "1.0.0", "FIX", "TOWER_DUMP", ",", ("msisdn_raw", "ts_raw"),
    fields={
        "msisdn": ("msisdn_raw",), "imsi": ("imsi_raw",), "imei": ("imei_raw",), "site_id": ("site",), "sector_id": ("sector",), "event_kind": ("kind_code",),
        "direction": ("dir_code",), "technology": ("rat",), "timing_advance": ("ta_raw",), "duration_sec": ("dur_raw",),
    },
    timestamp=("ts_raw",),
)


def carrier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CARRIER_ROWS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, raw, fields) as a reader of delimited text gives them."""
    rows = carrier_rows(spark, sf_dir)
    return rows.select(F.col("src_row").alias("row"), F.concat_ws("|", *COLUMNS).alias("raw"), F.array(*COLUMNS).alias("fields"))
