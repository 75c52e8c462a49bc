"""The engine's queries on the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import CARRIER_ROWS, COLUMNS, FORMAT, carrier_rows, source_rows
from .functions import geodesy, identifiers as ids, integrity, times
from .operators import correlate, evidence, normalize
from .plans import detect, formats, profile
from .sources import archive, export, tabular, workbook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ROWS = "c AS (" + CARRIER_ROWS.replace("{events}", "events") + ")"
# Fixed values, as the survey lists them: texts that mean "no value", operators by network code.
_TOKENS = "('', '0', 'N/A', 'NA', 'NULL', 'NONE', 'UNKNOWN', 'UNAVAILABLE', 'NOT AVAILABLE', 'NOT PROVIDED', '-', '--', 'RESTRICTED', 'PRIVATE', 'WITHHELD', 'ANONYMOUS', 'BLOCKED')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _flags(*each: tuple[str, str]) -> str:
    """SQL for the flags that hold, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in each) + ")"


# --- identifiers ----------------------------------------------------------------------------------

_MSISDN = f"""m AS (SELECT src_row, msisdn_raw AS r, upper(trim(msisdn_raw)) IN {_TOKENS} AS none, regexp_replace(msisdn_raw, '[^0-9]', '', 'g') AS d, msisdn_raw LIKE '+%' AS plus FROM c),
n AS (SELECT src_row, d,
 CASE WHEN none THEN NULL WHEN NOT plus AND length(d) BETWEEN 3 AND 6 THEN d WHEN plus THEN '+' || d
  WHEN d LIKE '011%' AND length(d) > 12 THEN '+' || substr(d, 4) WHEN length(d) = 10 THEN '+1' || d
  WHEN length(d) = 11 AND d LIKE '1%' THEN '+' || d WHEN length(d) BETWEEN 8 AND 15 THEN d END AS normalized,
 CASE WHEN none THEN false WHEN NOT plus AND length(d) BETWEEN 3 AND 6 THEN true WHEN plus THEN length(d) BETWEEN 8 AND 15
  WHEN d LIKE '011%' AND length(d) > 12 THEN false WHEN length(d) = 10 OR (length(d) = 11 AND d LIKE '1%') THEN true ELSE false END AS valid,
 CASE WHEN none THEN NULL WHEN NOT plus AND length(d) BETWEEN 3 AND 6 THEN 'SHORT_CODE' WHEN plus OR (d LIKE '011%' AND length(d) > 12) THEN 'INTERNATIONAL'
  WHEN length(d) = 10 OR (length(d) = 11 AND d LIKE '1%') THEN 'NANP' END AS kind,
 coalesce(NOT none AND NOT plus AND length(d) = 10, false) AS assumed FROM m)"""


@query(f"WITH {_ROWS}, {_MSISDN} SELECT src_row, normalized, valid, kind, assumed FROM n")
def msisdn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ids.msisdn(F.col("msisdn_raw"))
    rows = carrier_rows(spark, sf_dir).select("src_row", m.alias("m"))
    assumed = F.exists("m.issues", lambda i: i.contains("assumed"))
    return rows.select("src_row", "m.normalized", "m.valid", F.try_element_at("m.derived", F.lit("kind")).alias("kind"), assumed.alias("assumed"))


_OPERATOR = """CASE WHEN left(d, 6) IN ('310030', '310070', '310150', '310170', '310280', '310380', '310410', '310560', '311180') THEN 'AT&T'
 WHEN left(d, 6) IN ('310004', '310005', '310012', '310590', '310890', '311480') THEN 'Verizon'
 WHEN left(d, 6) IN ('310160', '310200', '310210', '310220', '310230', '310240', '310250', '310260', '310270', '310310', '310490', '310660', '310800', '311882') THEN 'T-Mobile'
 WHEN left(d, 6) IN ('310120', '312530') THEN 'Sprint (T-Mobile)' WHEN left(d, 6) = '311870' THEN 'Boost' WHEN left(d, 6) IN ('310320', '310730', '311220') THEN 'UScellular' END"""
_IMSI = f"""i AS (SELECT src_row, upper(trim(imsi_raw)) IN {_TOKENS} AS none, regexp_replace(imsi_raw, '[^0-9]', '', 'g') AS d, regexp_replace(imsi_raw, '[^0-9]', '', 'g')[1:3] BETWEEN '310' AND '316' AS american FROM c),
s AS (SELECT src_row, CASE WHEN NOT none AND length(d) >= 6 THEN d END AS normalized,
 NOT none AND length(d) = 15 AND NOT (american AND {_OPERATOR} IS NULL) AS valid,
 CASE WHEN NOT none AND length(d) >= 6 THEN left(d, 3) END AS mcc,
 CASE WHEN NOT none AND length(d) >= 6 THEN substr(d, 4, CASE WHEN american THEN 3 ELSE 2 END) END AS mnc,
 CASE WHEN NOT none AND length(d) >= 6 THEN substr(d, CASE WHEN american THEN 7 ELSE 6 END) END AS msin,
 CASE WHEN NOT none AND length(d) >= 6 AND american THEN {_OPERATOR} END AS operator FROM i)"""


@query(f"WITH {_ROWS}, {_IMSI} SELECT * FROM s")
def imsi_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carrier_rows(spark, sf_dir).select("src_row", ids.imsi(F.col("imsi_raw")).alias("i"))
    parts = [F.try_element_at("i.derived", F.lit(k)).alias(k) for k in ("mcc", "mnc", "msin", "operator")]
    return rows.select("src_row", "i.normalized", "i.valid", *parts)


_DUE = "(10 - (" + " + ".join(
    f"CAST(substr(d, {k}, 1) AS INT)" if k % 2 else f"(CAST(substr(d, {k}, 1) AS INT) * 2) // 10 + (CAST(substr(d, {k}, 1) AS INT) * 2) % 10" for k in range(1, 15)
) + ") % 10) % 10"
_IMEI = f"""e AS (SELECT src_row, upper(trim(imei_raw)) IN {_TOKENS} AS none, CASE WHEN upper(trim(imei_raw)) IN {_TOKENS} THEN '000000000000000' ELSE regexp_replace(imei_raw, '[^0-9]', '', 'g') END AS d FROM c),
h AS (SELECT src_row, CASE WHEN NOT none THEN left(d, 14) END AS body, CASE WHEN NOT none THEN left(d, 8) END AS tac,
 CASE WHEN NOT none THEN substr(d, 9, 6) END AS serial, NOT none AND substr(d, 15, 1) = CAST({_DUE} AS VARCHAR) AS valid,
 NOT none AND substr(d, 15, 1) <> CAST({_DUE} AS VARCHAR) AS checksum_failed FROM e)"""


@query(f"WITH {_ROWS}, {_IMEI} SELECT * FROM h")
def imei_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carrier_rows(spark, sf_dir).select("src_row", ids.imei(F.col("imei_raw")).alias("i"))
    failed = F.exists("i.issues", lambda x: x.startswith("check digit"))
    return rows.select(
        "src_row", F.col("i.normalized").alias("body"), *[F.try_element_at("i.derived", F.lit(k)).alias(k) for k in ("tac", "serial")],
        "i.valid", failed.alias("checksum_failed"),
    )


@query("""WITH t AS (SELECT c_custkey, '8901' || lpad(CAST(c_custkey AS VARCHAR), 14 + CAST(c_custkey % 5 AS INT), '0') AS d FROM customer)
SELECT c_custkey, d AS normalized, length(d) BETWEEN 18 AND 22 AS valid, left(d, 2) AS mii, substr(d, 3, 3) AS country FROM t""")
def iccid_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("8901"), F.lpad(F.col("c_custkey").cast("string"), 14 + (F.col("c_custkey") % 5).cast("int"), F.lit("0")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", ids.iccid(raw).alias("i"))
    return rows.select("c_custkey", "i.normalized", "i.valid", F.try_element_at("i.derived", F.lit("mii")).alias("mii"), F.try_element_at("i.derived", F.lit("countryCode")).alias("country"))


@query("""WITH t AS (SELECT s_suppkey, upper(regexp_replace('a0-' || md5(s_name), '[^0-9a-fA-F]', '', 'g'))[1:CAST(10 + s_suppkey % 6 AS INT)] AS h FROM supplier)
SELECT s_suppkey, left(h, 14) AS meid, length(h) IN (14, 15) AS meid_valid, left(h, 8) AS esn, length(h) IN (8, 9) AS esn_valid FROM t""")
def esn_meid_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("a0-"), F.substring(F.md5("s_name"), F.lit(1), (8 + F.col("s_suppkey") % 6).cast("int")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", ids.esn_meid(raw, "MEID").alias("m"), ids.esn_meid(raw, "ESN").alias("e"))
    return rows.select("s_suppkey", F.col("m.normalized").alias("meid"), F.col("m.valid").alias("meid_valid"), F.col("e.normalized").alias("esn"), F.col("e.valid").alias("esn_valid"))


@query("SELECT c_custkey, upper(c_mktsegment) AS normalized, true AS valid FROM customer")
def opaque_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", ids.opaque(F.col("c_mktsegment"), "CARRIER_SUBSCRIBER_ID").alias("i"))
    return rows.select("c_custkey", "i.normalized", "i.valid")


_VALUES = "v AS (SELECT src_row, 'msisdn' AS col, msisdn_raw AS r FROM c UNION ALL SELECT src_row, 'imsi', imsi_raw FROM c UNION ALL SELECT src_row, 'imei', imei_raw FROM c UNION ALL SELECT src_row, 'site', site FROM c UNION ALL SELECT src_row, 'ts', ts_raw FROM c)"
_LUHN15 = "substr(d, 15, 1) = CAST(" + _DUE.replace("substr(d,", "substr(rpad(d, 15, '0'),") + " AS VARCHAR)"


_TYPE = f"""CASE WHEN upper(trim(r)) IN {_TOKENS} THEN NULL WHEN n = 15 AND known THEN 'IMSI' WHEN n = 15 AND luhn THEN 'IMEI'
 WHEN n = 15 AND left(d, 3) BETWEEN '200' AND '750' THEN 'IMSI' WHEN n = 16 THEN 'IMEI' WHEN n BETWEEN 18 AND 22 AND d LIKE '89%' THEN 'ICCID'
 WHEN r LIKE '+%' OR n = 10 OR (n = 11 AND d LIKE '1%') THEN 'MSISDN' WHEN regexp_matches(r, '^[0-9a-fA-F:]{{6,39}}$') THEN 'IP_ADDRESS' END"""


@query(f"""WITH {_ROWS}, {_VALUES}, w AS (SELECT *, regexp_replace(r, '[^0-9]', '', 'g') AS d FROM v),
x AS (SELECT *, length(d) AS n, {_OPERATOR} IS NOT NULL AS known, {_LUHN15} AS luhn FROM w)
SELECT src_row, col, {_TYPE} AS type,
 CASE WHEN upper(trim(r)) IN {_TOKENS} THEN NULL WHEN n = 15 AND known AND NOT luhn THEN 0.9e0 WHEN n = 15 AND known THEN 0.6e0 WHEN n = 15 AND luhn THEN 0.85e0
 WHEN n = 15 AND left(d, 3) BETWEEN '200' AND '750' THEN 0.5e0 WHEN n = 16 THEN 0.5e0 WHEN n BETWEEN 18 AND 22 AND d LIKE '89%' THEN 0.8e0
 WHEN r LIKE '+%' OR n = 10 OR (n = 11 AND d LIKE '1%') THEN 0.75e0 WHEN regexp_matches(r, '^[0-9a-fA-F:]{{6,39}}$') THEN 0.6e0 END AS confidence,
 CASE WHEN upper(trim(r)) IN {_TOKENS} THEN NULL WHEN n = 15 AND known AND NOT luhn THEN '15 digits that begin with a network of ' || {_OPERATOR} || ' (' || left(d, 6) || ')'
 WHEN n = 15 AND known THEN '15 digits that begin with a network of ' || {_OPERATOR} || ' (' || left(d, 6) || '), but they pass a handset''s check as well; see the column''s header'
 WHEN n = 15 AND luhn THEN '15 digits that pass a handset''s check (type ' || left(d, 8) || ') and begin with no known network'
 WHEN n = 15 AND left(d, 3) BETWEEN '200' AND '750' THEN '15 digits that begin like a country (' || left(d, 3) || ') with no known network, and fail a handset''s check'
 WHEN n = 16 THEN '16 digits, as a handset number with its software version has' WHEN n BETWEEN 18 AND 22 AND d LIKE '89%' THEN '18 to 22 digits that begin with 89'
 WHEN r LIKE '+%' OR n = 10 OR (n = 11 AND d LIKE '1%') THEN 'written like a telephone number' WHEN regexp_matches(r, '^[0-9a-fA-F:]{{6,39}}$') THEN 'written like a network address' END AS rationale FROM x""")
def identifier_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"msisdn": "msisdn_raw", "imsi": "imsi_raw", "imei": "imei_raw", "site": "site", "ts": "ts_raw"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.col(c).alias("r")) for k, c in cols.items()])).alias("v")
    rows = carrier_rows(spark, sf_dir).select("src_row", each)
    return rows.select("src_row", "v.col", ids.inferred(F.col("v.r")).alias("i")).select("src_row", "col", "i.type", "i.confidence", "i.rationale")


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_rows(spark, sf_dir).select(
        "src_row", *[ids.normalized(F.col(f"{k}_raw"), k.upper())["normalized"].alias(k) for k in ("msisdn", "imsi", "imei")]
    )


@query(f"""WITH {_ROWS}, {_MSISDN}, {_IMSI}, {_IMEI}, k AS (SELECT 'IMEI:' || body AS key FROM h WHERE body IS NOT NULL UNION ALL SELECT 'IMSI:' || normalized FROM s WHERE normalized IS NOT NULL
UNION ALL SELECT 'MSISDN:' || normalized FROM n WHERE normalized IS NOT NULL) SELECT key AS identifier_key, count(*) AS n FROM k GROUP BY 1""")
def identifier_keys_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.keyed(_identified(spark, sf_dir)).groupBy("identifier_key").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, repeat('•', greatest(0, CAST(length(c_name) AS BIGINT) - 4)) || right(c_name, 4) AS masked FROM customer")
def identifier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ids.masked(F.col("c_name")).alias("masked"))


@query(f"""WITH {_ROWS}, {_MSISDN}, {_IMSI}, {_IMEI}, k AS (SELECT 5 AS strength FROM h WHERE body IS NOT NULL UNION ALL SELECT 4 FROM s WHERE normalized IS NOT NULL
UNION ALL SELECT 3 FROM n WHERE normalized IS NOT NULL) SELECT strength, count(*) AS n FROM k GROUP BY 1""")
def identifier_strength_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = correlate.keyed(_identified(spark, sf_dir)).select(ids.parsed_key(F.col("identifier_key"))["type"].alias("t"))
    return keys.groupBy(ids.strength(F.col("t")).alias("strength")).agg(F.count("*").alias("n"))


# --- time -----------------------------------------------------------------------------------------

_TIME = """t AS (SELECT src_row, coalesce(try_strptime(ts_raw, '%Y-%m-%d %H:%M:%S'), try_strptime(ts_raw, '%m/%d/%Y %H:%M:%S'), try_strptime(ts_raw, '%Y%m%d%H%M%S')) AS utc,
 CASE WHEN try_strptime(ts_raw, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 'yyyy-MM-dd HH:mm:ss' WHEN try_strptime(ts_raw, '%m/%d/%Y %H:%M:%S') IS NOT NULL THEN 'MM/dd/yyyy HH:mm:ss'
 WHEN try_strptime(ts_raw, '%Y%m%d%H%M%S') IS NOT NULL THEN 'yyyyMMddHHmmss' END AS matched_format FROM c)"""


@query(f"""WITH {_ROWS}, {_TIME} SELECT src_row, utc - CASE WHEN utc IS NOT NULL THEN INTERVAL 3 HOUR END AS utc, matched_format,
 CASE WHEN utc IS NULL THEN 'UNRESOLVED' ELSE 'PACKAGE_DECLARED_ZONE' END AS method, CASE WHEN utc IS NULL THEN 'UNRESOLVED' ELSE 'ZONE_DECLARED' END AS confidence FROM t""")
def timestamp_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    rows = times.with_time(carrier_rows(spark, sf_dir).select("src_row", "ts_raw"), "ts_raw", package_zone="UTC+3")
    return rows.select("src_row", "time.utc", "time.matched_format", "time.method", "time.confidence")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS utc,
 CASE WHEN event_id % 2 = 0 THEN 'epoch seconds' ELSE 'epoch milliseconds' END AS matched_format FROM events""")
def timestamp_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    text = F.when(F.col("event_id") % 2 == 0, F.unix_seconds(F.col("ts").cast("timestamp"))).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).cast("string")
    rows = times.with_time(table(spark, sf_dir, "events").select("event_id", text.alias("t")), "t")
    return rows.select("event_id", "time.utc", "time.matched_format")


_ZONE_TEXTS = ["est", "CDT", "UTC+5:30", "gmt-7", "+0530", "America/Denver", "Europe/Nowhere", "", "UTC", "-3"]


@query("WITH z AS (SELECT n_nationkey, CAST(n_nationkey % 10 AS INT) AS k FROM nation) SELECT n_nationkey, CASE k WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'UTC+5:30' WHEN 3 THEN 'UTC-7' WHEN 4 THEN 'UTC+5:30' WHEN 5 THEN 'America/Denver' WHEN 8 THEN 'UTC' WHEN 9 THEN 'UTC-3' END AS zone FROM z")
def zone_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in _ZONE_TEXTS])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.get(texts, (F.col("n_nationkey") % 10).cast("int")).alias("t"))
    return rows.select("n_nationkey", times.zone_column(F.col("t")).alias("zone"))


_LOCAL = "concat(cast(year(o_orderdate) AS string),'-',lpad(cast(month(o_orderdate) AS string),2,'0'),'-',lpad(cast(day(o_orderdate) AS string),2,'0'),' ',lpad(cast(o_orderkey % 24 AS string),2,'0'),':30:00')"


@query("""WITH l AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + INTERVAL 30 MINUTE AS l, CAST(year(o_orderdate) AS INT) AS y FROM orders),
b AS (SELECT *, make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INT) + INTERVAL 2 HOUR AS spring,
 make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INT) + INTERVAL 2 HOUR AS autumn FROM l)
SELECT o_orderkey, CASE WHEN l >= spring + INTERVAL 1 HOUR AND l < autumn THEN l + INTERVAL 4 HOUR ELSE l + INTERVAL 5 HOUR END AS utc,
 CASE WHEN l >= spring AND l < spring + INTERVAL 1 HOUR THEN 'DST_NONEXISTENT' WHEN l >= autumn - INTERVAL 1 HOUR AND l < autumn THEN 'DST_AMBIGUOUS' ELSE 'ZONE_DECLARED' END AS confidence FROM b""")
def dst_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_LOCAL).alias("t"))
    return times.with_time(rows, "t", package_zone="America/New_York").select("o_orderkey", "time.utc", "time.confidence")


_INCIDENTS = "i AS (SELECT o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((o_orderkey * 37) % 44640 AS BIGINT)) AS at FROM orders)"


@query(f"WITH {_INCIDENTS} SELECT i.o_orderkey, count(*) AS n, min(event_id) AS first_event FROM i JOIN events e ON e.ts BETWEEN i.at - INTERVAL 15 MINUTE AND i.at + INTERVAL 5 MINUTE GROUP BY 1")
def window_around_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    minutes = (F.col("o_orderkey") * 37) % 44640
    at = F.timestamp_seconds(F.lit(1704067200) + minutes * 60)
    windows = table(spark, sf_dir, "orders").select("o_orderkey", times.window_around(at, 15, 5).alias("w")).select("o_orderkey", "w.start", "w.end")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts_utc"))
    return correlate.in_windows(events, windows).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' AS inside, 648000e0 AS seconds FROM events")
def window_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    w = times.window(F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-12 12:00:00").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), w.alias("w"))
    return rows.select("event_id", times.window_holds(F.col("w"), F.col("ts")).alias("inside"), times.window_seconds(F.col("w")).alias("seconds"))


@query("SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' America/Denver' AS shown FROM events")
def display_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return table(spark, sf_dir, "events").select("event_id", times.display(F.col("ts").cast("timestamp"), "America/Denver").alias("shown"))


# --- normalization --------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return normalize.events(source_rows(spark, sf_dir), FORMAT, COLUMNS, imported_at="2024-01-25 00:00:00", zone="UTC")


_KIND = "CASE kind_code WHEN 'VOICE' THEN 'VOICE' WHEN 'SMS' THEN 'SMS' WHEN 'data' THEN 'DATA' WHEN 'REG' THEN 'REGISTRATION' ELSE 'UNKNOWN' END"
_DIRECTION = "CASE dir_code WHEN 'MO' THEN 'ORIGINATING' WHEN 'MT' THEN 'TERMINATING' WHEN 'In-coming' THEN 'TERMINATING' ELSE 'UNKNOWN' END"
_RAT = "CASE rat WHEN 'LTE' THEN 'LTE' WHEN '2G' THEN 'GSM' ELSE 'NR' END"
_TA = "CASE WHEN ta_raw <> '0' THEN CAST(ta_raw AS DOUBLE) END"
_DUR = "CASE WHEN dur_raw <> '0' THEN CAST(dur_raw AS DOUBLE) END"
_RAW = "concat_ws('|', " + ", ".join(COLUMNS) + ")"
_JOINED = f"""{_ROWS}, {_MSISDN}, {_IMSI}, {_IMEI}, {_TIME},
j AS (SELECT c.*, {_RAW} AS raw, n.normalized AS msisdn, n.valid AS msisdn_valid, n.assumed, s.normalized AS imsi, s.valid AS imsi_valid, h.body AS imei, h.valid AS imei_valid, h.checksum_failed, t.utc,
 coalesce(n.normalized, s.normalized, h.body) IS NULL AS rejected,
 {_KIND} AS event_kind, {_DIRECTION} AS direction, {_RAT} AS technology, {_TA} AS timing_advance, {_DUR} AS duration_sec,
 row_number() OVER (PARTITION BY {_RAW} ORDER BY c.src_row) > 1 AS duplicate
 FROM c JOIN n USING (src_row) JOIN s USING (src_row) JOIN h USING (src_row) JOIN t USING (src_row))"""
_EARLY = (
    ("DUPLICATE_ROW", "duplicate"), ("UNPARSEABLE_TIMESTAMP", "utc IS NULL"), ("TIMESTAMP_IN_FUTURE", "utc > TIMESTAMP '2024-01-25 00:00:00'"),
    ("MALFORMED_MSISDN", "NOT msisdn_valid AND msisdn IS NULL"), ("ASSUMED_COUNTRY_CODE", "assumed"), ("MALFORMED_IMSI", "NOT imsi_valid"),
    ("IMEI_CHECKSUM_FAILED", "checksum_failed"), ("MALFORMED_IMEI", "NOT imei_valid AND NOT checksum_failed"),
)
_LATE = (
    ("MISSING_CELL_REFERENCE", "site = ''"), ("NEGATIVE_DURATION", "duration_sec < 0"),
    ("TIMING_ADVANCE_OUT_OF_RANGE", "timing_advance > CASE technology WHEN 'GSM' THEN 63 WHEN 'LTE' THEN 1282 ELSE 3846 END"), ("UNMAPPED_COLUMNS", "remark <> ''"),
)
_QUALITY = f"CASE WHEN rejected THEN {_flags(*_EARLY, ('MISSING_IDENTIFIERS', 'true'))} ELSE {_flags(*_EARLY, *_LATE)} END"


@query(f"WITH {_JOINED} SELECT src_row AS row, {_QUALITY} AS flags, rejected FROM j")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("row", F.array_join("quality_flags", ",").alias("flags"), "rejected")


@query(f"""WITH {_JOINED} SELECT src_row AS row, utc AS ts_utc, msisdn, imsi, imei, nullif(site, '') AS site_id, 'FIX:' || nullif(site, '') || ':' || sector AS sector_key, event_kind, direction, technology,
 duration_sec, timing_advance FROM j WHERE NOT rejected""")
def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.accepted(_found(spark, sf_dir)).select(
        "row", "ts_utc", "msisdn", "imsi", "imei", "site_id", "sector_key", "event_kind", "direction", "technology", "duration_sec", "timing_advance"
    )


@query(f"""WITH {_JOINED} SELECT 'FIX:' || site || ':' || sector AS sector_key, count(*) AS events, count(DISTINCT imei) AS devices,
 count(*) FILTER (length({_QUALITY}) > 0) AS flagged FROM j WHERE NOT rejected AND site <> '' GROUP BY 1""")
def sector_device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.accepted(_found(spark, sf_dir)).filter("sector_key IS NOT NULL")
    return events.groupBy("sector_key").agg(F.count("*").alias("events"), F.count_distinct("imei").alias("devices"), F.count_if(F.size("quality_flags") > 0).alias("flagged"))


@query(f"WITH {_JOINED} SELECT src_row AS row, raw FROM j WHERE rejected")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.rejections(_found(spark, sf_dir)).select("row", "raw")


_WARNED = " UNION ALL ".join(
    f"SELECT src_row, '{f}' AS code FROM j WHERE ({c})" + (" AND NOT rejected" if (f, c) in _LATE else "") for f, c in (*_EARLY, *_LATE, ("MISSING_IDENTIFIERS", "rejected")) if f not in normalize.SILENT
)


# What each warning says, by hand.
_SAID = """CASE code WHEN 'DUPLICATE_ROW' THEN 'rows repeat an earlier row of the file; they are kept and marked'
 WHEN 'UNPARSEABLE_TIMESTAMP' THEN 'times of no known format are kept as they stand and take no part in anything that needs one, for example '
 WHEN 'TIMESTAMP_IN_FUTURE' THEN 'times are later than the import' WHEN 'MALFORMED_IMSI' THEN 'subscriber identities are not valid, for example '
 WHEN 'IMEI_CHECKSUM_FAILED' THEN 'handset identities are not valid, for example ' WHEN 'MALFORMED_IMEI' THEN 'handset identities are not valid, for example '
 WHEN 'MISSING_IDENTIFIERS' THEN 'rows that name no device were not made events' WHEN 'MISSING_CELL_REFERENCE' THEN 'rows without a cell or site have no place on a map'
 WHEN 'NEGATIVE_DURATION' THEN 'durations are negative'
 WHEN 'TIMING_ADVANCE_OUT_OF_RANGE' THEN 'timing advances are impossible for their technology; they are kept and not used for distances, for example ' END"""
_DUE_RAW = _DUE.replace("substr(d,", "substr(rpad(imei_raw, 15, '0'),")
_EXAMPLE = f"""CASE code WHEN 'UNPARSEABLE_TIMESTAMP' THEN ts_raw WHEN 'MALFORMED_IMSI' THEN CASE WHEN imsi_raw = 'N/A' THEN 'placeholder, no value' ELSE 'unknown North American network ' || left(imsi_raw, 6) END
 WHEN 'MALFORMED_IMEI' THEN 'placeholder, no value' WHEN 'IMEI_CHECKSUM_FAILED' THEN 'check digit ' || substr(imei_raw, 15, 1) || ' where ' || CASE WHEN imei_raw <> 'UNKNOWN' THEN {_DUE_RAW.replace("CAST(substr", "TRY_CAST(substr")} END || ' is due'
 WHEN 'TIMING_ADVANCE_OUT_OF_RANGE' THEN technology ELSE '' END"""
# Fixed values, as the survey lists them: severities.
_SEVERE = """CASE WHEN code IN ('UNPARSEABLE_TIMESTAMP', 'MISSING_IDENTIFIERS', 'MISSING_CELL_REFERENCE') THEN 'ERROR' WHEN code = 'DUPLICATE_ROW' THEN 'INFO' ELSE 'WARNING' END"""


@query(f"""WITH {_JOINED}, w AS ({_WARNED}), x AS (SELECT code, src_row, {_EXAMPLE} AS example FROM w JOIN j USING (src_row))
SELECT code, {_SEVERE} AS severity, {_SAID} || arg_min(example, src_row) AS message, count(*) AS count, array_to_string(list_sort(list(src_row))[1:10], ',') AS rows FROM x GROUP BY code
UNION ALL SELECT 'UNMAPPED_COLUMNS', 'INFO', 'columns that the format does not know are kept with their rows: remark', 1, '1'""")
def warnings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.warnings(_found(spark, sf_dir), normalize.unmapped_columns(FORMAT, COLUMNS))
    return found.withColumn("rows", F.array_join(F.transform("rows", lambda r: r.cast("string")), ","))


@query(f"WITH {_JOINED} SELECT count(*) AS rows_read, count(*) FILTER (rejected) AS rows_rejected, count(*) FILTER (NOT rejected) AS events, count(*) FILTER (NOT rejected AND length({_QUALITY}) > 0) AS flagged, 'remark' AS unmapped_columns FROM j")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.summary(_found(spark, sf_dir), normalize.unmapped_columns(FORMAT, COLUMNS))
    return found.withColumn("unmapped_columns", F.array_join("unmapped_columns", ","))


@query(f"WITH {_JOINED} SELECT src_row AS row, 'remark=' || remark AS extra FROM j WHERE NOT rejected AND remark <> ''")
def unmapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.accepted(_found(spark, sf_dir)).filter("unmapped_fields IS NOT NULL")
    return events.select("row", F.array_join(F.transform(F.map_entries("unmapped_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("extra"))


@query(f"WITH {_ROWS} SELECT src_row, {_TA} AS ta, CAST(ta_raw AS DOUBLE) AS ta_zero, {_DUR} AS dur FROM c")
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_rows(spark, sf_dir).select(
        "src_row", normalize.numeric(F.concat(F.lit(" "), F.col("ta_raw"))).alias("ta"), normalize.numeric(F.col("ta_raw"), keep_zero=True).alias("ta_zero"), normalize.numeric(F.col("dur_raw")).alias("dur")
    )


@query(f"WITH {_ROWS} SELECT src_row, {_KIND} AS kind, {_DIRECTION} AS direction, {_RAT} AS technology FROM c")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_rows(spark, sf_dir).select(
        "src_row", normalize.code(F.col("kind_code"), formats.EVENT_KINDS).alias("kind"), normalize.code(F.col("dir_code"), formats.DIRECTIONS).alias("direction"), normalize.code(F.col("rat"), formats.TECHNOLOGIES).alias("technology")
    )


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", integrity.row_hash(F.col("text")).alias("h"))
    return normalize.marked_duplicates(docs, ["h"], "doc_id", "duplicate").select("doc_id", "duplicate")


_SITES = """l AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 19 = 0 THEN 91.0e0 WHEN s_suppkey % 23 = 0 THEN 0.0e0 ELSE 30 + CAST(s_nationkey AS DOUBLE) END AS lat,
 CASE WHEN s_suppkey % 23 = 0 THEN 0.0e0 ELSE -100 - CAST(s_nationkey % 5 AS DOUBLE) END AS lon, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE cast(s_suppkey % 60 AS string) END AS site_id,
 substr('ABC', cast(s_suppkey % 3 AS int) + 1, 1) AS sector_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE cast(s_suppkey % 360 AS double) END AS azimuth,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 65.0e0 END AS beam_width FROM {supplier})"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("WITH " + _SITES + " SELECT * FROM l", supplier=table(spark, sf_dir, "supplier"))
    return normalize.placed_sectors(rows.withColumn("raw", F.concat_ws("|", F.col("row").cast("string"), "site_id", "sector_id")), "FIX")


_PLACED = _SITES.format(supplier="supplier") + """, o AS (SELECT *, lat IS NULL OR lon IS NULL AS missing, coalesce(lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180, false) AS outside FROM l),
d AS (SELECT *, NOT missing AND NOT outside AND site_id IS NULL AS nameless, NOT missing AND NOT outside AND lat = 0 AND lon = 0 AS origin, missing OR outside OR site_id IS NULL AS dropped, 'FIX:' || site_id AS site_key FROM o),
f AS (SELECT lat, lon, arg_min(site_key, row) AS first_site FROM d WHERE NOT dropped GROUP BY 1, 2),
q AS (SELECT d.*, f.first_site FROM d LEFT JOIN f ON d.lat = f.lat AND d.lon = f.lon AND NOT d.dropped)"""
_SITE_FLAGS = (
    ("MISSING_COORDINATES", "missing"), ("COORDINATE_OUT_OF_RANGE", "outside"), ("NULL_ISLAND_COORDINATE", "origin"), ("MISSING_SITE_OR_SECTOR", "nameless"),
    ("DUPLICATE_SITE_COORDINATES", "NOT dropped AND first_site <> site_key"), ("MISSING_AZIMUTH", "NOT dropped AND azimuth IS NULL"), ("MISSING_BEAMWIDTH", "NOT dropped AND beam_width IS NULL"),
)


@query(f"WITH {_PLACED} SELECT row, dropped, site_key || ':' || sector_id AS sector_key, {_flags(*_SITE_FLAGS)} AS warnings FROM q")
def sectors_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select("row", "dropped", "sector_key", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {_PLACED} SELECT row, site_key, first_site FROM q WHERE NOT dropped AND first_site <> site_key")
def coincident_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).filter("NOT dropped AND first_site <> site_key").select("row", "site_key", "first_site")


@query(f"""WITH {_JOINED}, k AS (SELECT DISTINCT 'FIX:' || (100000 + s_suppkey % 25) || ':' || substr('ABC', CAST(s_suppkey % 3 AS INT) + 1, 1) AS sector_key FROM supplier)
SELECT 'FIX:' || site || ':' || sector AS sector_key, count(*) AS events FROM j WHERE NOT rejected AND site <> '' AND 'FIX:' || site || ':' || sector NOT IN (SELECT sector_key FROM k) GROUP BY 1""")
def unknown_sector_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("FIX:"), (F.lit(100000) + F.col("s_suppkey") % 25).cast("string"), F.lit(":"), F.substring(F.lit("ABC"), (F.col("s_suppkey") % 3).cast("int") + 1, F.lit(1)))
    known = table(spark, sf_dir, "supplier").select(key.alias("sector_key"))
    return normalize.unknown_sectors(normalize.accepted(_found(spark, sf_dir)), known).groupBy("sector_key").agg(F.count("*").alias("events"))


# --- integrity ------------------------------------------------------------------------------------

_SEP, _NONE = "chr(31)", "chr(0)"


@query(f"WITH {_ROWS}, r AS (SELECT src_row, sha256({_RAW}) AS row_hash FROM c) SELECT src_row AS row, row_hash, sha256('file' || {_SEP} || src_row || {_SEP} || row_hash) AS event_id FROM r")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_rows(spark, sf_dir).select("row", integrity.row_hash(F.col("raw")).alias("row_hash"))
    return rows.withColumn("event_id", integrity.record_id(F.lit("file"), F.col("row"), F.col("row_hash")))


@query("SELECT doc_id, sha256(text) AS row_hash FROM documents")
def row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", integrity.row_hash(F.col("text")).alias("row_hash"))


@query(f"""WITH l AS (SELECT source, doc_id || {_SEP} || sha256(text) AS line FROM documents), p AS (SELECT source, left(sha256(line), 4) AS part, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY 1, 2)
SELECT source, sha256(string_agg(part || '=' || h, chr(10) ORDER BY part)) AS manifest FROM p GROUP BY source""")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.manifests(table(spark, sf_dir, "documents"), "source", F.col("doc_id"), F.sha2("text", 256))


@query("SELECT l_orderkey, sha256(string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))) AS digest FROM lineitem GROUP BY l_orderkey")
def output_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(integrity.output_digest(F.col("l_linenumber"), F.col("l_partkey")).alias("digest"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.select(
        F.col("o_custkey").alias("chain"), seq.alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.concat(F.lit("clerk "), (F.col("o_orderkey") % 7).cast("string")).alias("actor_id"),
        F.col("o_orderpriority").alias("action"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("payload_hash"),
    )
    chained = integrity.chained(rows, "chain", key="secret")
    # what an attacker would do to every seventieth customer's chain
    return chained.withColumn("actor_id", F.when((F.col("chain") % 70 == 0) & (F.col("seq") == 2), F.lit("someone else")).otherwise(F.col("actor_id")))


@query("""SELECT o_custkey AS chain, NOT (o_custkey % 70 = 0 AND count(*) >= 2) AS valid, count(*) AS checked, CASE WHEN o_custkey % 70 = 0 AND count(*) >= 2 THEN 2 END AS broken_at_seq
FROM orders GROUP BY o_custkey""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verified_chain(_chains(spark, sf_dir), "chain", key="secret").drop("message")


@query("""SELECT event_id, '{"a":"' || event_type || '","m":"' || user_id || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"z":"' || (event_id % 5) || '"' END || '}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(
        F.lit("z"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 5).cast("string")), F.lit("a"), F.col("event_type"), F.lit("m"), F.col("user_id").cast("string")
    )
    return table(spark, sf_dir, "events").select("event_id", integrity.canonical_map_json(m).alias("json"))


# --- tabular text, archives, detection --------------------------------------------------------------


@query("SELECT conv_id, turn, 4 AS n, role AS first, 'say \"' || replace(text, '\"', '') || '\", he' AS second, CAST(turn AS VARCHAR) AS last FROM conversations")
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit('"'), F.lit(""))
    line = F.concat(F.col("role"), F.lit(',"say ""'), text, F.lit('"", he",,'), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tabular.fields(line, ",").alias("f"))
    return rows.select("conv_id", "turn", F.size("f").alias("n"), F.get("f", 0).alias("first"), F.get("f", 1).alias("second"), F.get("f", 3).alias("last"))


_SAMPLE_TEXT = "concat('a', x, 'b', x, 'c', eol, '1', x, '2', x, '3;4', eol, '5', x, '6', x, '7', eol)"
_EOL = {0: "\r\n", 1: "\n", 2: "\r"}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.get(F.array(*[F.lit(x) for x in tabular.DELIMITERS]), (F.col("c_custkey") % 4).cast("int"))
    eol = F.get(F.array(*[F.lit(_EOL[k]) for k in range(3)]), (F.col("c_custkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", d.alias("x"), eol.alias("eol"))
    return rows.select("c_custkey", F.expr(_SAMPLE_TEXT).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ';' END AS delimiter FROM customer")
def delimiter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("c_custkey", tabular.delimiter(F.col("text")).alias("delimiter"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'CRLF' WHEN 1 THEN 'LF' ELSE 'CR' END AS line_ending FROM customer")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("c_custkey", tabular.line_ending(F.col("text")).alias("line_ending"))


@query("""SELECT c_custkey, k.row, k.n AS width, k.first FROM customer, (VALUES (2, '1'), (3, '5')) AS v(row, first), LATERAL (SELECT CAST(v.row AS INT) AS row, v.first AS first,
 CASE WHEN c_custkey % 4 = 3 AND v.row = 2 THEN 4 ELSE 3 END AS n) k""")
def tabular_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [tabular.rows(_texts(spark, sf_dir).filter(F.col("c_custkey") % 4 == k), d) for k, d in enumerate(tabular.DELIMITERS)]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.select("c_custkey", "row", F.size("fields").alias("width"), F.get("fields", 0).alias("first"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN 'C:\\' || url WHEN 2 THEN 'in/../' || url WHEN 3 THEN 'a\\..\\b' ELSE 'in/' || page_id || '.csv' END AS p FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ABSOLUTE_PATH' WHEN 1 THEN 'ABSOLUTE_PATH' WHEN 2 THEN 'PATH_TRAVERSAL' WHEN 3 THEN 'PATH_TRAVERSAL' END AS problem FROM p""")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    path = (
        F.when(k == 0, F.concat(F.lit("/"), "url")).when(k == 1, F.concat(F.lit("C:\\"), "url")).when(k == 2, F.concat(F.lit("in/../"), "url"))
        .when(k == 3, F.lit("a\\..\\b")).otherwise(F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(".csv")))
    )
    return table(spark, sf_dir, "pages").select("page_id", archive.path_problem(path).alias("problem"))


_NAMES = (".CSV", ".xlsx", ".xls", ".json", ".kmz", ".doc", ".bin")


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'TABULAR' WHEN 1 THEN 'SPREADSHEET' WHEN 2 THEN 'SPREADSHEET' WHEN 3 THEN 'STRUCTURED' WHEN 4 THEN 'GEOSPATIAL' WHEN 5 THEN 'DOCUMENT' ELSE 'UNKNOWN' END AS kind,
 page_id % 7 < 2 AS parseable, CASE page_id % 7 WHEN 2 THEN 'an old binary workbook: save it as .xlsx or CSV, note that in the case, then import' WHEN 3 THEN 'needs a mapping before it can be imported'
 WHEN 4 THEN 'kept as evidence; maps are loaded as layers' WHEN 5 THEN 'kept beside the records; a cover letter often says which time zone they are in, so read it first'
 WHEN 6 THEN 'kept, not parsed: of no known kind' END AS note FROM pages""")
def member_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("page_id") % 7).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", archive.member_kind(F.concat(F.lit("file"), F.col("page_id").cast("string"), end)).alias("k"))
    return rows.select("page_id", "k.kind", "k.parseable", "k.note")


# Fixed values, as the survey lists them: the headers that formats need, may have, and must not have.
_HEADERS = """h(format, required, optional, forbidden) AS (VALUES
 ('att.tower-dump', ['Target Number', 'IMSI', 'IMEI', 'Date/Time', 'Cell ID'], ['Call Type', 'Direction', 'Duration (sec)', 'Other Party', 'Site', 'Sector', 'Technology', 'Timing Advance', 'RSRP'], ['Latitude', 'Longitude']),
 ('att.cell-site-list', ['Cell ID', 'Latitude', 'Longitude'], ['Site', 'Sector', 'Site Name', 'Street Address', 'Azimuth', 'Technology'], []::VARCHAR[]),
 ('verizon.tower-dump', ['MDN', 'Date', 'Time', 'Cell Site'], ['MIN', 'IMSI', 'ESN/IMEI', 'Time Zone', 'Seizure Type', 'Direction', 'Duration', 'Dialed Digits', 'Sector', 'Switch', 'RTT'], ['Latitude', 'Longitude']),
 ('verizon.cell-site-list', ['Cell Site', 'Latitude', 'Longitude'], ['Sector', 'Site Name', 'Address', 'Azimuth', 'Beamwidth', 'Technology'], []::VARCHAR[]),
 ('tmobile.tower-dump', ['MSISDN', 'IMSI', 'EventTimestamp', 'CellIdentity'], ['IMEI', 'EventType', 'CallDirection', 'DurationSeconds', 'OtherPartyNumber', 'eNodeB', 'SectorNumber', 'LAC', 'TAC', 'RAT', 'TimingAdvance'], ['Latitude', 'Longitude']),
 ('tmobile.cell-site-list', ['CellIdentity', 'Latitude', 'Longitude'], ['eNodeB', 'SectorNumber', 'SiteName', 'AzimuthDegrees', 'HorizontalBeamwidth', 'RAT', 'Band'], []::VARCHAR[]),
 ('uscellular.tower-dump', ['SUBSCRIBER_NBR', 'IMSI_NBR', 'EVENT_DTM', 'CELL_ID'], ['EQUIPMENT_ID', 'EVENT_CD', 'DIR_CD', 'DUR_SEC', 'OTHER_NBR', 'SITE_CD', 'SECT_CD', 'TA_VAL'], ['LAT_DEC', 'LON_DEC']),
 ('uscellular.cell-site-list', ['CELL_ID', 'LAT_DEC', 'LON_DEC'], ['SITE_CD', 'SECT_CD', 'AZIMUTH_DEG', 'BEAM_DEG'], []::VARCHAR[]))"""


@query(f"""WITH {_HEADERS}, k AS (SELECT *, row_number() OVER () - 1 AS k FROM h),
n AS (SELECT n_nationkey AS file, CASE WHEN n_nationkey % 9 = 8 THEN ['x', 'y'] ELSE list_concat(required, optional[1:CAST(n_nationkey AS INT) // 9 + 2]) END AS own FROM nation LEFT JOIN k ON k.k = n_nationkey % 9),
p AS (SELECT file, [regexp_replace(lower(x), '[ _./()-]', '', 'g') FOR x IN own] AS own FROM n),
f AS (SELECT format, [regexp_replace(lower(x), '[ _./()-]', '', 'g') FOR x IN required] AS r, [regexp_replace(lower(x), '[ _./()-]', '', 'g') FOR x IN optional] AS o,
 [regexp_replace(lower(x), '[ _./()-]', '', 'g') FOR x IN forbidden] AS b FROM h)
SELECT file, format, CAST(len(list_intersect(r, own)) AS INT) AS required, CAST(len(list_intersect(o, own)) AS DOUBLE) / len(o) AS optional, len(list_intersect(r, own)) = len(r) AND len(list_intersect(b, own)) = 0 AS fits FROM p, f""")
def format_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers are a format's, in capitals and with other separators."""
    lists = F.array(*[F.array(*[F.lit(h) for h in (*f.required, *f.optional)]) for f in formats.BUILT_IN], F.array(F.lit("x"), F.lit("y")))
    need = F.array(*[F.lit(len(f.required)) for f in formats.BUILT_IN], F.lit(2))
    k = (F.col("n_nationkey") % 9).cast("int")
    own = F.slice(F.get(lists, k), F.lit(1), F.get(need, k) + F.when(k < 8, F.floor(F.col("n_nationkey") / 9).cast("int") + 2).otherwise(0))
    headers = F.transform(own, lambda h: F.upper(F.replace(h, F.lit(" "), F.lit("__"))))
    return detect.headers_scored(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), headers.alias("headers")))


_FIRST_ROWS = "c AS (SELECT * FROM (" + CARRIER_ROWS.replace("{events}", "events") + ") ORDER BY src_row LIMIT 50)"


@query(f"""WITH {_FIRST_ROWS}, {_VALUES}, w AS (SELECT *, regexp_replace(r, '[^0-9]', '', 'g') AS d FROM v), x AS (SELECT *, length(d) AS n, {_OPERATOR} IS NOT NULL AS known, {_LUHN15} AS luhn FROM w),
y AS (SELECT col, avg(CASE WHEN {_TYPE} = upper(col) THEN 1e0 ELSE 0e0 END) FILTER (upper(trim(r)) NOT IN {_TOKENS}) AS share FROM x WHERE col IN ('msisdn', 'imsi', 'imei') GROUP BY 1),
{_TIME}, z AS (SELECT (0.35e0 + 0.15e0 + 0.1e0 * 0.2e0 + 0.25e0 * (SELECT avg(CASE WHEN share >= 0.8 THEN 1e0 ELSE 0e0 END) FROM y) + 0.1e0 * (SELECT avg(CASE WHEN utc IS NULL THEN 0e0 ELSE 1e0 END) FROM t)) / 0.95e0 AS s)
SELECT 'fixture' AS file, 'fixture.rows' AS best, 'NEEDS_CONFIRMATION' AS decision, round(s, 4) AS confidence FROM z""")
def format_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    rows = source_rows(spark, sf_dir).orderBy("row")
    found = detect.detect(rows, COLUMNS, ";", "calls.csv", formats=(*formats.BUILT_IN, FORMAT))
    best = found[0] if found else None
    return spark.createDataFrame([("fixture", best.format.id if best else None, detect.route(found), round(best.confidence, 4) if best else 0.0)], "file string, best string, decision string, confidence double")


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    header = F.array(*[F.lit(c) for c in COLUMNS])
    return profile.profile(source_rows(spark, sf_dir).withColumn("header", header))


@query(f"""WITH {_ROWS}, k AS (SELECT * FROM c ORDER BY src_row LIMIT 200), u AS (""" + " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS header, src_row, {c} AS v FROM k" for k, c in enumerate(COLUMNS)) + f""")
SELECT CAST(position AS INT) AS position, header, avg(CASE WHEN upper(trim(v)) IN {_TOKENS} THEN 0.0e0 ELSE 1.0e0 END) AS populated,
 coalesce(count(DISTINCT CASE WHEN upper(trim(v)) NOT IN {_TOKENS} THEN v END) / nullif(count(*) FILTER (upper(trim(v)) NOT IN {_TOKENS}), 0), 0.0e0) AS distinct_ratio,
 CASE WHEN header IN ('msisdn_raw', 'ts_raw') THEN 'TEXT' WHEN header IN ('imsi_raw', 'imei_raw', 'site') THEN 'IDENTIFIER' WHEN header IN ('ta_raw', 'dur_raw') THEN 'NUMERIC' ELSE 'CODE' END AS kind,
 CASE WHEN header IN ('imsi_raw', 'imei_raw') THEN 'IMSI' WHEN header = 'site' THEN 'IP_ADDRESS' END AS identifier_type FROM u GROUP BY 1, 2""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).select("position", "header", "populated", "distinct_ratio", "kind", "identifier_type")


# By hand: a header's weight, and 0.55 for values that agree, or 0.55 times 0.7 for numbers and codes; what reaches 0.85 needs no approval.
@query("""SELECT * FROM (VALUES ('imsi', 'imsi_raw', 1e0, false), ('timing_advance', 'ta_raw', 0.5e0 + 0.55e0 * 0.7e0, false), ('technology', 'rat', 0.45e0 + 0.55e0 * 0.7e0, true),
 ('direction', 'dir_code', 0.45e0 + 0.55e0 * 0.7e0, true), ('duration_sec', 'dur_raw', 0.45e0 + 0.55e0 * 0.7e0, true), ('imei', 'imei_raw', 0.5e0, true), ('msisdn', 'msisdn_raw', 0.45e0, true),
 ('site_id', 'site', 0.4e0, true), ('sector_id', 'sector', 0.4e0, true)) t(field, header, confidence, requires_approval)""")
def mapping_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.suggest(_profiled(spark, sf_dir))
    rows = [(f, m["header"], float(m["confidence"]), m["requires_approval"]) for f, m in found["mapping"].items()]
    return spark.createDataFrame(rows, "field string, header string, confidence double, requires_approval boolean")


# --- geodesy ----------------------------------------------------------------------------------------

_R = geodesy.EARTH_RADIUS_M
_POINTS = "p AS (SELECT event_id, user_id, ts, 39.0e0 + (user_id % 40) * 0.01e0 AS lat, -105.0e0 + (event_id % 37) * 0.01e0 AS lon, 30e0 + (event_id % 60) AS lat2, -120e0 + (event_id % 90) AS lon2 FROM {events})"
_HAVERSINE = f"2 * {_R} * asin(least(1.0e0, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH " + _POINTS + " SELECT * FROM p", events=table(spark, sf_dir, "events"))


_P = _POINTS.format(events="events")


def _corners() -> list:
    return [F.col(k) for k in ("lat", "lon", "lat2", "lon2")]


@query(f"WITH {_P} SELECT event_id, round({_HAVERSINE}, 2) AS metres FROM p")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("event_id", F.round(geodesy.distance_m(*_corners()), 2).alias("metres"))


@query(f"""WITH {_P}, b AS (SELECT event_id, degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) AS d FROM p)
SELECT event_id, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS degrees, round(least(abs((CASE WHEN d < 0 THEN d + 360 ELSE d END) - 350), 360 - abs((CASE WHEN d < 0 THEN d + 360 ELSE d END) - 350)), 6) AS from_350 FROM b""")
def bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geodesy.bearing(*_corners())
    return _points(spark, sf_dir).select("event_id", F.round(b, 6).alias("degrees"), F.round(geodesy.bearing_difference(b, F.lit(-10.0)), 6).alias("from_350"))


@query(f"""WITH {_P}, a AS (SELECT event_id, radians(lat) AS f, lon, radians(event_id % 360) AS t, (event_id % 5000) * 10.0e0 / {_R} AS d FROM p),
e AS (SELECT *, asin(sin(f) * cos(d) + cos(f) * sin(d) * cos(t)) AS g FROM a)
SELECT event_id, round(degrees(g), 6) AS lat, round(lon + degrees(atan2(sin(t) * sin(d) * cos(f), cos(d) - sin(f) * sin(g))), 6) AS lon FROM e""")
def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = geodesy.destination(F.col("lat"), F.col("lon"), (F.col("event_id") % 360).cast("double"), (F.col("event_id") % 5000) * 10.0)
    rows = _points(spark, sf_dir).select("event_id", to.alias("to"))
    return rows.select("event_id", F.round("to.lat", 6).alias("lat"), F.round("to.lon", 6).alias("lon"))


_PLACES = "s AS (SELECT s_suppkey, 39.0e0 + (s_suppkey % 50) * 0.009e0 AS lat2, -105.0e0 + (s_suppkey % 43) * 0.009e0 AS lon2 FROM {supplier})"


@query(f"""WITH x AS (SELECT event_id, 39.0e0 + (user_id % 40) * 0.01e0 AS lat, -105.0e0 + (event_id % 37) * 0.01e0 AS lon FROM events), {_PLACES.format(supplier='supplier')}
SELECT s_suppkey, count(*) AS n, round(min({_HAVERSINE}), 2) AS nearest_m FROM x, s WHERE {_HAVERSINE} <= 900 GROUP BY 1""")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _points(spark, sf_dir).select("event_id", "lat", "lon")
    right = spark.sql("WITH " + _PLACES + " SELECT * FROM s", supplier=table(spark, sf_dir, "supplier"))
    return correlate.near(left, right, 900).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.min("distance_m"), 2).alias("nearest_m"))


_RING = [(-104.95, 39.05), (-104.75, 39.08), (-104.70, 39.30), (-104.88, 39.22), (-104.97, 39.33)]


def _inside_sql() -> str:
    terms = []
    for (ax, ay), (bx, by) in zip(_RING, [*_RING[1:], _RING[0]], strict=True):
        ax, ay, bx, by = (f"({v!r}e0)" for v in (ax, ay, bx, by))
        terms.append(f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < ({bx} - {ax}) * (lat - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(f"WITH {_P} SELECT event_id, {_inside_sql()} AS inside FROM p")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING])
    return _points(spark, sf_dir).select("event_id", geodesy.in_polygon(F.col("lat"), F.col("lon"), ring).alias("inside"))


@query(f"""WITH n AS (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS a FROM nation) SELECT n_nationkey, round(abs((radians(1.0e0) * (2 + 2 * sin(radians(a))) + radians(-1.0e0) * (2 + 2 * sin(radians(a + 1)))) * {_R} * {_R} / 2) / 1e6, 3) AS km2 FROM n""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("n_nationkey").cast("double")
    ring = F.array(*[F.struct((F.lit(10.0) + x).alias("x"), (a + y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(geodesy.polygon_area_m2(ring) / 1e6, 3).alias("km2"))


@query(f"""WITH {_P}, w AS (SELECT event_id, ts, lag(ts) OVER o AS t0, lag(lat) OVER o AS lat2, lag(lon) OVER o AS lon2, lat, lon FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN ts > t0 THEN round({_HAVERSINE} / (epoch_us(ts) / 1e6 - epoch_us(t0) / 1e6), 4) END AS mps FROM w""")
def implied_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    rows = _points(spark, sf_dir).withColumn("ts_utc", F.col("ts").cast("timestamp"))
    return correlate.speeds(rows, "user_id").select("event_id", F.round("speed_mps", 4).alias("mps"))


# --- evidence ---------------------------------------------------------------------------------------

_LAYER = "CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'CALCULATED' WHEN 2 THEN 'ANALYST_ASSERTED' ELSE 'INFERRED' END"


@query(f"SELECT l_orderkey, arg_min({_LAYER}, 3 - l_partkey % 4) AS weakest, bool_and(l_partkey % 4 = 0) AS factual FROM lineitem GROUP BY 1")
def weakest_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_LAYER).alias("layer"))
    return rows.groupBy("l_orderkey").agg(evidence.weakest(F.col("layer")).alias("weakest"), F.bool_and(evidence.is_factual(F.col("layer"))).alias("factual"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, greatest(0e0, least(1e0, l_discount * 14 - 0.1e0)) AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS band FROM s""")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_discount") * 14 - F.lit(0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evidence.confidence(score).alias("c")).select("l_orderkey", "l_linenumber", "c.score", "c.band")


def _reference() -> F.Column:
    line = F.col("l_linenumber")
    return evidence.reference(
        case_id=F.concat(F.lit("case "), (F.col("l_orderkey") % 3).cast("string")), package_id=F.when(line > 1, F.concat(F.lit("pkg "), (F.col("l_suppkey") % 2).cast("string"))),
        source_file_id=F.when(line > 2, F.lit("file")), container=F.when(line > 5, F.lit("book.xlsx")), sheet=F.when(line > 5, F.lit("sheet 1")), row=F.when(line > 2, F.col("l_partkey") % 3),
        column=F.when(line == 4, F.lit("IMSI")), row_hash=F.when(line > 3, F.lit("h")), record_id=F.when(line > 3, F.lit("rec")), transform_id=F.when(line > 5, F.lit("t@1")), finding_id=F.when(line > 6, F.lit("finding")),
    )


_REF = "'case ' || (l_orderkey % 3) AS a, CASE WHEN l_linenumber > 1 THEN 'pkg ' || (l_suppkey % 2) END AS b, CASE WHEN l_linenumber > 2 THEN 'file' END AS c, CASE WHEN l_linenumber > 5 THEN 'book.xlsx' END AS m, CASE WHEN l_linenumber > 5 THEN 'sheet 1' END AS d, CASE WHEN l_linenumber > 2 THEN l_partkey % 3 END AS e, CASE WHEN l_linenumber > 3 THEN 'rec' END AS f"


@query(f"WITH r AS (SELECT l_orderkey, {_REF} FROM lineitem) SELECT l_orderkey, count(*) AS refs FROM (SELECT DISTINCT l_orderkey, a, b, c, d, e, f FROM r) GROUP BY 1")
def collect_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(_reference()).alias("provenance"))
    return evidence.collected_provenance(rows, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("refs"))


_LINES = f"""r AS (SELECT l_orderkey, l_linenumber, {_REF}, CASE WHEN l_linenumber = 4 THEN 'IMSI' END AS col, CASE WHEN l_linenumber > 3 THEN 'h' END AS hash, CASE WHEN l_linenumber > 5 THEN 't@1' END AS t, CASE WHEN l_linenumber > 6 THEN 'finding' END AS g FROM lineitem)"""


@query(f"""WITH {_LINES}
SELECT l_orderkey, l_linenumber, concat_ws(' > ', 'CASE=' || a || '/' || a, 'EVIDENCE_PACKAGE=' || b || '/package ' || b, 'SOURCE_FILE=' || c || '/' || c, 'TABLE=' || d || '/' || d, 'SOURCE_ROW=row:' || e || '/Row ' || e, 'NORMALIZED_RECORD=' || f || '/' || f,
  'TRANSFORMATION=' || t || '/' || t, 'FINDING=' || g || '/' || g) AS chain,
 concat_ws(',', 'container=' || m, CASE WHEN e IS NOT NULL THEN 'row=' || e END, 'column=' || col, 'rowHash=' || hash) AS detail,
 array_to_string([a, coalesce(b, ''), coalesce(c, ''), coalesce(m, ''), coalesce(d, ''), coalesce(CAST(e AS VARCHAR), ''), coalesce(col, ''), coalesce(f, ''), '', coalesce(g, '')], '|') AS key FROM r""")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {"EVIDENCE_PACKAGE": F.concat(F.lit("package "), F.col("r.package_id"))}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _reference().alias("r"))
    rows = rows.withColumn("c", evidence.chain(F.col("r"), labels))
    text = F.array_join(F.transform("c", lambda n: F.concat(n["stage"], F.lit("="), n["id"], F.lit("/"), n["label"])), " > ")
    pairs = F.flatten(F.transform("c", lambda n: F.coalesce(F.map_entries(n["detail"]), F.array().cast("array<struct<key:string,value:string>>"))))
    detail = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("l_orderkey", "l_linenumber", text.alias("chain"), detail.alias("detail"), evidence.provenance_key(F.col("r")).alias("key"))


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, to_json({{case_id: a, package_id: b, source_file_id: c, container: m, sheet: d, "row": e, "column": col, row_hash: hash, record_id: f}}) AS ref FROM r""")
def source_row_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = evidence.source_row(_reference())
    kept = F.struct(*[ref[c].alias(c) for c in ("case_id", "package_id", "source_file_id", "container", "sheet", "row", "column", "row_hash", "record_id")])
    late = F.coalesce(ref["transform_id"], ref["analysis_run_id"], ref["finding_id"])  # none may be left
    text = F.when(late.isNull(), F.to_json(kept, {"ignoreNullFields": "false"}))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("ref"))


@query("""SELECT o_orderkey AS explanation_id, 'order ' || o_orderkey || chr(10) || '  • (OBSERVED) status ' || o_orderstatus || CASE WHEN o_orderkey % 3 > 0 THEN ' [' || (o_orderkey % 3) || ' source record(s)]' ELSE '' END || chr(10)
 || '    • (CALCULATED) priority ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '  Evidence against:' || chr(10) || '    • (INFERRED) even' ELSE '' END || chr(10) || '  Caveats:' || chr(10) || '    • test data' AS text FROM orders""")
def explanation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.rendered(_explained(spark, sf_dir))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ref = lambda k: evidence.reference(case_id=F.lit("c"), source_file_id=F.lit("orders"), row=key * 10 + k)
    refs = F.slice(F.array(ref(0), ref(1)), F.lit(1), (key % 3).cast("int"))
    told = evidence.explanation(
        F.concat(F.lit("order "), key.cast("string")),
        (evidence.reason("OBSERVED", F.concat(F.lit("status "), "o_orderstatus"), refs, {"price": F.col("o_totalprice")}, (evidence.reason("CALCULATED", F.concat(F.lit("priority "), "o_orderpriority")),)),),
        caveats=(F.lit("test data"),), contra=(evidence.reason("INFERRED", F.lit("even"), when=key % 2 == 0),),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", told.alias("told"))
    return evidence.nodes(rows, "o_orderkey", F.col("told"))


@query("SELECT o_orderkey AS explanation_id, 'REASON' AS section, '1' AS path, k AS place, o_orderkey * 10 + k AS row FROM orders, (VALUES (0), (1)) v(k) WHERE k < o_orderkey % 3")
def explanation_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = evidence.explanation_provenance(_explained(spark, sf_dir))
    return cited.select("explanation_id", "section", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "place", F.col("reference.row").alias("row"))


@query("SELECT p_brand AS id, arg_max(v, k) AS version FROM (SELECT p_brand, (p_partkey % 3) || '.' || (p_partkey % 12) AS v, (p_partkey % 3) * 100 + p_partkey % 12 AS k FROM part) GROUP BY 1")
def method_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    return evidence.latest(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), version.alias("version")))


@query("""WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT CASE WHEN l_linenumber = 7 THEN 'NO_HASH_RECORDED' WHEN l_linenumber = 6 THEN 'SOURCE_UNAVAILABLE' WHEN l_linenumber = 5 THEN 'HASH_MISMATCH' ELSE 'VERIFIED' END AS result, count(*) AS n FROM v GROUP BY 1""")
def row_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = lines.select(F.col("l_orderkey").cast("string").alias("source_file_id"), F.col("l_linenumber").alias("row"), raw.alias("raw"))
    h = F.when(F.col("row") == 5, F.lit("x")).when(F.col("row") != 7, F.sha2("raw", 256))
    events = rows.select("source_file_id", "row", F.col("raw").alias("event_id"), h.alias("row_hash"))
    return evidence.verified_rows(events, rows.filter("row <> 6")).groupBy("result").agg(F.count("*").alias("n"))


# --- export -----------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_suppkey || ',' || s_name || ',' || CASE s_suppkey % 4 WHEN 0 THEN '''-' || s_nationkey WHEN 1 THEN '\"a \"\"b\"\", c\"' WHEN 2 THEN '''=1+1' ELSE '' END AS line FROM supplier")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    odd = F.when(k == 0, F.concat(F.lit("-"), F.col("s_nationkey").cast("string"))).when(k == 1, F.lit('a "b", c')).when(k == 2, F.lit("=1+1"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", export.csv_lines(None, {"id": F.col("s_suppkey"), "name": F.col("s_name"), "odd": odd}).alias("line"))


@query("""SELECT s_suppkey, '<Placemark><name>' || s_name || ' &amp; &lt;co&gt;</name><styleUrl>#OBSERVED</styleUrl><description><![CDATA[nation ' || s_nationkey || ' ]]]]><![CDATA[>]]></description><Point><coordinates>'
 || printf('%.6f', -100.5e0 - s_nationkey) || ',' || printf('%.6f', 30.25e0 + s_nationkey) || ',0</coordinates></Point></Placemark>' AS line FROM supplier""")
def export_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    line = export.placemark(F.concat("s_name", F.lit(" & <co>")), F.lit("OBSERVED"), n + 30.25, F.lit(-100.5) - n, F.concat(F.lit("nation "), n.cast("string"), F.lit(" ]]>")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))


@query("""SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (-100.5e0 - s_nationkey) || ',' || (30.25e0 + s_nationkey) || ']},"properties":{"name":"' || s_name || '"}}' AS line FROM supplier""")
def export_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", export.feature(n + 30.25, F.lit(-100.5) - n, F.struct(F.col("s_name").alias("name"))).alias("line"))


# --- extensions -------------------------------------------------------------------------------------


@query(f"""WITH {_JOINED}, k AS (SELECT 'IMEI:' || imei AS key, technology FROM j WHERE NOT rejected AND imei IS NOT NULL UNION ALL SELECT 'IMSI:' || imsi, technology FROM j WHERE NOT rejected AND imsi IS NOT NULL
UNION ALL SELECT 'MSISDN:' || msisdn, technology FROM j WHERE NOT rejected AND msisdn IS NOT NULL)
SELECT key AS identifier_key, count(DISTINCT technology) AS datasets, count(*) AS events FROM k GROUP BY 1 HAVING count(DISTINCT technology) >= 2""")
def shared_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.shared(normalize.accepted(_found(spark, sf_dir)).select("msisdn", "imsi", "imei", "technology"), "technology")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def device_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts_utc"))
    return correlate.sessions(events, "user_id", "6 hours 1 microsecond")


@query("""SELECT e.event_id, v.version FROM events e ASOF LEFT JOIN (SELECT c_custkey % 150 AS user_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 700 AS BIGINT)) AS valid_from, max(c_custkey) AS version FROM customer GROUP BY 1, 2) v
ON e.user_id = v.user_id AND e.ts >= v.valid_from""")
def as_of_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    since = F.timestamp_seconds(F.lit(1704067200) + (F.col("c_custkey") % 700) * 3600)
    versions = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 150).alias("user_id"), since.alias("valid_from")).agg(F.max("c_custkey").alias("version"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts_utc"))
    return correlate.as_of(events, versions, "user_id").select("event_id", "version")
