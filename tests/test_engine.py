"""Identifiers, times, geometry, integrity and normalization on cases worked out by hand."""

import math
import random
import time
from collections import Counter
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from celltrail import queries as engine
from celltrail.functions import geodesy, identifiers as ids, integrity, ordered, times
from celltrail.operators import correlate, evidence, normalize
from celltrail.plans import detect, formats, profile


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,normalized,valid",
    [
        ("(303) 555-0123", "+13035550123", True), ("1-303-555-0123", "+13035550123", True), ("+13035550123", "+13035550123", True), ("611", "611", True),
        ("+44 20 7946 0123", "+442079460123", True), ("011442079460123", "+442079460123", False), ("44207946012", "44207946012", False),
        ("RESTRICTED", None, False), (" n/a ", None, False), ("0", None, False), ("12", None, False), ("+12", "+12", False), ("1234567", None, False),
    ],
)
def test_msisdn(spark, raw, normalized, valid):
    m = one(spark, ids.msisdn(F.lit(raw)))
    assert (m.normalized, m.valid) == (normalized, valid)


@pytest.mark.parametrize("raw,body,valid,form", [("490154203237518", "49015420323751", True, "IMEI"), ("490154203237517", "49015420323751", False, "IMEI"), ("4901542032375180", "49015420323751", True, "IMEISV"), ("49015420323751", "49015420323751", True, "IMEI_NO_CHECK_DIGIT"), ("1" * 14, "1" * 14, False, "IMEI_NO_CHECK_DIGIT"), ("123", None, False, None)])
def test_imei(spark, raw, body, valid, form):
    m = one(spark, ids.imei(F.lit(raw)))
    assert (m.normalized, m.valid, (m.derived or {}).get("form")) == (body, valid, form)


@pytest.mark.parametrize("raw,valid,operator", [("310410123456789", True, "AT&T"), ("310999123456789", False, None), ("234151234567890", True, None), ("31041012345678", False, "AT&T"), ("12345", False, None)])
def test_imsi(spark, raw, valid, operator):
    m = one(spark, ids.imsi(F.lit(raw)))
    assert (m.valid, (m.derived or {}).get("operator")) == (valid, operator)


def test_keys_and_masks(spark):
    assert one(spark, ids.parsed_key(F.lit("SIP_URI:sip:a:b"))).value == "sip:a:b"
    assert one(spark, ids.parsed_key(F.lit("NOPE:1"))) is None
    assert one(spark, ids.masked(F.lit("+13035550123"))) == "••••••••0123"
    assert one(spark, ids.inferred(F.lit("sip:a@b"))).type == "SIP_URI"
    assert one(spark, ids.inferred(F.lit("10.0.0.1"))).type == "IP_ADDRESS"


NEW_YORK = "America/New_York"


@pytest.mark.parametrize(
    "raw,utc,confidence",
    [
        ("2024-03-15T14:30:00-07:00", "2024-03-15 21:30:00", "EXACT"), ("2024-03-15T21:30:00Z", "2024-03-15 21:30:00", "EXACT"),
        ("03/15/2024 02:30:00 PM", "2024-03-15 18:30:00", "ZONE_DECLARED"), ("15-MAR-24 02.30.00.000000 PM", "2024-03-15 18:30:00", "ZONE_DECLARED"),
        ("1710538200", "2024-03-15 21:30:00", "EXACT"), ("20240315143000", "2024-03-15 18:30:00", "ZONE_DECLARED"), ("2024-11-03 01:30:00", "2024-11-03 05:30:00", "DST_AMBIGUOUS"),
        ("2024-03-10 02:30:00", "2024-03-10 07:30:00", "DST_NONEXISTENT"), ("2024-03-15 14:30:00 CST", "2024-03-15 19:30:00", "ZONE_DECLARED"),
        ("15/03/2024 14:30:00", "2024-03-15 18:30:00", "ZONE_DECLARED"), ("03/15/99 14:30:00", "1999-03-15 19:30:00", "ZONE_DECLARED"), ("3/5/2024 14:30", None, "UNRESOLVED"), ("", None, "UNRESOLVED"), (None, None, "UNRESOLVED"),
    ],
)
def test_times(spark, raw, utc, confidence):
    df = spark.createDataFrame([(raw,)], "t string")
    got = times.with_time(df, "t", package_zone=NEW_YORK).select("time.*").first()
    assert (str(got.utc) if got.utc else None, got.confidence) == (utc, confidence)


@pytest.mark.parametrize(
    "raw,utc,format_",
    [
        ("Fri, 15 Mar 2024 14:30:00 -0700", "2024-03-15 21:30:00", "RFC 2822"), ("15 Mar 2024 14:30 EDT", "2024-03-15 18:30:00", "RFC 2822"),
        ("Sun, 06 Nov 1994 08:49:37 GMT", "1994-11-06 08:49:37", "RFC 2822"), ("Sunday, 06-Nov-94 08:49:37 GMT", "1994-11-06 08:49:37", "HTTP date"),
        ("Sun Nov  6 08:49:37 1994", "1994-11-06 08:49:37", "HTTP date"), ("06 Nov 24 08:49:37 +0530", "2024-11-06 03:19:37", "RFC 2822"), ("2024-03-15T14", None, None),
    ],
)
def test_dates_of_mails_and_web_servers(spark, raw, utc, format_):
    df = spark.createDataFrame([(raw,)], "t string")
    got = times.with_time(df, "t", package_zone=NEW_YORK).select("time.*").first()
    assert (str(got.utc) if got.utc else None, got.matched_format) == (utc, format_)
    assert got.confidence == ("EXACT" if utc else "UNRESOLVED")


def test_every_format_of_the_ladder(spark):
    moment = datetime(2024, 3, 5, 14, 7, 9)
    shown = {"yyyy": "2024", "yy": "24", "MMM": "MAR", "MM": "03", "dd": "05", "HH": "14", "hh": "02", "mm": "07", "SSS": "000", "ss": "09", "XXX": "+00:00", " a": " pm", "'T'": "T"}

    def text(pattern):
        out, at = "", 0
        while at < len(pattern):
            token = next((t for t in sorted(shown, key=len, reverse=True) if pattern.startswith(t, at)), pattern[at])
            out, at = out + shown.get(token, token), at + len(token)
        return out

    rows = [(p, text(p)) for p in (*times.FORMATS, *times.DAY_FIRST)]
    for r in times.with_time(spark.createDataFrame(rows, "p string, t string"), "t", day_first=False).collect():
        due = moment.replace(second=moment.second if "ss" in r.p else 0)
        if r.p == "dd.MM.yyyy HH:mm:ss":  # the year behind a point is cut like a fraction of more than three digits
            assert r.time.utc is None and r.time.confidence == "UNRESOLVED"
            continue
        if r.p in times.DAY_FIRST:  # 05/03 is the third of May unless the day is first
            due = due.replace(month=5, day=3)
        assert r.time.utc == due, (r.p, r.t, r.time)
    first = times.with_time(spark.createDataFrame([("05/03/2024 14:07:09",)], "t string"), "t", day_first=True).first().time
    assert first.utc == moment


def test_event_plan_is_small_and_compiles(spark, tmp_path):
    """Every step of the event plan is generated code that compiles, and nothing is pulled in over and over."""
    ts = datetime(2024, 1, 1)
    spark.createDataFrame([(k, ts, k, "click") for k in range(20)], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    names = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        for query in (engine.normalize_events, engine.quality_flags, engine.shared_identifiers, engine.sector_device_counts):
            df = query(spark, str(tmp_path))
            began = time.perf_counter()
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert time.perf_counter() - began < 5 and len(plan) < 150_000
            assert df.count() >= 0 and df.collect() is not None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_zones_and_precedence(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "PST"), ("2024-01-01 00:00:00", "junk"), ("2024-01-01 00:00:00", None)], "t string, z string")
    rows = times.with_time(df, "t", row_zone="z", package_zone="nonsense", carrier_zone="UTC+2").select("time.*").collect()
    assert [(str(r.utc), r.method) for r in rows] == [("2024-01-01 08:00:00", "SOURCE_DECLARED_ZONE"), ("2023-12-31 22:00:00", "CARRIER_DOCUMENTED_DEFAULT"), ("2023-12-31 22:00:00", "CARRIER_DOCUMENTED_DEFAULT")]
    assert [times.canonical_zone(z) for z in ("edt", "GMT-0730", "+5", "", "Nowhere")] == [NEW_YORK, "UTC-7:30", "UTC+5", None, None]


def test_times_against_zoneinfo(spark):
    zone, rows = ZoneInfo("Europe/London"), [(f"{y}-{m:02d}-{d:02d} {h:02d}:15:00",) for y in (1999, 2024) for m in range(1, 13) for d in (1, 15, 28) for h in (0, 1, 13)]
    got = times.with_time(spark.createDataFrame(rows, "t string"), "t", package_zone="Europe/London").select("t", F.unix_seconds("time.utc").alias("u"), "time.confidence").collect()
    for r in got:
        if r.confidence == "ZONE_DECLARED":
            assert r.u == int(datetime.fromisoformat(r.t).replace(tzinfo=zone).timestamp())


def test_geometry(spark):
    a, b = (F.lit(40.6413), F.lit(-73.7781)), (F.lit(51.47), F.lit(-0.4543))
    assert one(spark, geodesy.distance_m(*a, *b)) == pytest.approx(5.54e6, rel=0.01)
    for bearing in range(0, 360, 45):
        for metres in (10.0, 1e3, 1e5):
            to = one(spark, geodesy.destination(F.lit(39.7), F.lit(-105.0), F.lit(float(bearing)), F.lit(metres)))
            assert one(spark, geodesy.distance_m(F.lit(39.7), F.lit(-105.0), F.lit(to.lat), F.lit(to.lon))) == pytest.approx(metres, rel=1e-6)
    assert one(spark, geodesy.bearing_difference(F.lit(350.0), F.lit(10.0))) == 20
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    assert one(spark, geodesy.in_polygon(F.lit(0.5), F.lit(0.5), ring)) and not one(spark, geodesy.in_polygon(F.lit(1.5), F.lit(0.5), ring))
    assert one(spark, geodesy.polygon_area_m2(ring)) == pytest.approx((geodesy.EARTH_RADIUS_M * math.pi / 180) ** 2, rel=1e-3)
    assert one(spark, geodesy.speed_mps(F.lit(5.0), F.lit(0.0))) is None


def test_integrity(spark):
    assert one(spark, integrity.record_id(F.lit("a"), F.lit(None))) != one(spark, integrity.record_id(F.lit(None), F.lit("a")))
    assert integrity.canonical_json({"b": 1, "a": {"d": None, "c": [2, 1]}}) == '{"a":{"c":[2,1]},"b":1}'
    loop: dict = {}
    loop["x"] = loop
    with pytest.raises(ValueError):
        integrity.canonical_json(loop)


@pytest.mark.parametrize("key", [None, "secret"])
def test_audit_chain(spark, key):
    entries, last = [], None
    for k in range(6):
        last = integrity.append_entry(last, f"t{k}", "me", "act", {"k": k}, key)
        entries.append({"chain": "c", **last})
    names = ["chain", "seq", "at", "actor_id", "action", "payload_hash", "previous_hash", "entry_hash"]

    def verdict(rows, k=key):
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "chain string, seq int, at string, actor_id string, action string, payload_hash string, previous_hash string, entry_hash string")
        return integrity.verified_chain(df, "chain", k).first()

    assert verdict(entries).valid
    assert verdict([dict(e, actor_id="you") if e["seq"] == 3 else e for e in entries]).broken_at_seq == 3
    assert verdict([e for e in entries if e["seq"] != 4]).broken_at_seq == 5
    assert not verdict(entries, "other").valid


def test_numbers_and_codes(spark):
    got = [one(spark, normalize.numeric(F.lit(x))) for x in ("0", "0.0", "1,234", "-85 dBm", "1e3", "x", "1.2.3", None)]
    assert got == [None, 0.0, 1234.0, -85.0, 1000.0, None, 1.2, None]
    assert one(spark, normalize.numeric(F.lit("0"), keep_zero=True)) == 0
    assert [one(spark, normalize.code(F.lit(x), formats.TECHNOLOGIES)) for x in ("volte", "5-g", "zz", None)] == ["IMS", "NR", "UNKNOWN", "UNKNOWN"]


def test_layers(spark):
    assert one(spark, evidence.weakest_of(F.array(F.lit("OBSERVED"), F.lit("ANALYST_ASSERTED")))) == "ANALYST_ASSERTED"
    assert one(spark, evidence.weakest_of(F.array().cast("array<string>"))) == "INFERRED"
    assert [one(spark, evidence.confidence(F.lit(x))).band for x in (2.0, 0.5, -1.0)] == ["HIGH", "MODERATE", "LOW"]
    ref = F.array(F.struct(F.lit("f").alias("source_file_id"), F.lit(3).alias("row")))
    assert one(spark, evidence.assertion("OBSERVED", F.lit(1), ref)).layer == "OBSERVED"
    with pytest.raises(Exception, match="observation"):
        one(spark, evidence.assertion("OBSERVED", F.lit(1), F.array().cast("array<struct<source_file_id:string,row:int>>")))
    with pytest.raises(Exception, match="method"):
        one(spark, evidence.assertion("CALCULATED", F.lit(1), ref))


def test_references_and_chains(spark):
    ref = evidence.reference(case_id=F.lit("c"), source_file_id=F.lit("f"), container=F.lit("b.xlsx"), sheet=F.lit("s"), row=F.lit(7), column=F.lit("IMEI"), row_hash=F.lit("h"), record_id=F.lit("r"), transform_id=F.lit("t"), finding_id=F.lit("x"))
    assert one(spark, evidence.provenance_key(ref)) == "c||f|b.xlsx|s|7|IMEI|r||x"
    nodes = one(spark, evidence.chain(ref, {"CASE": F.lit("The case")}))
    assert [(n.stage, n.id) for n in nodes] == [("CASE", "c"), ("SOURCE_FILE", "f"), ("TABLE", "s"), ("SOURCE_ROW", "row:7"), ("NORMALIZED_RECORD", "r"), ("TRANSFORMATION", "t"), ("FINDING", "x")]
    assert nodes[0].label == "The case" and nodes[2].detail == {"container": "b.xlsx"} and nodes[3].detail == {"row": "7", "column": "IMEI", "rowHash": "h"} and nodes[3].label == "Row 7"
    narrow = one(spark, evidence.source_row(ref))
    assert (narrow.record_id, narrow.row_hash, narrow.column) == ("r", "h", "IMEI") and narrow.transform_id is None and narrow.finding_id is None
    with pytest.raises(ValueError):
        evidence.reference(nothing=F.lit(1))


def test_explanations(spark):
    refs = F.array(evidence.reference(case_id=F.lit("c"), row=F.lit(1)), evidence.reference(case_id=F.lit("c"), row=F.lit(2)))
    below = evidence.reason("CALCULATED", F.lit("two"), refs, {"metres": F.lit(5)})
    told = evidence.explanation(F.lit("why"), (evidence.reason("OBSERVED", F.lit("one"), refs, children=(below,)),), F.lit("m@1"), (F.lit("mind"),), (evidence.reason("INFERRED", F.lit("not"), refs),))
    table = evidence.nodes(spark.range(1), "id", told)
    assert evidence.rendered(table).first().text.split("\n") == [
        "why", "  • (OBSERVED) one [2 source record(s)]", "    • (CALCULATED) two [2 source record(s)]", "  Evidence against:", "    • (INFERRED) not [2 source record(s)]", "  Caveats:", "    • mind",
    ]
    assert [r.reference.row for r in evidence.explanation_provenance(table).collect()] == [1, 2] * 3
    assert table.filter("section = 'SUMMARY'").first().method == "m@1" and table.filter("statement = 'two'").first().quantities == {"metres": "5"}
    with pytest.raises(ValueError):
        evidence.reason("NOBODY", F.lit("x"))


def test_manifest_ignores_order_and_sees_changes(spark):
    rows = [(f"f{k}", f"h{k}") for k in range(50)]
    hash_of = lambda r: integrity.manifests(spark.createDataFrame([("p", *x) for x in r], "p string, f string, h string").repartition(3), "p", F.col("f"), F.col("h")).first().manifest
    assert hash_of(rows) == hash_of(rows[::-1]) != hash_of(rows[:-1])
    assert hash_of([("f0", "h1"), ("f1", "h0")]) != hash_of([("f0", "h0"), ("f1", "h1")])


def test_chains_stream(spark):
    """Hashes of the streamed fold are those of entries appended one by one."""
    entries, last = [], None
    for k in range(5):
        last = integrity.append_entry(last, f"t{k}", "me", "act", {"k": k}, "key")
        entries.append(last)
    rows = [(c, e["seq"], e["at"], e["actor_id"], e["action"], e["payload_hash"]) for c in ("a", "b") for e in entries]
    df = spark.createDataFrame(rows, "chain string, seq int, at string, actor_id string, action string, payload_hash string").repartition(4)
    found = integrity.chained(df, "chain", "key").orderBy("chain", "seq").collect()
    assert [r.entry_hash for r in found] == [e["entry_hash"] for e in entries] * 2
    verdict = integrity.verified_chain(integrity.chained(df, "chain", "key"), "chain", "key").collect()
    assert all(v.valid and v.message == "all 5 entries hold" for v in verdict)


def test_histories_in_pieces(spark):
    """The row before, and the last version, across pieces of a history; null keys and instants included."""
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [(k, rng.choice([1, 1, 1, 2, None]), t0 + timedelta(hours=rng.randint(0, 900)) if k % 17 else None, rng.choice([None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, device long, t timestamp, v long")
    day = F.floor(F.col("t").cast("double") / 86_400)
    first = lambda x: (x is not None, x or t0)
    before, last = {}, {}
    for device in (1, 2, None):
        seen, value = None, None
        for e, _, t, v in sorted((r for r in rows if r[1] == device), key=lambda r: (first(r[2]), r[0])):
            value = value if v is None else v
            before[e], last[e], seen = seen, value, e
    assert {r.event_id: r.b.event_id if r.b else None for r in ordered.with_before(df, "device", ["t", "event_id"], day, ["event_id"], "b").collect()} == before
    assert {r.event_id: r.w for r in ordered.with_last(df, "device", ["t", "event_id"], day, "v", "w").collect()} == last


def test_windows_of_every_length(spark):
    t0 = datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, t0 + timedelta(hours=k * 7)) for k in range(300)], "event_id long, ts_utc timestamp")
    spans = [(0, t0, t0), (1, t0, t0 + timedelta(minutes=1)), (2, t0 + timedelta(days=3), t0 + timedelta(days=40)), (3, t0 - timedelta(days=900), t0 + timedelta(days=900)), (4, t0 + timedelta(days=2), t0)]
    windows = spark.createDataFrame(spans, "w long, start timestamp, end timestamp")
    found = Counter(r.w for r in correlate.in_windows(events, windows).collect())
    assert found == {w: n for w, a, b in spans if (n := sum(a <= t0 + timedelta(hours=k * 7) <= b for k in range(300)))}


@pytest.mark.parametrize("lat", [0.0, 60.0, -89.99])
def test_near_in_cells(spark, lat):
    points = [(k, lat + (k % 7) * 0.004, -179.99 + (k % 11) * 0.02 / max(math.cos(math.radians(lat)), 0.01)) for k in range(77)]
    a = spark.createDataFrame(points, "k long, lat double, lon double")
    b = spark.createDataFrame(points, "k2 long, lat2 double, lon2 double")
    found = {(r.k, r.k2) for r in correlate.near(a, b, 1500.0).select("k", "k2").collect()}
    box = a.crossJoin(b).filter(geodesy.box_holds(geodesy.box_around(F.col("lat"), F.col("lon"), F.lit(1500.0)), F.col("lat2"), F.col("lon2")))
    due = {(r.k, r.k2) for r in box.filter(geodesy.distance_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 1500).select("k", "k2").collect()}
    assert found == due and len(due) > 77


def test_methods():
    m = evidence.Methods()
    m.register({"id": "a", "version": "1.2"})
    m.register({"id": "a", "version": "1.10"})
    m.register({"id": "a", "version": "1.2"})
    assert m.latest("a")["version"] == "1.10"
    with pytest.raises(ValueError):
        m.register({"id": "a", "version": "1.2", "title": "other"})


def test_registry():
    r = formats.Registry()
    with pytest.raises(ValueError):
        r.register(formats.BUILT_IN[0])
    assert [f.id for f in r.for_carrier("ATT")] == ["att.tower-dump", "att.cell-site-list"]
    with pytest.raises(ValueError):
        formats.from_mapping({"msisdn": "x"}, "i", "C", "TOWER_DUMP", ",")


def test_routes():
    def c(x):
        return detect.Candidate(formats.BUILT_IN[0], x, {}, [])

    assert [detect.route(x) for x in ([], [c(0.95)], [c(0.95), c(0.9)], [c(0.8)])] == ["NEEDS_MAPPING", "AUTO", "NEEDS_CONFIRMATION", "NEEDS_CONFIRMATION"]


def test_hints():
    assert profile.matches("lat", "Platform") and profile.matches("timestamp", "Event_DTM") and not profile.matches("imsi", "IMEI")


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="0123456789", min_size=14, max_size=14))
def test_luhn_digit(spark, body):
    total = sum(sum(divmod(int(d) * (2 if k % 2 else 1), 10)) for k, d in enumerate(body))
    assert one(spark, ids.luhn_digit(F.lit(body))) == str(-total % 10)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders, events and suppliers of which few have ids that are multiples of 5, 10 or 50."""
    path, day = str(tmp_path_factory.mktemp("small")), datetime(2024, 1, 1)
    orders = [(k, k % 23 + 57, day, "1-URGENT") for k in range(1, 121)]
    events = [(k, day + timedelta(minutes=k * 11), k % 7, "call") for k in range(1, 201)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(k,) for k in range(1, 60)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    return path, orders, events


def test_windows_around_every_order(spark, small):
    path, orders, events = small
    due = {}
    for k, *_ in orders:
        at = datetime(2024, 1, 1) + timedelta(minutes=k * 37 % 44640)
        if held := [e for e, ts, *_ in events if at - timedelta(minutes=15) <= ts <= at + timedelta(minutes=5)]:
            due[k] = (len(held), min(held))
    assert {r.o_orderkey: (r.n, r.first_event) for r in engine.window_around_join(spark, path).collect()} == due
    assert any(k % 50 for k in due)


def test_chains_of_every_customer(spark, small):
    path, orders, _ = small
    sizes = Counter(c for _, c, *_ in orders)
    due = {c: (c % 70 != 0 or n < 2, n, 2 if c % 70 == 0 and n >= 2 else None) for c, n in sizes.items()}
    assert {r.chain: (r.valid, r.checked, r.broken_at_seq) for r in engine.audit_chain_verify(spark, path).collect()} == due
    assert not due[70][0] and any(c % 10 for c in due)


def test_every_event_near_suppliers(spark, small):
    path, _, events = small

    def metres(lat, lon, lat2, lon2):
        a, b, d = (math.radians(x) for x in (lat, lat2, lon2 - lon))
        return 2 * geodesy.EARTH_RADIUS_M * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2))

    due = {}
    for k in range(1, 60):
        each = [metres(39 + u % 40 * 0.01, -105 + e % 37 * 0.01, 39 + k % 50 * 0.009, -105 + k % 43 * 0.009) for e, _, u, _ in events]
        if held := [d for d in each if d <= 900]:
            due[k] = (len(held), pytest.approx(min(held), abs=0.02))
    assert {r.s_suppkey: (r.n, r.nearest_m) for r in engine.bbox_join(spark, path).collect()} == due
