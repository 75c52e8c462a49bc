"""Device and subscriber identifiers as Column functions, all of them built-in ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming takes off: every white space that text files carry.
WHITE = " \t\n\r\f\v ﻿"

# Texts that mean "no value".
NULL_TOKENS = (
    "", "0", "N/A", "NA", "NULL", "NONE", "UNKNOWN", "UNAVAILABLE", "NOT AVAILABLE",
    "NOT PROVIDED", "-", "--", "RESTRICTED", "PRIVATE", "WITHHELD", "ANONYMOUS", "BLOCKED",
)
# Operators by mobile country and network code.
OPERATORS = {
    "310030": "AT&T", "310070": "AT&T", "310150": "AT&T", "310170": "AT&T", "310280": "AT&T",
    "310380": "AT&T", "310410": "AT&T", "310560": "AT&T", "311180": "AT&T",
    "310004": "Verizon", "310005": "Verizon", "310012": "Verizon", "311480": "Verizon", "310590": "Verizon",
    "310890": "Verizon",
    "310160": "T-Mobile", "310200": "T-Mobile", "310210": "T-Mobile", "310220": "T-Mobile", "310230": "T-Mobile",
    "310240": "T-Mobile", "310250": "T-Mobile", "310260": "T-Mobile", "310270": "T-Mobile", "310310": "T-Mobile",
    "310490": "T-Mobile", "310660": "T-Mobile", "310800": "T-Mobile", "311882": "T-Mobile",
    "310120": "Sprint (T-Mobile)", "312530": "Sprint (T-Mobile)",
    "311870": "Boost",
    "310730": "UScellular", "311220": "UScellular", "310320": "UScellular",
}
# Identifier types and how strong a match on each is.
STRENGTH = {
    "IMEI": 5, "IMSI": 4, "ICCID": 4, "MEID": 4, "ESN": 3, "MSISDN": 3,
    "CARRIER_SUBSCRIBER_ID": 2, "CARRIER_DEVICE_ID": 2, "SIP_URI": 2, "IP_ADDRESS": 1,
}
#: What a match on each type says.
MEANING = {
    "IMEI": "one handset, whatever SIM is in it; the number can be forged",
    "IMSI": "one subscription; it goes with its SIM from handset to handset",
    "ICCID": "one SIM card",
    "MEID": "one CDMA handset",
    "ESN": "one older CDMA handset",
    "MSISDN": "a number that can be called; it can be ported to another SIM and later given to someone else",
    "CARRIER_SUBSCRIBER_ID": "the carrier's own key of a subscriber, as that carrier uses it",
    "CARRIER_DEVICE_ID": "the carrier's own key of a device, as that carrier uses it",
    "SIP_URI": "an IMS session",
    "IP_ADDRESS": "a network address that many may share and that is soon given to others; weak by itself",
}
# Event columns that correlate records, the preferred first, with their types.
CORRELATION = (
    ("imei", "IMEI"), ("imsi", "IMSI"), ("iccid", "ICCID"), ("meid", "MEID"), ("esn", "ESN"),
    ("msisdn", "MSISDN"), ("carrier_subscriber_id", "CARRIER_SUBSCRIBER_ID"), ("carrier_device_id", "CARRIER_DEVICE_ID"),
)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def quoted(text: str) -> str:
    """A text as a literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """Whether a text is one of a few; as a constant of one call, the plan is built sooner than with a literal each."""
    return F.array_contains(F.expr(f"array({', '.join(map(quoted, values))})"), c)


def once(c: Column) -> Column:
    """The same value, computed where it stands: the optimizer neither copies nor moves what names the partition's number.

    Without it, filters and extracted fields pull whole ladders of conditions into
    themselves, once for each place that reads them.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def is_null_token(c: Column) -> Column:
    """Whether a source value stands for no value."""
    return c.isNull() | one_of(F.upper(trimmed(c)), NULL_TOKENS)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a key in a small table of the plan, null if there is none."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(table[k])}" for k in sorted(table))
    return F.try_element_at(F.expr(f"map({pairs})"), c)


def operator(prefix: Column) -> Column:
    """The operator of a country and network code."""
    return lookup(prefix, OPERATORS)


def _issues(*each: tuple[Column, Column | str]) -> Column:
    """Texts of the conditions that hold, in order."""
    texts = [F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in each]
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


#: What every identifier is.
SCHEMA = "struct<type:string,raw:string,normalized:string,valid:boolean,issues:array<string>,derived:map<string,string>>"


def _identifier(kind: str, raw: Column, normalized: Column, valid: Column, issues: Column, derived: Column | None) -> Column:
    absent = is_null_token(raw)
    text = "map<string,string>"
    derived = F.lit(None) if derived is None else derived
    return F.when(
        raw.isNotNull(),
        F.struct(
            F.lit(kind).alias("type"),
            trimmed(raw).alias("raw"),
            F.when(~absent, normalized).alias("normalized"),
            (~absent & F.coalesce(valid, F.lit(False))).alias("valid"),
            F.when(absent, F.array(F.lit("placeholder, no value"))).otherwise(issues).alias("issues"),
            F.when(~absent, derived).cast(text).alias("derived"),
        ),
    )


def _derived(**values: Column) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def is_nanp(ten: Column) -> Column:
    """Whether ten digits satisfy the North American numbering rules."""
    return ten.rlike("^[2-9][0-8][0-9][2-9][0-9]{6}$")


def msisdn(raw: Column, country: str = "1", detail: bool = True) -> Column:
    """A telephone number: short codes stay, the rest goes to the international form where that is certain; parts only with ``detail``."""
    text, bare = trimmed(raw), digits(raw)
    plus = text.startswith("+")
    short = ~plus & F.length(bare).between(3, 6)
    dialled = ~plus & bare.startswith("011") & (F.length(bare) > 12)
    body = F.when(dialled, F.substring(bare, 4, 64)).otherwise(bare)
    size = F.length(body)
    abroad = plus | dialled
    ten = ~abroad & (size == 10)
    eleven = ~abroad & (size == 11) & body.startswith("1")
    other = ~abroad & ~ten & ~eleven & size.between(8, 15)
    local = F.when(ten, body).when(eleven, F.substring(body, 2, 10))
    normalized = (
        F.when(short, bare)
        .when(size == 0, None)
        .when(abroad | eleven, F.concat(F.lit("+"), body))
        .when(ten, F.concat(F.lit(f"+{country}"), body))
        .when(other, body)
    )
    kind = F.when(short, "SHORT_CODE").when(size == 0, None).when(abroad, "INTERNATIONAL").when(ten | eleven, "NANP")
    counted = size.cast("string")
    issues = F.when(short, F.array().cast("array<string>")).otherwise(
        _issues(
            (dialled, "international prefix 011 taken off"),
            (size == 0, "no digits"),
            (abroad & (size > 0) & ~size.between(8, 15), F.concat(F.lit("international number of "), counted, F.lit(" digits, not 8 to 15"))),
            ((eleven | (ten if country == "1" else F.lit(False))) & ~is_nanp(local), "breaks the North American numbering rules"),
            (ten, f"country code +{country} was assumed"),
            (other, F.concat(counted, F.lit(" digits without a country code, kept as they are"))),
            ((size > 0) & normalized.isNull(), F.concat(counted, F.lit(" digits are no telephone number"))),
        )
    )
    valid = short | (abroad & ~dialled & size.between(8, 15)) | ten | eleven
    derived = _derived(kind=kind, npa=F.when(~short, F.substring(local, 1, 3)), nxx=F.when(~short, F.substring(local, 4, 3)))
    return _identifier("MSISDN", raw, normalized, valid, issues, derived if detail else None)


def imsi(raw: Column, detail: bool = True) -> Column:
    """A subscriber identity, taken apart into country, network and subscriber."""
    body = digits(raw)
    size = F.length(body)
    usable = size >= 6
    mcc = F.substring(body, 1, 3)
    american = mcc.between("310", "316")
    width = F.when(american, F.lit(3)).otherwise(F.lit(2))
    mnc = F.substring(body, F.lit(4), width)
    prefix = F.concat(mcc, mnc)
    known = operator(prefix)
    issues = _issues(
        (~usable, F.concat(F.lit("only "), size.cast("string"), F.lit(" digits"))),
        (usable & (size != 15), F.concat(size.cast("string"), F.lit(" digits, not 15"))),
        (usable & american & known.isNull(), F.concat(F.lit("unknown North American network "), prefix)),
    )
    derived = F.when(usable, _derived(mcc=mcc, mnc=mnc, msin=F.substring(body, F.lit(4) + width, F.lit(64)), operator=known))
    return _identifier("IMSI", raw, F.when(usable, body), (size == 15) & ~(american & known.isNull()), issues, derived if detail else None)


def luhn_digit(body: Column) -> Column:
    """The check digit that makes fourteen digits pass the Luhn test."""
    total = reduce(
        lambda a, b: a + b,
        [
            (lambda d: F.when(d >= 10, d - 9).otherwise(d))(F.substring(body, k, 1).try_cast("int") * (2 if k % 2 == 0 else 1))
            for k in range(1, 15)
        ],
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def imei(raw: Column, detail: bool = True) -> Column:
    """A handset identity: the fourteen digits that identify it, whatever follows them."""
    all_ = digits(raw)
    size = F.length(all_)
    body = F.when(size.between(14, 16), F.left(all_, F.lit(14)))
    check = F.when(size == 15, F.substring(all_, 15, 1))
    expected = luhn_digit(body)
    failed = (size == 15) & (check != expected)
    repeated = F.translate(body, "0123456789", "0000000000").isNotNull() & (F.replace(body, F.left(body, F.lit(1)), F.lit("")) == "")
    issues = _issues(
        (body.isNull(), F.concat(size.cast("string"), F.lit(" digits, not 14 to 16"))),
        (failed, F.concat(F.lit("check digit "), check, F.lit(" where "), expected, F.lit(" is due"))),
        (F.coalesce(repeated, F.lit(False)), "one digit repeated, a placeholder"),
    )
    form = F.when(size == 15, "IMEI").when(size == 16, "IMEISV").when(size == 14, "IMEI_NO_CHECK_DIGIT")
    derived = F.when(
        body.isNotNull(),
        _derived(form=form, tac=F.left(body, F.lit(8)), serial=F.substring(body, 9, 6), checkDigit=check, softwareVersion=F.when(size == 16, F.substring(all_, 15, 2))),
    )
    valid = body.isNotNull() & ~F.coalesce(failed, F.lit(False)) & ~F.coalesce(repeated, F.lit(False))
    return _identifier("IMEI", raw, body, valid, issues, derived if detail else None)


def iccid(raw: Column, detail: bool = True) -> Column:
    """A SIM card's serial number."""
    body = digits(raw)
    size = F.length(body)
    issues = _issues(
        (~size.between(18, 22), F.concat(size.cast("string"), F.lit(" digits, not 18 to 22"))),
        (~body.startswith("89"), "does not begin with 89"),
    )
    derived = _derived(mii=F.left(body, F.lit(2)), countryCode=F.substring(body, 3, 3))
    return _identifier("ICCID", raw, body, size.between(18, 22) & body.startswith("89"), issues, derived if detail else None)


def esn_meid(raw: Column, kind: str = "MEID") -> Column:
    """A hexadecimal handset number, cut to its length."""
    size = 14 if kind == "MEID" else 8
    body = F.upper(F.regexp_replace(raw, "[^0-9A-Fa-f]", ""))
    valid = F.length(body).isin(size, size + 1)
    issues = _issues((~valid, F.concat(F.length(body).cast("string"), F.lit(f" hexadecimal digits, not {size}"))))
    return _identifier(kind, raw, F.left(body, F.lit(size)), valid, issues, None)


def opaque(raw: Column, kind: str) -> Column:
    """An identifier without a structure of its own."""
    none = F.array().cast("array<string>")
    return _identifier(kind, raw, F.upper(trimmed(raw)), F.lit(True), none, None)


def normalized(raw: Column, kind: str, country: str = "1", detail: bool = True) -> Column:
    """The identifier of a declared type."""
    if kind == "MSISDN":
        return msisdn(raw, country, detail)
    if kind in ("ESN", "MEID"):
        return esn_meid(raw, kind)
    found = {"IMSI": imsi, "IMEI": imei, "ICCID": iccid}.get(kind)
    return found(raw, detail) if found else opaque(raw, kind)


def inferred(raw: Column) -> Column:
    """struct(type, confidence, rationale) that a bare value looks like, null if none: a suggestion for review, never a decision."""
    text, d = trimmed(raw), digits(raw)
    size, prefix = F.length(d), F.left(d, F.lit(6))
    name = operator(prefix)
    known = name.isNotNull()
    luhn = F.substring(d, 15, 1) == luhn_digit(F.left(d, F.lit(14)))
    country = F.left(d, F.lit(3)).try_cast("int").between(200, 750)

    def is_(kind: str, confidence: float, *why: Column | str) -> Column:
        said = F.concat(*[F.lit(w) if isinstance(w, str) else w for w in why])
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), said.alias("rationale"))

    address = text.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | text.rlike("^[0-9a-fA-F:]{6,39}$")
    return (
        F.when(is_null_token(raw), None)
        .when((size == 15) & known & ~luhn, is_("IMSI", 0.9, "15 digits that begin with a network of ", name, " (", prefix, ")"))
        .when((size == 15) & known, is_("IMSI", 0.6, "15 digits that begin with a network of ", name, " (", prefix, "), but they pass a handset's check as well; see the column's header"))
        .when((size == 15) & luhn, is_("IMEI", 0.85, "15 digits that pass a handset's check (type ", F.left(d, F.lit(8)), ") and begin with no known network"))
        .when((size == 15) & country, is_("IMSI", 0.5, "15 digits that begin like a country (", F.left(d, F.lit(3)), ") with no known network, and fail a handset's check"))
        .when(size == 16, is_("IMEI", 0.5, "16 digits, as a handset number with its software version has"))
        .when(size.between(18, 22) & d.startswith("89"), is_("ICCID", 0.8, "18 to 22 digits that begin with 89"))
        .when(text.startswith("+") | (size == 10) | ((size == 11) & d.startswith("1")), is_("MSISDN", 0.75, "written like a telephone number"))
        .when(F.lower(text).startswith("sip:"), is_("SIP_URI", 0.95, "begins with sip:"))
        .when(address, is_("IP_ADDRESS", 0.6, "written like a network address"))
    )


def key(kind: Column, value: Column, raw: Column) -> Column:
    """The typed key that records are joined on."""
    return F.concat(kind, F.lit(":"), F.coalesce(value, raw))


def parsed_key(k: Column) -> Column:
    """struct(type, value) of a key; null if its type is none."""
    kind = F.substring_index(k, ":", 1)
    ok = (F.instr(k, ":") > 0) & kind.isin(*STRENGTH)
    return F.when(ok, F.struct(kind.alias("type"), F.substring(k, F.length(kind) + F.lit(2), F.length(k)).alias("value")))


def masked(value: Column) -> Column:
    """All but the last four characters hidden."""
    return F.concat(F.repeat(F.lit("•"), F.greatest(F.lit(0), F.length(value) - 4)), F.right(value, F.lit(4)))


def strength(kind: Column) -> Column:
    return lookup(kind, {k: str(v) for k, v in STRENGTH.items()}).cast("int")


def meaning(kind: Column) -> Column:
    """What a match on a type says, in words."""
    return lookup(kind, MEANING)


def event_keys(columns: list[str]) -> Column:
    """All typed keys of an event that has some of the correlating columns, the preferred first."""
    present = [F.concat(F.lit(f"{kind}:"), F.col(c)) for c, kind in CORRELATION if c in columns]
    return F.filter(F.array(*present), lambda k: k.isNotNull())
