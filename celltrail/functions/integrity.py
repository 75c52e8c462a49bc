"""Hashes, record ids, manifests and audit chains; the byte layouts are this engine's own.

Parts are joined by the unit separator, and an absent part is a character that no
text of a source file holds, so that parts can neither shift nor vanish.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import with_before

SEPARATOR, ABSENT = "\u001f", "\u0000"
GENESIS = "0" * 64
#: Entries of a chain that one task tests.
ENTRIES = 100_000


def row_hash(raw: Column) -> Column:
    """The hash of a source row, every byte of it."""
    return F.sha2(raw, 256)


def joined(*parts: Column) -> Column:
    return F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit(ABSENT)) for p in parts])


def record_id(*parts: Column) -> Column:
    """An id that the same parts in the same places always give."""
    return F.sha2(joined(*parts), 256)


def file_hashes(df: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of a ``binaryFile`` scan."""
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def manifests(df: DataFrame, package: str, file: Column, sha256: Column) -> DataFrame:
    """(package, manifest): one hash of a package's files in whatever order.

    Files are dealt by the first four digits of their line's hash; each such part is hashed over
    its sorted lines, and the manifest over the parts' hashes in order. So no task holds
    a package: a part has one of 65,536 parts of the files, and a package that many hashes.
    """
    line = joined(file, sha256)
    lines = df.select(package, line.alias("_line"), F.left(F.sha2(line, 256), F.lit(4)).alias("_part"))
    parts = lines.groupBy(package, "_part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), 256).alias("_hash"))
    each = F.struct("_part", "_hash")
    held = parts.groupBy(package).agg(F.array_sort(F.collect_list(each)).alias("_parts"))
    return held.select(package, F.sha2(F.array_join(F.transform("_parts", lambda p: F.concat(p["_part"], F.lit("="), p["_hash"])), "\n"), 256).alias("manifest"))


def output_digest(order: Column, value: Column) -> Column:
    """Aggregate: one hash of values in their order."""
    held = F.array_sort(F.collect_list(F.struct(order.alias("at"), value.cast("string").alias("value"))))
    return F.sha2(F.array_join(F.transform(held, lambda h: h["value"]), "\n"), 256)


def canonical_map_json(m: Column) -> Column:
    """JSON of a map with its keys in order; keys without a value go."""
    kept = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(kept)))


def canonical_json(value: object) -> str:
    """JSON with keys in order at every depth, absent values left out; a cycle is an error."""

    def clean(x: object, above: tuple[int, ...]) -> object:
        if isinstance(x, (dict, list, tuple)):
            if id(x) in above:
                raise ValueError("a value holds itself")
            above = (*above, id(x))
        if isinstance(x, dict):
            return {str(k): clean(v, above) for k, v in x.items() if v is not None}
        return [clean(v, above) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value, ()), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def keyed_hash(message: Column, key: str | None) -> Column:
    """SHA-256 of a text, or its HMAC under a key, from built-in functions."""
    if key is None:
        return F.sha2(message, 256)
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = block.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _message(seq: object, at: object, actor: object, action: object, payload_hash: object, previous: object) -> str:
    return SEPARATOR.join(ABSENT if p is None else str(p) for p in (seq, at, actor, action, payload_hash, previous))


def append_entry(previous: dict | None, at: str, actor: str, action: str, payload: object, key: str | None = None) -> dict:
    """The next entry of a chain."""
    entry = {"seq": previous["seq"] + 1 if previous else 1, "at": at, "actor_id": actor, "action": action}
    entry["payload_hash"] = hashlib.sha256(canonical_json(payload).encode()).hexdigest()
    entry["previous_hash"] = previous["entry_hash"] if previous else GENESIS
    message = _message(*entry.values()).encode()
    entry["entry_hash"] = hmac.new(key.encode(), message, "sha256").hexdigest() if key else hashlib.sha256(message).hexdigest()
    return entry


def chained(df: DataFrame, chain: str, key: str | None = None) -> DataFrame:
    """Rows (chain, seq, at, actor_id, action, payload_hash) with the hashes of their chain.

    An entry needs the one before, so a chain is one task's work; entries stream
    through it in order, and one hash is all that is held.
    """
    fields = ("seq", "at", "actor_id", "action", "payload_hash")
    rows = df.select(chain, *fields)
    more = T.StructType([*rows.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    secret = key.encode() if key is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            whose = batch.column(0).to_pylist()
            for own, *entry in zip(whose, *(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if own != now or now is None:
                    now, last = own, GENESIS
                before.append(last)
                message = _message(*entry, last).encode()
                last = hmac.new(secret, message, "sha256").hexdigest() if secret is not None else hashlib.sha256(message).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "previous_hash", "entry_hash"])

    return rows.repartition(chain).sortWithinPartitions(chain, *fields).mapInArrow(run, more)


def verified_chain(df: DataFrame, chain: str, key: str | None = None) -> DataFrame:
    """(chain, valid, checked, broken_at_seq, message) of each chain; all entries are tested at once, each against the one before."""
    held = with_before(df, chain, ["seq"], F.floor(F.col("seq") / ENTRIES), ["seq", "entry_hash"])
    due = keyed_hash(joined(*[F.col(f) for f in ("seq", "at", "actor_id", "action", "payload_hash", "previous_hash")]), key)
    before = F.coalesce("_before.entry_hash", F.lit(GENESIS))
    ok = (F.col("entry_hash") == due) & (F.col("previous_hash") == before) & (F.col("seq") == F.coalesce(F.col("_before.seq") + 1, F.lit(1)))
    tested = held.withColumn("_bad", F.when(~F.coalesce(ok, F.lit(False)), F.col("seq")))
    return tested.groupBy(chain).agg(
        F.count("_bad").alias("n"), F.count("*").alias("checked"), F.min("_bad").alias("broken_at_seq")
    ).select(chain, (F.col("n") == 0).alias("valid"), "checked", "broken_at_seq", _verdict().alias("message"))


def _verdict() -> Column:
    count, at = F.col("checked").cast("string"), F.col("broken_at_seq").cast("string")
    return F.when(F.col("n") == 0, F.concat(F.lit("all "), count, F.lit(" entries hold"))).otherwise(
        F.concat(F.lit("entry "), at, F.lit(" does not follow from the one before: it or its place was changed"))
    )
