"""Evidence layers, provenance, explanations and the methods that make assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import lookup

# Layers, how strong they are, and how reports call them.
STRENGTH = {"OBSERVED": 3, "CALCULATED": 2, "ANALYST_ASSERTED": 1, "INFERRED": 0}
LABELS = {"OBSERVED": "Carrier supplied", "CALCULATED": "Calculated", "INFERRED": "System inferred", "ANALYST_ASSERTED": "Analyst entered"}
STAGES = ("CASE", "EVIDENCE_PACKAGE", "SOURCE_FILE", "TABLE", "SOURCE_ROW", "NORMALIZED_RECORD", "TRANSFORMATION", "ANALYSIS", "FINDING")
#: What a reference may name, from the case to the finding.
FIELDS = {
    "case_id": "string", "package_id": "string", "source_file_id": "string", "container": "string", "sheet": "string", "row": "long", "column": "string",
    "byte_offset": "long", "row_hash": "string", "record_id": "string", "transform_id": "string", "analysis_run_id": "string", "finding_id": "string",
}
# The ten parts of a reference's key, in order.
KEY = ("case_id", "package_id", "source_file_id", "container", "sheet", "row", "column", "record_id", "analysis_run_id", "finding_id")
#: What is left of a reference that points at a row and no further.
ROW_FIELDS = ("case_id", "package_id", "source_file_id", "container", "sheet", "row", "column", "byte_offset", "row_hash", "record_id")
#: What tells two references apart when provenance is collected.
IDENTITY = ("case_id", "package_id", "source_file_id", "sheet", "row", "record_id")


def strength(layer: Column) -> Column:
    return lookup(layer, {k: str(v) for k, v in STRENGTH.items()}).cast("int")


def reference(**fields: Column) -> Column:
    """A struct of all :data:`FIELDS`; those that are not given are null."""
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"a reference has no {', '.join(sorted(unknown))}")
    return F.struct(*[(fields[k].cast(t) if k in fields else F.lit(None).cast(t)).alias(k) for k, t in FIELDS.items()])


def assertion(layer: str, value: Column, provenance: Column | None = None, method: Column | None = None, score: Column | None = None, reasons: Column | None = None, author: Column | None = None) -> Column:
    """struct(layer, value, provenance, method, confidence, reasons) with what its layer demands, or an error.

    OBSERVED: a reference at least, each with file and row. CALCULATED: a method and a
    reference. INFERRED: a method, a reference, a score from 0 to 1 and a reason.
    ANALYST_ASSERTED: an author.
    """
    none = F.lit(None)
    has = F.size(provenance) > 0 if provenance is not None else F.lit(False)
    demands = {
        "OBSERVED": (has & F.forall(provenance, lambda p: p["source_file_id"].isNotNull() & p["row"].isNotNull()) if provenance is not None else has, "an observation cites a source row"),
        "CALCULATED": (has & (method.isNotNull() if method is not None else F.lit(False)), "a calculation cites its basis and method"),
        "INFERRED": (
            has & (method.isNotNull() if method is not None else F.lit(False)) & (score.between(0, 1) & ~F.isnan(score) if score is not None else F.lit(False)) & (F.size(reasons) > 0 if reasons is not None else F.lit(False)),
            "an inference cites basis, method, score and reasons",
        ),
        "ANALYST_ASSERTED": (author.isNotNull() if author is not None else F.lit(False), "an analyst's statement names its author"),
    }
    condition, message = demands[layer]
    checked = F.when(F.coalesce(condition, F.lit(False)), F.lit(layer)).otherwise(F.raise_error(F.lit(message)).cast("string"))
    if layer == "ANALYST_ASSERTED" and reasons is None:
        reasons = F.array(F.concat(F.lit("stated by "), author))
    return F.struct(
        checked.alias("layer"), value.alias("value"), (provenance if provenance is not None else none).alias("provenance"), (method if method is not None else none.cast("string")).alias("method"),
        (confidence(score) if score is not None else none).alias("confidence"), (reasons if reasons is not None else none.cast("array<string>")).alias("reasons"),
    )


def weakest(layer: Column) -> Column:
    """Aggregate: the weakest of the layers, INFERRED over none."""
    return F.coalesce(F.min_by(layer, strength(layer)), F.lit("INFERRED"))


def weakest_of(layers: Column) -> Column:
    """The weakest layer of an array."""
    least = F.array_min(F.transform(layers, lambda x: F.struct(strength(x).alias("s"), x.alias("layer"))))
    return F.coalesce(least["layer"], F.lit("INFERRED"))


def is_factual(layer: Column) -> Column:
    return layer == "OBSERVED"


def confidence(score: Column) -> Column:
    """struct(score, band) of a score, cut to 0..1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.struct(s.alias("score"), F.when(s >= 0.75, "HIGH").when(s >= 0.4, "MODERATE").otherwise("LOW").alias("band"))


def collected_provenance(df: DataFrame, group: list[str], refs: str = "provenance") -> DataFrame:
    """The distinct references of each group; of equal ones any."""
    each = df.select(*group, F.explode(refs).alias("_r")).select(*group, "_r.*")
    return each.dropDuplicates([*group, *[c for c in IDENTITY if c in each.columns]])


def chain(ref: Column, labels: dict[str, Column] | None = None) -> Column:
    """Array of struct(stage, id, label, detail) from the case to the finding; stages that a reference does not name are left out.

    ``labels`` name stages in place of their ids. A table's detail is its container; a
    row's are its number, column, byte offset and hash.
    """
    given = labels or {}
    text = lambda k: F.nullif(ref[k].cast("string"), F.lit(""))
    number = ref["row"].cast("string")

    def details(**each: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in each.items()])
        return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))

    ids = {
        "CASE": ref["case_id"].cast("string"), "EVIDENCE_PACKAGE": text("package_id"), "SOURCE_FILE": text("source_file_id"), "TABLE": text("sheet"),
        "SOURCE_ROW": F.concat(F.lit("row:"), number), "NORMALIZED_RECORD": text("record_id"), "TRANSFORMATION": text("transform_id"),
        "ANALYSIS": text("analysis_run_id"), "FINDING": text("finding_id"),
    }
    own = {"SOURCE_ROW": F.concat(F.lit("Row "), number)}
    more = {
        "TABLE": details(container=text("container")),
        "SOURCE_ROW": details(row=number, column=text("column"), byteOffset=ref["byte_offset"].cast("string"), rowHash=text("row_hash")),
    }
    none = F.lit(None).cast("map<string,string>")
    nodes = [
        F.when(
            ids[stage].isNotNull(),
            F.struct(F.lit(stage).alias("stage"), ids[stage].alias("id"), given.get(stage, own.get(stage, ids[stage])).cast("string").alias("label"), more.get(stage, none).alias("detail")),
        )
        for stage in STAGES
    ]
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def provenance_key(ref: Column) -> Column:
    """The ten parts that tell references apart, joined by bars; an absent part is blank."""
    return F.concat_ws("|", *[F.coalesce(ref[c].cast("string"), F.lit("")) for c in KEY])


def source_row(ref: Column) -> Column:
    """A reference to the row and its record, without what was analysed from it."""
    return reference(**{c: ref[c] for c in ROW_FIELDS})


def verified_rows(events: DataFrame, source: DataFrame) -> DataFrame:
    """(event_id, result) of holding events' hashes against re-read rows: VERIFIED, HASH_MISMATCH, SOURCE_UNAVAILABLE or NO_HASH_RECORDED."""
    again = source.select("source_file_id", "row", F.sha2("raw", 256).alias("_hash"), F.lit(True).alias("_there"))
    result = (
        F.when(F.col("row_hash").isNull(), "NO_HASH_RECORDED").when(F.col("_there").isNull(), "SOURCE_UNAVAILABLE")
        .when(F.col("row_hash") == F.col("_hash"), "VERIFIED").otherwise("HASH_MISMATCH")
    )
    return events.join(again, ["source_file_id", "row"], "left").select("event_id", result.alias("result"))


# --- explanations: a table of nodes (explanation_id, section, path, layer, statement, n_refs) ------

SECTIONS = ("SUMMARY", "REASON", "CONTRA", "CAVEAT")
# Words of a rendered explanation.
AGAINST, CAVEATS, CITED = "Evidence against:", "Caveats:", " source record(s)]"
NODE = f"struct<section:string,path:array<int>,layer:string,statement:string,n_refs:int,provenance:array<struct<{','.join(f'{k}:{t}' for k, t in FIELDS.items())}>>,quantities:map<string,string>,method:string>"


def reason(layer: str, statement: Column, provenance: Column | None = None, quantities: dict[str, Column] | None = None, children: tuple[dict, ...] = (), when: Column | None = None) -> dict:
    """A statement of an explanation: its layer, the rows that bear it, its numbers, and statements below it.

    ``when``: where it is not true, the statement and all below it are left out.
    """
    if layer not in STRENGTH:
        raise ValueError(f"{layer} is no layer")
    return {"layer": layer, "statement": statement, "provenance": provenance, "quantities": quantities or {}, "children": tuple(children), "when": when}


def explanation(summary: Column, reasons: tuple[dict, ...], method: Column | None = None, caveats: tuple[Column, ...] = (), contra: tuple[dict, ...] = ()) -> Column:
    """Array of the nodes of an explanation, in the order they are read."""

    def node(section: str, path: list[int], layer: Column, statement: Column, refs: Column | None = None, numbers: dict[str, Column] | None = None, by: Column | None = None) -> Column:
        count = F.coalesce(F.size(refs), F.lit(0)) if refs is not None else F.lit(0)
        pairs = [x for k, v in (numbers or {}).items() for x in (F.lit(k), v.cast("string"))]
        none = F.lit(None)
        return F.struct(
            F.lit(section).alias("section"), F.array(*[F.lit(k) for k in path]).cast("array<int>").alias("path"), layer.alias("layer"), statement.alias("statement"),
            count.alias("n_refs"), (refs if refs is not None else none).alias("provenance"), (F.create_map(*pairs) if pairs else none).alias("quantities"), (by if by is not None else none).alias("method"),
        ).cast(NODE)

    out = [node("SUMMARY", [], F.lit(None).cast("string"), summary, by=method)]

    def walk(section: str, each: tuple[dict, ...], above: list[int], holds: Column | None) -> None:
        for k, r in enumerate(each, 1):
            own = r["when"] if holds is None else holds if r["when"] is None else holds & r["when"]
            made = node(section, [*above, k], F.lit(r["layer"]), r["statement"], r["provenance"], r["quantities"])
            out.append(made if own is None else F.when(own, made))
            walk(section, r["children"], [*above, k], own)

    walk("REASON", reasons, [], None)
    walk("CONTRA", contra, [], None)
    out += [node("CAVEAT", [k], F.lit(None).cast("string"), c) for k, c in enumerate(caveats, 1)]
    return F.filter(F.array(*out), lambda n: n.isNotNull())


def nodes(df: DataFrame, id_: str, told: Column) -> DataFrame:
    """(explanation_id, section, path, layer, statement, n_refs, provenance, quantities, method) of a column of :func:`explanation`."""
    return df.select(F.col(id_).alias("explanation_id"), F.explode(told).alias("_n")).select("explanation_id", "_n.*")


def explanation_provenance(table: DataFrame) -> DataFrame:
    """(explanation_id, section, path, place, reference) of every row cited in reasons and in what speaks against, as often as it is cited."""
    cited = table.filter(F.col("section").isin("REASON", "CONTRA"))
    return cited.select("explanation_id", "section", "path", F.posexplode("provenance").alias("place", "reference"))


def rendered(table: DataFrame) -> DataFrame:
    """(explanation_id, text): the summary, reasons with their children below them, what speaks against, and caveats."""
    depth = F.size("path")
    cited = F.when(F.col("n_refs") > 0, F.concat(F.lit(" ["), F.col("n_refs").cast("string"), F.lit(CITED))).otherwise(F.lit(""))
    point = F.concat(F.lit("• ("), F.col("layer"), F.lit(") "), F.col("statement"), cited)
    indent = lambda extra: F.repeat(F.lit(" "), F.lit(2) * (depth + extra))
    line = (
        F.when(F.col("section") == "SUMMARY", F.col("statement")).when(F.col("section") == "REASON", F.concat(indent(0), point))
        .when(F.col("section") == "CONTRA", F.concat(indent(1), point)).otherwise(F.concat(F.lit("    • "), F.col("statement")))
    )
    order = F.coalesce(*[F.when(F.col("section") == s, F.lit(k)) for k, s in enumerate(SECTIONS)])
    lines = table.select("explanation_id", F.struct(order.alias("s"), "path", line.alias("line")).alias("l"))
    heads = table.filter(F.col("section").isin("CONTRA", "CAVEAT")).select("explanation_id", "section").distinct()
    head = F.when(F.col("section") == "CONTRA", f"  {AGAINST}").otherwise(f"  {CAVEATS}")
    at = F.when(F.col("section") == "CONTRA", F.lit(2)).otherwise(F.lit(3))
    heads = heads.select("explanation_id", F.struct(at.alias("s"), F.array().cast("array<int>").alias("path"), head.alias("line")).alias("l"))
    held = lines.union(heads).groupBy("explanation_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return held.select("explanation_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


# --- methods --------------------------------------------------------------------------------------


class Methods:
    """Versioned methods; the same again is fine, another under the same name is not."""

    def __init__(self):
        self._held: dict[tuple[str, str], dict] = {}

    def register(self, method: dict) -> None:
        key = (method["id"], method["version"])
        if self._held.get(key, method) != method:
            raise ValueError(f"{key[0]}@{key[1]} is registered as something else")
        self._held[key] = method

    def get(self, id_: str, version: str) -> dict | None:
        return self._held.get((id_, version))

    def list(self) -> list[dict]:
        return [self._held[k] for k in sorted(self._held)]

    def latest(self, id_: str) -> dict | None:
        own = [m for (i, _), m in self._held.items() if i == id_]
        return max(own, key=lambda m: [int(x) for x in m["version"].split(".")], default=None)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m["id"], m["version"], m.get("title", ""), m.get("layer", "CALCULATED")) for m in self.list()], "id string, version string, title string, layer string")


def version_key(version: Column, width: int = 4) -> Column:
    """Numbers of a dotted version, missing ones as 0: what versions are compared by."""
    parts = F.split(version, r"\.")
    return F.array(*[F.coalesce(F.get(parts, k).try_cast("int"), F.lit(0)) for k in range(width)])


def latest(methods: DataFrame) -> DataFrame:
    """The highest version of each method."""
    return methods.groupBy("id").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))
