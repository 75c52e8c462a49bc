"""Language identification by compression with one raw-content dictionary per language.

A whole text, in lower case and with a blank for all that is no letter, is coded with
each language's zstandard dictionary, at one level and in blocks of a few kB, so that the
text itself never outgrows the dictionary; the language of the smallest code wins. A
narrow margin between the two smallest codes is a rejection.

The dictionaries are all that is learned: for each language a bounded sample of the
labelled rows (:data:`DICTIONARY_BYTES`), chosen by a hash of id and text, equal rows
once, and of each a piece of :data:`SAMPLE_CHARS` characters from a hashed place in
the text. Prediction runs over every row and every whole text, however long.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0 and
rejected; equal codes go to the language with more labelled rows, then to the
first name, and are rejected; with no labelled row every text is ``und``. Rows
with a null id or label are predicted like others, repeated rows alike; other columns
take no part, but one of the name that is added gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import column, crc_bucket, others, prepare, table, unused

#: Bounds of what is learned, for each language: bytes of dictionary, and of the rows read for it.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 1 << 16, 400, 1000
BLOCK, LEVEL = 4096, 9
#: The least margin, as a share of the second smallest code, that is not a rejection.
MARGIN = 0.002
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """The text's words in lower case, without ASCII characters that are no letters."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split())


def vocabulary(text: str) -> bytes:
    """The text's distinct words in the order they first come: a dictionary has room for more languages' words that way."""
    return b" ".join(dict.fromkeys(plain(text).split(b" ")))


@dataclass
class Languages:
    """The learned dictionaries, the more frequent language first."""

    names: list[str]
    contents: list[bytes]
    _coders: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"names": self.names, "contents": self.contents, "_coders": []}

    def _made(self) -> list:
        import zstandard

        if not self._coders:
            for content in self.contents:
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=LEVEL)
                self._coders.append(
                    zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
                )
        return self._coders

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text's code with each dictionary."""
        data = plain(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
        return [sum(len(c.compress(b)) for b in blocks) for c in self._made()]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / max(second, 1)
        return self.names[best], margin / (margin + 0.02), margin < MARGIN


def sampled(rows: DataFrame, distinct: dict[str, int]) -> DataFrame:
    """(lang, h, text): about ``2 * SAMPLE_ROWS`` of each language's ``distinct`` different rows (lang, text, h), each once, and a piece of each."""
    near = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int((1 << 62) * min(1.0, 2 * SAMPLE_ROWS / max(n, 1))))) for x, n in distinct.items()])
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)).cast("long")).cast("int") + 1
    return rows.filter(F.col("h") <= near).select("lang", "h", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["lang", "h"])


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Dictionaries from rows with text and label; how many rows are read is bounded for each language."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 62)).alias("h")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("distinct")).collect()
    counts, distinct = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["distinct"] for r in found}
    names = sorted(counts, key=lambda x: (-counts[x], x))
    if not names:
        return Languages([], [])
    sample = sampled(rows, distinct).collect()
    contents = []
    for name in names:
        own = sorted((r["h"], r["text"]) for r in sample if r["lang"] == name)[: 2 * SAMPLE_ROWS]
        contents.append(b" ".join(dict.fromkeys(vocabulary(t) for _, t in own))[-DICTIONARY_BYTES:] or b" ")
    return Languages(names, contents)


def predicted(df: DataFrame, languages: Languages, text_col: str = "text", into: str = "_language") -> DataFrame:
    """``df`` with a struct ``into`` of ``lang_pred``, ``score`` and ``rejected``."""
    prepare(df.sparkSession)
    keep = others(df, into)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.StructType.fromDDL("lang_pred string, score double, rejected boolean"))])
    names = ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [languages.predict(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays(columns, names)], names=[*keep, into])

    return df.select(*map(column, keep), column(text_col).alias(unused(df, "_text"))).mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 4) == 2
    languages = learn(docs.filter(~held))
    return predicted(docs.select("doc_id", held.alias("held_out"), "text"), languages).select("doc_id", "held_out", "_language.*")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    languages, into = learn(docs.filter(crc_bucket("doc_id", 4) != 2)), unused(docs, "_language")
    return predicted(docs, languages, into=into).filter(~F.col(f"{into}.rejected")).select(*map(column, docs.columns))
