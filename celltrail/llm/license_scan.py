"""Licence scans with a positional rare-token index, in DataFrame functions alone.

Every template is a sequence of words. Its rare words, those of highest inverse
document frequency over all texts, stand in the index, an inverted list of postings
(template, place in the template) for each word (:func:`postings`). A text's words that are in the index
are looked up with their places; each posting says where its template would begin. The
candidates of a text are sorted, and one on which as many postings agree as the
template has rare words is a place where all of them stand as they should: the
intersection of their postings by relative position. It counts if the
template's mandatory phrases stand there too; the base phrases are
mandatory as a whole, so they are found wherever they stand, and nowhere else.

The words of a text are taken apart only if the text holds the rarest word of a
template at all. Frequencies are counted over all texts, for the words of the
templates alone, so what is collected and the index in the plan are as large as the templates.

Defined cases: a null text is empty; a text without words has no place, label or
score; a very long text is looked up like any other, in time that grows with its words and the
postings they have; repeated rows are scanned alike; other columns take no part, but one of the name
that is added gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, others, table, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Words in order, the label they stand for, and the phrases (start, length) that must be there."""

    words: tuple[str, ...]
    label: str
    mandatory: tuple[tuple[int, int], ...]
    base: bool = False


def phrase(text: str, label: str, base: bool = False) -> Template:
    """A template that must stand as a whole."""
    words = tuple(text.split())
    return Template(words, label, ((0, len(words)),), base)


def notice(text: str, label: str) -> Template:
    """A template of which the parts in brackets must stand; words between may differ."""
    words, mandatory, begin = [], [], 0
    for part in text.replace("[", " [ ").replace("]", " ] ").split():
        if part == "[":
            begin = len(words)
        elif part == "]":
            mandatory.append((begin, len(words) - begin))
        else:
            words.append(part)
    return Template(tuple(words), label, tuple(mandatory))


# The base phrases and their labels.
BASE = (
    phrase("mit license", "mit", base=True),
    phrase("apache license", "apache", base=True),
    phrase("general public license", "gpl", base=True),
)
# Words of well-known licence notices.
NOTICES = (
    phrase("lesser general public license", "lgpl"),
    phrase("affero general public license", "agpl"),
    phrase("mozilla public license", "mpl"),
    phrase("eclipse public license", "epl"),
    phrase("bsd license", "bsd"),
    phrase("isc license", "isc"),
    phrase("cc by 4 0", "cc-by"),
    phrase("cc by sa", "cc-by-sa"),
    phrase("cc by nc", "cc-by-nc"),
    phrase("cc0 1 0", "cc0"),
    phrase("creative commons attribution", "cc-by"),
    phrase("all rights reserved", "all-rights-reserved"),
    notice("licensed under the [apache license version 2 0]", "apache-2.0"),
    notice("gnu [general public license version 2]", "gpl-2.0"),
    notice("gnu [general public license version 3]", "gpl-3.0"),
    notice("[permission is hereby granted free of charge to any person] obtaining a copy of [this software]", "mit"),
    notice("[redistribution and use in source and binary forms] with or without modification are permitted", "bsd"),
    notice("[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted", "isc"),
    notice("[this software is provided as is without any express or implied warranty] in no event will the authors be held liable", "zlib"),
    notice("[this is free and unencumbered software released into the public domain]", "unlicense"),
    notice("[this source code form is subject to the terms of the mozilla public license] v 2 0", "mpl-2.0"),
    notice("you may not use this file except in [compliance with the license] you may [obtain a copy of the license at]", "apache-2.0"),
    notice("you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation]", "gpl"),
    notice("you can redistribute it and or modify it under the terms of the [gnu lesser general public license as published by the free software foundation]", "lgpl"),
    notice("you can redistribute it and or modify it under the terms of the [gnu affero general public license as published by] the free software foundation", "agpl"),
    notice("[neither the name of] the copyright holder [nor the names of its contributors may be used to endorse or promote products]", "bsd-3-clause"),
    notice("[boost software license version 1 0]", "boost-1.0"),
    notice("this program and the accompanying materials are made available [under the terms of the eclipse public license]", "epl"),
    notice("[this work is licensed under a creative commons attribution]", "cc-by"),
)
TEMPLATES = BASE + NOTICES
#: Rare words of a template that stand in the index, at most.
RARE = 3


def lowered(text: Column) -> Column:
    """A-Z as a-z, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _any_word(words: list[str]) -> str:
    """A pattern of any of the words, in either case, as a whole word."""
    return rf"(?i)(?<!{_WORD_ANY_CASE[:-1]})(?:{'|'.join(words)})(?!{_WORD_ANY_CASE[:-1]})"


def frequencies(df: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Texts in all, and how many hold each word of the templates."""
    text = F.coalesce(column(text_col), F.lit(""))
    words = vocabulary(templates)
    holds = F.array_distinct(F.regexp_extract_all(text, F.lit(_any_word(words)), F.lit(0)))
    each = df.select(F.explode(F.array_distinct(F.transform(holds, lowered))).alias("word"))
    found = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return df.count(), found


def postings(templates: tuple[Template, ...], idf: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """The index, (template, place) of each rare word, and how many rare words each template has; the rarest mandatory words are taken."""
    index: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for k, t in enumerate(templates):
        must = [i for begin, length in t.mandatory for i in range(begin, begin + length)]
        places = sorted(must, key=lambda i, t=t: (-idf[t.words[i]], t.words[i], i))[:RARE]
        sizes.append(len(places))
        for i in places:
            index.setdefault(t.words[i], []).append((k, i))
    return index, sizes


def scanned(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text", into: str = "_scan") -> DataFrame:
    """``df`` with an array ``into`` of struct(template int, start int), by template and place."""
    words_, found_ = unused(df, "_words"), unused(df, "_found")
    n, found = frequencies(df, templates, text_col)
    idf = {w: math.log((n + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary(templates)}
    index, sizes = postings(templates, idf)
    # A text can hold a template only if it holds its rarest word: that is looked for before words are taken apart.
    rarest = sorted({max((w for w in index if any(p[0] == k for p in index[w])), key=lambda w: (idf[w], w)) for k in range(len(templates))})
    text = F.coalesce(column(text_col), F.lit(""))
    none = F.array().cast("array<struct<template:int,start:int>>")
    words = F.when(text.rlike(_any_word(rarest)), F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    lists = ", ".join(f"'{w}', array({', '.join(f'struct({k} AS template, {i} AS place)' for k, i in index[w])})" for w in sorted(index))
    held = F.expr(f"map({lists})")
    known = F.array(*[F.lit(w) for w in sorted(index)])
    hits = F.filter(F.transform(words_, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains(known, h["word"]))
    begins = F.flatten(
        F.transform(hits, lambda h: F.transform(F.try_element_at(held, h["word"]), lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["place"]).cast("int").alias("start"))))
    )
    needed = F.array(*[F.lit(x) for x in sizes])
    # sorted, postings that agree stand on end: the last of as many as needed tells
    agreed = F.filter(found_, lambda c, i: (c["start"] >= 0) & (i + 1 >= F.get(needed, c["template"])) & (F.get(found_, i + 1 - F.get(needed, c["template"])) == c))
    phrases = F.expr("array(" + ", ".join("array(" + ", ".join(f"struct({b} AS begin, array({', '.join(repr(w) for w in t.words[b : b + m])}) AS words)" for b, m in t.mandatory) + ")" for t in templates) + ")")

    def stands(c: Column) -> Column:
        return F.forall(F.get(phrases, c["template"]), lambda p: F.slice(words_, c["start"] + p["begin"] + 1, F.size(p["words"])) == p["words"])

    return (
        df.withColumn(words_, words)
        .withColumn(found_, F.when(F.size(words_) > 0, F.array_sort(begins)).otherwise(none))
        .select(*map(column, others(df, into)), F.when(F.size(found_) > 0, F.filter(agreed, stands)).otherwise(none).alias(into))
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of licence phrases in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.array(*[F.lit(k) for k, t in enumerate(TEMPLATES) if t.base])
    label = F.array(*[F.lit(t.label) for t in TEMPLATES])
    phrases = F.filter("_scan", lambda p: F.array_contains(base, p["template"]))
    starts = F.transform("_base", lambda p: p["start"].cast("long"))

    def labels(of: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: F.get(label, p["template"])))), ",")

    return (
        scanned(docs)
        .withColumn("_base", phrases)
        .select(
            "doc_id",
            F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"),
            F.size("_base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            labels("_base").alias("base_labels"),
            labels("_scan").alias("labels"),
            (F.lit(1.0) - F.pow(F.lit(0.5), F.size("_scan"))).alias("score"),
        )
    )


def oracle_sql() -> str:
    """The query in DuckDB SQL: every template tried at every word."""

    def at(t: Template) -> str:
        test = " AND ".join(f"words[i + {j}] = '{t.words[j]}'" for b, n in t.mandatory for j in range(b, b + n))
        return f"[i - 1 FOR i IN range(1, len(words) + 1) IF {test}]"

    places = ", ".join(f"{at(t)} AS p{k}" for k, t in enumerate(TEMPLATES))
    base = [f"p{k}" for k, t in enumerate(TEMPLATES) if t.base]

    def labels(only_base: bool) -> str:
        each = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(TEMPLATES) if t.base or not only_base)
        return f"array_to_string(list_sort(list_distinct([x FOR x IN [{each}] IF x IS NOT NULL])), ',')"

    pattern = WORD.replace("'", "''")
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n_words, {places} FROM w)
SELECT doc_id, n_words, {' + '.join(f'len({b})' for b in base)} AS n_base,
  list_min(list_concat({', '.join(base)})) AS first_word, list_max(list_concat({', '.join(base)})) AS last_word,
  {labels(True)} AS base_labels, {labels(False)} AS labels,
  1 - pow(0.5e0, {' + '.join(f'len(p{k})' for k in range(len(TEMPLATES)))}) AS score
FROM p
"""
