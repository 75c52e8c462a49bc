"""The pipeline's stages on a small corpus."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from celltrail.llm import language_id as languages
from celltrail.llm import ngram_jaccard, toxicity
from celltrail.llm.suffix_dedup import PASSAGE

from .test_operators import components, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    path = tmp_path_factory.mktemp("pipeline")
    passage = prose(rnd, 120)
    rows = [(k, prose(rnd, rnd.randint(20, 90)), "en", "s", 0) for k in range(120)]
    rows += [(200 + k, rows[k][1] + " tail", "en", "s", 0) for k in range(20)]
    rows += [(300 + k, prose(rnd, 60) + " " + passage + " " + prose(rnd, 60), "en", "s", 0) for k in range(4)]
    rows += [(400, None, "en", "s", 0), (401, "123", "en", "s", 0)]
    toxic = [(500 + k, prose(rnd, 25) + " grumbly snarkful vexing " + prose(rnd, 10), "en", "s", 0) for k in range(40)]
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows[:100]] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= before
        if k < 4:
            assert docs.columns == columns
        if name == "suffix_dedup":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert {400, 401}.isdisjoint(kept["language_id"]) and set(range(120)) <= kept["language_id"]
    assert len([d for d in kept["toxicity"] if d >= 500]) <= 2 and len(kept["toxicity"] & set(range(120))) >= 118
    assert not kept["ngram_jaccard"] & set(range(200, 220))
    assert kept["suffix_dedup"] == kept["ngram_jaccard"]


def by_hand(spark, rows, labels):
    """The five stages in plain Python over (doc_id, text, lang, source, n_chars); only the learned models are the operators' own."""
    held_out = lambda d, m: zlib.crc32(("" if d is None else str(d)).encode()) % m
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    told = languages.learn(spark.createDataFrame([r for r in rows if held_out(r[0], 4) != 2], schema))
    rows = [r for r in rows if not told.predict(r[1])[2]]

    toxic = {d: y for d, _, y in labels}
    known = [(r[0], r[1], toxic[r[0]]) for r in rows if r[0] in toxic and held_out(r[0], 3) != 1]
    model, curve = toxicity.learn(spark.createDataFrame(known, "doc_id long, text string, toxic int"))

    def score(text):
        words = toxicity.words_of(*toxicity.lowered(pa.array([text])))
        return curve(toxicity.features(words, *model.ratios(words), 1))[0]

    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]

    groups = {}
    for (k, _, root), r in zip(components([(k, r[1]) for k, r in enumerate(rows)], 80, 5), rows, strict=True):
        groups.setdefault(root, []).append(((r[0] is None, r[0] or 0, k), r))
    rows = [min(g, key=lambda x: x[0])[1] for g in groups.values()]

    length, count = PASSAGE.length, Counter()
    raw = [(r[1] or "").encode() for r in rows]
    for t in raw:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    kept = []
    for r, t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not gone.any():
            kept.append((r[0], left))

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for d, t in kept:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cuts = [(0, min(head, len(ids)))] + [(s, 2048) for s in range(head, len(ids), 2048)]
        pieces += [(d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
    return pieces


def test_run_against_brute_force(spark, folder, tmp_path):
    """Rows of run(): every piece is due and where it says; sequences are filled from 0 without gaps, and are as few as can be but one."""
    rnd = random.Random(14)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    passage = prose(rnd, 55)
    rows += [(700 + k, prose(rnd, 30 + k) + " " + passage + " " + prose(rnd, 40), "en", "s", 0) for k in range(3)]
    rows += [(710, prose(rnd, 4000), "en", "s", 0), (None, prose(rnd, 50), "en", "s", 0), (711, rows[5][1], "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    due = by_hand(spark, rows, labels)
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(due, key=str)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        assert [o for o, _ in sorted(held)] == [sum(n for o2, n in held if o2 < o) for o, _ in sorted(held)] and sum(n for _, n in held) <= 2048
    assert len(by) <= -(-sum(r.length for r in found) // 2048) + 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_one(spark):
    rows = [(5, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (3, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1"), (9, "other"), (10, None), (None, "lone text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(ngram_jaccard.stage_ngram_jaccard(spark, docs, "").collect(), key=str) == sorted([r for r in docs.collect() if r.doc_id != 5], key=str)


def test_repeated_rows_and_null_ids_leave_one(spark, folder, tmp_path):
    """Copies of 400 bytes or more under one id, without an id, or both: one stays whole, and the next stage leaves it."""
    rnd = random.Random(12)
    texts = [prose(rnd, 90) for _ in range(5)]
    own = lambda d, t: (d, t, "en", "s", len(t))
    rows = [own(1000, texts[0])] * 3 + [own(1001, texts[1]), own(None, texts[1])] + [own(None, texts[2]), own(None, texts[2])]
    # an id whose rows differ does not tie their groups together
    rows += [own(1005, texts[3]), own(1005, texts[4]), own(1002, texts[3] + " tail"), own(1006, texts[4] + " tail")]
    due = [(None, texts[2]), (1000, texts[0]), (1001, texts[1]), (1002, texts[3] + " tail"), (1005, texts[4])]
    assert all(len(t) >= 400 for t in texts)
    more = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema)
    left = corpus_pipeline.stage_ngram_jaccard(spark, more, folder)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(due, key=str)
    cut = corpus_pipeline.stage_suffix_dedup(spark, left, folder)
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(due, key=str)
    spark.read.parquet(f"{folder}/documents.parquet").union(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {None, 1000, 1001, 1002, 1005} <= packed and 1006 not in packed


def test_stages_keep_columns_of_any_name(spark, folder):
    """Columns that a stage uses inside come through unchanged."""
    inside = ["_row", "_toxicity", "_language", "own", "row", "h1", "whole", "component_id", "node"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 60")
    for c in inside:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns
        found = left.collect()
        assert len(found) > 50 and all(r[c] == f"{c}{r.doc_id}" for r in found for c in inside)


def test_passages_of_fifty_words_go(spark):
    """Passages of 51 to 60 words in texts that differ otherwise are cut out; texts that share a line of 30 words stay."""
    rnd = random.Random(13)
    line = prose(rnd, 25)[:150]
    rows = []
    for k in range(6):
        passage = " ".join(rnd.choice(("a", "of", "the", "town", "river", "went", "old", "house")) + rnd.choice("aeiou") for _ in range(51 + k))
        rows += [(10 * k + j, prose(rnd, 40 + j) + " " + passage + " " + prose(rnd, 30), passage) for j in range(3)]
    clean = [(900 + k, prose(rnd, 50) + " " + line + " " + prose(rnd, 50), None) for k in range(4)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows + clean], "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.stage_suffix_dedup(spark, docs, "").collect()}
    assert all(p not in left[d] and 60 < len(left[d]) < len(t) - len(p) + 2 for d, t, p in rows)
    assert all(left[d] == t for d, t, _ in clean)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
