"""Stages that turn raw documents into packed training sequences.

Each stage works on all that the one before kept, and its decisions take effect:
documents whose language is not told clearly go, then toxic ones, then all but one of
each group of near duplicates; passages that repeat across what is left are cut out;
the rest is packed into sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from celltrail.llm._common import stored, table
from celltrail.llm.best_fit_packing import stage_best_fit_packing
from celltrail.llm.language_id import stage_language_id
from celltrail.llm.ngram_jaccard import stage_ngram_jaccard
from celltrail.llm.suffix_dedup import stage_suffix_dedup
from celltrail.llm.toxicity import stage_toxicity

STAGES = [
    ("language_id", stage_language_id),
    ("toxicity", stage_toxicity),
    ("ngram_jaccard", stage_ngram_jaccard),
    ("suffix_dedup", stage_suffix_dedup),
    ("best_fit_packing", stage_best_fit_packing),
]

#: Learned models, connected components and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
