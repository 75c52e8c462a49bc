"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from .best_fit_packing import op2_best_fit_packing
from .html_extraction import op6_html_extraction
from .language_id import op3_language_id
from .license_scan import op9_license_scan
from .license_scan import oracle_sql as license_sql
from .multiset_fingerprint import op4_multiset_fingerprint
from .ngram_jaccard import op7_ngram_jaccard
from .sentencepiece_fst import op8_sentencepiece_fst
from .suffix_dedup import op5_suffix_dedup
from .topk_search import ORACLE_SQL as TOPK_SQL
from .topk_search import op10_topk_search
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op9_license_scan": op9_license_scan,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op10_topk_search": op10_topk_search,
    "op6_html_extraction": op6_html_extraction,
    "op8_sentencepiece_fst": op8_sentencepiece_fst,
    "op4_multiset_fingerprint": op4_multiset_fingerprint,
}

ORACLE_SQL: dict[str, str] = {
    "op9_license_scan": license_sql(),
    "op10_topk_search": TOPK_SQL,
}
