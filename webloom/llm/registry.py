"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from webloom.llm import op1_chat_format as op1
from webloom.llm import op2_packing as op2
from webloom.llm import op3_byte_bpe as op3
from webloom.llm import op4_quality_rules as op4
from webloom.llm import op5_fingerprints as op5
from webloom.llm import op6_near_duplicates as op6
from webloom.llm import op7_quality_classifier as op7
from webloom.llm import op8_url_filters as op8
from webloom.llm import op9_token_counts as op9
from webloom.llm import op10_substring_dedup as op10
from webloom.llm import op11_periodic_runs as op11
from webloom.llm import op12_main_text as op12
from webloom.llm import op13_lexical_search as op13

QUERIES = {
    "op1_chat_format": op1.op1_chat_format,
    "op2_packing": op2.op2_packing,
    "op3_byte_bpe": op3.op3_byte_bpe,
    "op4_quality_rules": op4.op4_quality_rules,
    "op5_fingerprints": op5.op5_fingerprints,
    "op6_near_duplicates": op6.op6_near_duplicates,
    "op7_quality_classifier": op7.op7_quality_classifier,
    "op8_url_filters": op8.op8_url_filters,
    "op9_token_counts": op9.op9_token_counts,
    "op10_substring_dedup": op10.op10_substring_dedup,
    "op11_periodic_runs": op11.op11_periodic_runs,
    "op12_main_text": op12.op12_main_text,
    "op13_lexical_search": op13.op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": op1.SQL,
    "op4_quality_rules": op4.SQL,
    "op6_near_duplicates": op6.SQL,
    "op12_main_text": op12.SQL,
    "op13_lexical_search": op13.SQL,
}
