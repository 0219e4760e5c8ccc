"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import hard_negatives, html_extraction, jaccard_join, mixing, nearest, packing, quality_classifier, quality_rules, sentencepiece_fst, substring_dedup, token_files, toxicity, whitening
from .oracle import ORACLE_SQL

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_files": token_files.op2_token_files,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_nearest": nearest.op9_nearest,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_mixing": mixing.op12_mixing,
    "op13_whitening": whitening.op13_whitening,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
