"""The queries of the training-text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import op01_secrets, op02_minhash, op03_quality, op04_langid, op05_mixing, op06_lm, op07_substrings, op08_fingerprints, op09_html, op10_bpe, op11_negatives, op12_collocations, op13_sentencepiece

QUERIES = {
    "op1_secret_scans": op01_secrets.op1_secret_scans,
    "op2_minhash_dedup": op02_minhash.op2_minhash_dedup,
    "op3_quality_rules": op03_quality.op3_quality_rules,
    "op4_language_id": op04_langid.op4_language_id,
    "op5_mixing": op05_mixing.op5_mixing,
    "op6_lm_scoring": op06_lm.op6_lm_scoring,
    "op7_substring_dedup": op07_substrings.op7_substring_dedup,
    "op8_fingerprints": op08_fingerprints.op8_fingerprints,
    "op9_html_extraction": op09_html.op9_html_extraction,
    "op10_bpe": op10_bpe.op10_bpe,
    "op11_hard_negatives": op11_negatives.op11_hard_negatives,
    "op12_collocations": op12_collocations.op12_collocations,
    "op13_sentencepiece": op13_sentencepiece.op13_sentencepiece,
}
ORACLES = {"op1_secret_scans": op01_secrets.ORACLE, "op3_quality_rules": op03_quality.ORACLE, "op5_mixing": op05_mixing.ORACLE, "op11_hard_negatives": op11_negatives.ORACLE, "op12_collocations": op12_collocations.ORACLE}


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
