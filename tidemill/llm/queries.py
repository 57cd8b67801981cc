"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, html, lm, mixing, negatives, neighbours, phrases, pii, quality, rules, simhash, substrings, warc


def queries() -> dict:
    return {
        "op1_pii": pii.op1,
        "op2_quality_classifier": quality.op2,
        "op3_decontamination": decontam.op3,
        "op4_lm_scoring": lm.op4,
        "op5_quality_rules": rules.op5,
        "op6_source_mixing": mixing.op6,
        "op7_substrings": substrings.op7,
        "op8_warc_audit": warc.op8,
        "op9_main_text": html.op9,
        "op10_simhash": simhash.op10,
        "op11_hard_negatives": negatives.op11,
        "op12_near_vectors": neighbours.op12,
        "op13_collocations": phrases.op13,
    }


def oracle_sql() -> dict:
    return {"op8_warc_audit": warc.OP8_SQL}
