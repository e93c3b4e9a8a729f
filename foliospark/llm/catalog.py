"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from foliospark.llm import decontaminate, hmm, html_text, importance, langid, packing, pii, quality_rules, sharding, simhash

QUERIES = {
    "op2_importance": importance.op2_importance,
    "op6_html": html_text.op6_html,
    "op8_language": langid.op8_language,
    "op5_hmm": hmm.op5_hmm,
    "op4_pii": pii.op4_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op3_sharding": sharding.op3_sharding,
    "op9_packing": packing.op9_packing,
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op7_simhash": simhash.op7_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
}
