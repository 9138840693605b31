"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from quarry.llm.alignment import op11_alignment
from quarry.llm.bpe import op1_bpe
from quarry.llm.codes import OP12_SQL, op12_vector_codes
from quarry.llm.cotraining import op7_quality_classifier
from quarry.llm.iblt import op2_fingerprints
from quarry.llm.leaks import OP13_SQL, op13_decontamination
from quarry.llm.packing import op8_packing
from quarry.llm.records import op4_token_records
from quarry.llm.rules import OP10_SQL, op10_quality_rules
from quarry.llm.secrets import op5_secrets
from quarry.llm.simhash import op6_simhash
from quarry.llm.substrings import op3_suffix_dedup
from quarry.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_records": op4_token_records,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_alignment": op11_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontamination": op13_decontamination,
}

SQL: dict[str, str] = {
    "op9_warc": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
