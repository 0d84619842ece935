"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .bpe import op1_bpe
from .context_mixing import op11_lm_scoring
from .decontaminate import OP3_SQL, op3_decontamination
from .html_extract import op5_html_extraction
from .jaccard import op4_jaccard_join
from .language import op10_language
from .license_scan import op9_license_scans
from .quality_model import op7_quality_classifier
from .quality_rules import OP6_SQL, op6_quality_rules
from .secret_scan import OP8_SQL, op8_secret_scans
from .token_alignment import op12_token_alignment
from .toxicity import op2_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scans": op8_secret_scans,
    "op9_license_scans": op9_license_scans,
    "op10_language": op10_language,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_token_alignment": op12_token_alignment,
}

ORACLE_SQL = {
    "op3_decontamination": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op8_secret_scans": OP8_SQL,
}
