"""All queries of this subpackage; importing it registers them."""

from __future__ import annotations

from ledgerloom.llm import (  # noqa: F401
    op1_mixing,
    op10_quality_gam,
    op11_whitening,
    op12_conversation_repair,
    op13_best_fit,
    op2_jaccard_join,
    op3_substring_dedup,
    op4_toxicity,
    op5_fingerprints,
    op6_quality_rules,
    op7_packing,
    op8_line_dedup,
    op9_url_filter,
)
from ledgerloom.llm.registry import ORACLE, QUERIES  # noqa: F401
