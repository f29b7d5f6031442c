"""Queries of this subpackage, and their SQL where SQL can express them."""

from millrace.llm.conversations import op13_conversations
from millrace.llm.decontaminate import op2_decontaminate
from millrace.llm.fingerprint import op3_fingerprints
from millrace.llm.lm_score import op6_lm_score
from millrace.llm.manifest import op11_manifest
from millrace.llm.ngram_jaccard import op1_ngram_jaccard
from millrace.llm.oracles import ORACLE_SQL
from millrace.llm.packing import op8_packing
from millrace.llm.pii import op9_pii
from millrace.llm.quality_rules import op12_quality_rules
from millrace.llm.substring_dedup import op5_substring_dedup
from millrace.llm.suffix_dedup import op4_suffix_dedup
from millrace.llm.toxicity import op10_toxicity
from millrace.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontaminate": op2_decontaminate,
    "op3_fingerprints": op3_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_manifest": op11_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversations": op13_conversations,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
