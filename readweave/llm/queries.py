"""The registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

import corpus_pipeline
from readweave.llm import alignment, conversations, decontaminate, extraction, fingerprints, lm, mixing, quality, sharding, simhash, substrings, toxicity, urls

QUERIES = {
    "op4_lm": lm.op4_lm,
    "op5_extraction": extraction.op5_extraction,
    "op6_toxicity": toxicity.op6_toxicity,
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op7_urls": urls.op7_urls,
    "op8_sharding": sharding.op8_sharding,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_conversations": conversations.op11_conversations,
    "op12_substrings": substrings.op12_substrings,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op12_substrings": substrings.ORACLE_SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
