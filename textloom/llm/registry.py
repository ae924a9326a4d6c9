"""Registered corpus queries and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import chat_format, conversation_repair, decontamination, mixing, near_dedup, quality_rules, spelling
from textloom.llm.chat_format import op12_chat_format
from textloom.llm.conversation_repair import op11_conversation_repair
from textloom.llm.decontamination import op9_decontamination
from textloom.llm.language_model import op3_language_model
from textloom.llm.licenses import op4_license_scan
from textloom.llm.mixing import op10_mixing
from textloom.llm.near_dedup import op1_near_dedup
from textloom.llm.quality_model import op2_quality_model
from textloom.llm.quality_rules import op7_quality_rules
from textloom.llm.secrets import op8_secrets
from textloom.llm.spelling import op13_spelling_variants
from textloom.llm.substring_dedup import op5_substring_dedup
from textloom.llm.token_shards import op6_token_shards

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_model": op2_quality_model,
    "op3_language_model": op3_language_model,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_shards": op6_token_shards,
    "op7_quality_rules": op7_quality_rules,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_chat_format": op12_chat_format,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op9_decontamination": decontamination.SQL,
    "op10_mixing": mixing.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_chat_format": chat_format.SQL,
    "op13_spelling_variants": spelling.SQL,
}
