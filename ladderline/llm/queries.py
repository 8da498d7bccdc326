"""Names and oracle SQL of the training-data queries."""

from __future__ import annotations

import corpus_pipeline
from ladderline.llm import chat, fill_in_middle, lexical, near_dedup, suffix_dedup
from ladderline.llm.ann import op4_ann
from ladderline.llm.chat import op5_chat_format
from ladderline.llm.fill_in_middle import op12_fill_in_middle
from ladderline.llm.langid import op6_language_id
from ladderline.llm.lexical import op11_lexical_search
from ladderline.llm.mixing import op8_mixing
from ladderline.llm.near_dedup import op7_near_dedup
from ladderline.llm.packing import op2_packing
from ladderline.llm.quality import op10_quality_rules
from ladderline.llm.quality import oracle as quality_oracle
from ladderline.llm.substring_dedup import op9_substring_dedup
from ladderline.llm.suffix_dedup import op13_suffix_dedup
from ladderline.llm.token_orc import op3_token_orc
from ladderline.llm.toxicity import op1_toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_token_orc": op3_token_orc,
    "op4_ann": op4_ann,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_suffix_dedup": op13_suffix_dedup,
}
#: The others are beyond SQL; tests/llm hold them against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {
    "op5_chat_format": chat.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op10_quality_rules": quality_oracle(),
    "op11_lexical_search": lexical.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_suffix_dedup": suffix_dedup.ORACLE,
}
