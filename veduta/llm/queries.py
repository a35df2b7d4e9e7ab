"""The operators' registered queries and their SQL."""

from __future__ import annotations

from veduta.llm import chat, exact, language, mixing, near, neighbours, packing, private, substring, tokens

QUERIES = {
    "op1_language": language.op1_language,
    "op2_near": near.op2_near,
    "op3_packing": packing.op3_packing,
    "op4_chat": chat.op4_chat,
    "op5_private": private.op5_private,
    "op6_exact": exact.op6_exact,
    "op7_substring": substring.op7_substring,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_tokens": tokens.op9_tokens,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op6_exact": exact.ORACLE, "op7_substring": substring.ORACLE, "op10_mixing": mixing.ORACLE}
