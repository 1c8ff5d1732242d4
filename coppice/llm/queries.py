"""The operN queries and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, line_dedup, ngram_join, packing, quality, token_count, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_token_count": token_count.op2,
    "op3_toxicity": toxicity.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_quality": quality.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_url_filter": url_filter.op8,
    "op9_chat": chat.op9,
    "op10_packing": packing.op10,
}

SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_url_filter": url_filter.op8_sql(),
    "op9_chat": chat.op9_sql(),
}
