"""Registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .chat import OP1_SQL, op1_chat_formatting
from .embedding_dedup import op10_embedding_near_dedup
from .fill_middle import OP11_SQL, op11_fill_middle
from .lexical import OP12_SQL, op12_lexical_search
from .lm import op5_lm_scoring
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import op9_minhash_near_dedup
from .quality import op8_quality_classifier
from .rules import OP4_SQL, op4_quality_rules
from .token_counts import op2_token_counts
from .toxicity import op3_toxicity
from .vector_search import OP13_SQL, op13_exact_top_k

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_top_k": op13_exact_top_k,
}

SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op4_quality_rules": OP4_SQL, "op7_mixing": OP7_SQL, "op11_fill_middle": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_exact_top_k": OP13_SQL}
