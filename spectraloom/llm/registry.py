"""Queries and DuckDB statements of this subpackage."""

from __future__ import annotations

from .bpe import op1_bpe
from .chat import op5_chat
from .jaccard import ORACLE as JACCARD_SQL
from .jaccard import op7_jaccard
from .language import op4_language
from .lm import op8_lm
from .mixing import op9_mixing
from .quality import ORACLE as QUALITY_SQL
from .quality import op2_quality
from .token_counts import op3_token_counts
from .topk import ORACLE as TOPK_SQL
from .topk import op10_topk
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_token_counts, op4_language, op5_chat, op6_toxicity, op7_jaccard, op8_lm, op9_mixing, op10_topk)}

ORACLE_SQL: dict[str, str] = {"op2_quality": QUALITY_SQL, "op7_jaccard": JACCARD_SQL, "op10_topk": TOPK_SQL}
