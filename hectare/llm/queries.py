"""The queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

from .bpe import op8_bpe
from .chat import SQL as SQL_12
from .chat import op12_chat_format
from .exact_dedup import SQL as SQL_1
from .exact_dedup import op1_exact_dedup
from .line_dedup import op3_line_dedup
from .lm_score import op4_lm_score
from .near_dedup import SQL as SQL_2
from .near_dedup import op2_near_dedup
from .negatives import SQL as SQL_13
from .negatives import op13_hard_negatives
from .packing import op9_packing
from .quality import op5_quality
from .runs import op11_word_runs
from .sharding import SQL as SQL_7
from .sharding import op7_sharding
from .suffix_dedup import op6_suffix_dedup
from .topk import SQL as SQL_10
from .topk import op10_topk

QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_near_dedup": op2_near_dedup, "op3_line_dedup": op3_line_dedup, "op4_lm_score": op4_lm_score, "op5_quality": op5_quality, "op6_suffix_dedup": op6_suffix_dedup, "op7_sharding": op7_sharding, "op8_bpe": op8_bpe, "op9_packing": op9_packing, "op10_topk": op10_topk,
           "op11_word_runs": op11_word_runs, "op12_chat_format": op12_chat_format, "op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op1_exact_dedup": SQL_1, "op2_near_dedup": SQL_2, "op7_sharding": SQL_7, "op10_topk": SQL_10, "op12_chat_format": SQL_12, "op13_hard_negatives": SQL_13}
