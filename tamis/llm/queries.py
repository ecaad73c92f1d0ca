"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from tamis.llm.ball_kmeans import OP12_SQL, op12_ball_kmeans
from tamis.llm.best_fit import op13_best_fit
from tamis.llm.chat import OP7_SQL, op7_chat_rotation
from tamis.llm.decontaminate import OP1_SQL, op1_decontaminate
from tamis.llm.filter_audit import OP11_SQL, op11_filter_audit
from tamis.llm.jaccard import OP3_SQL, op3_ngram_jaccard
from tamis.llm.line_dedup import OP10_SQL, op10_line_dedup
from tamis.llm.packing import op9_packing
from tamis.llm.quality import OP2_SQL, op2_quality
from tamis.llm.suffix_dedup import op4_suffix_dedup
from tamis.llm.token_counts import op5_token_counts
from tamis.llm.toxicity import op6_toxicity
from tamis.llm.training_order import op8_training_order

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_ngram_jaccard, op4_suffix_dedup, op5_token_counts, op6_toxicity, op7_chat_rotation, op8_training_order, op9_packing, op10_line_dedup, op11_filter_audit, op12_ball_kmeans, op13_best_fit)}
ORACLES = {"op1_decontaminate": OP1_SQL, "op2_quality": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op7_chat_rotation": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_ball_kmeans": OP12_SQL}
