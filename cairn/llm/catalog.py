"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from cairn.llm.chat_format import SQL_OP2, q_op2
from cairn.llm.decontamination import q_op7
from cairn.llm.hard_negatives import SQL_OP12, q_op12
from cairn.llm.license_scan import q_op6
from cairn.llm.ngram_join import q_op1
from cairn.llm.packing import q_op9
from cairn.llm.perplexity import q_op10
from cairn.llm.quality_rules import q_op3
from cairn.llm.sharding import q_op8
from cairn.llm.suffix_dedup import q_op5
from cairn.llm.toxicity import q_op4
from cairn.llm.url_filter import q_op11
from cairn.llm.vector_codes import SQL_OP13, q_op13

QUERIES = {
    "op1_ngram_join": q_op1,
    "op2_chat_format": q_op2,
    "op3_quality_rules": q_op3,
    "op4_toxicity": q_op4,
    "op5_suffix_dedup": q_op5,
    "op6_license_scan": q_op6,
    "op7_decontamination": q_op7,
    "op8_sharding": q_op8,
    "op9_packing": q_op9,
    "op10_perplexity": q_op10,
    "op11_url_filter": q_op11,
    "op12_hard_negatives": q_op12,
    "op13_vector_codes": q_op13,
}

ORACLE = {"op2_chat_format": SQL_OP2, "op12_hard_negatives": SQL_OP12, "op13_vector_codes": SQL_OP13}
