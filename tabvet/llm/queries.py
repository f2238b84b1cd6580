"""Registered queries of the training-data operators and their DuckDB twins where SQL can express them."""

from tabvet.llm.bpe import op2
from tabvet.llm.exact_dedup import OP5_SQL, op5
from tabvet.llm.html_text import op6
from tabvet.llm.jaccard_join import op9
from tabvet.llm.language import op8
from tabvet.llm.merkle import OP12_SQL, op12
from tabvet.llm.mix import op1
from tabvet.llm.quality import op7
from tabvet.llm.runs import OP11_SQL, op11
from tabvet.llm.token_counts import op4
from tabvet.llm.toxicity import op13
from tabvet.llm.url_filter import op3
from tabvet.llm.vector_search import op10

QUERIES = {
    "op1_mix_sources": op1,
    "op2_bpe": op2,
    "op3_url_filter": op3,
    "op4_token_counts": op4,
    "op5_exact_dedup": op5,
    "op6_html_text": op6,
    "op7_quality": op7,
    "op8_language": op8,
    "op9_jaccard_join": op9,
    "op10_vector_search": op10,
    "op11_periodic_runs": op11,
    "op12_merkle_manifest": op12,
    "op13_toxicity": op13,
}

ORACLE_SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
