"""This subpackage's queries and their SQL."""

from __future__ import annotations

from .op1_langid import op1_crf_language
from .op10_lines import op10_segment_edit
from .op11_middle import OP11_SQL, op11_lookaround_middle
from .op12_merkle import OP12_SQL, op12_merkle_store
from .op13_token_files import op13_token_files
from .op2_suffix_tree import op2_suffix_tree
from .op3_lines import OP3_SQL, op3_line_first
from .op4_paragraphs import op4_paragraph_minhash
from .op5_quality import op5_neighbours
from .op6_secrets import OP6_SQL, op6_ownership
from .op7_decontaminate import OP7_SQL, op7_containment
from .op8_jaccard import OP8_SQL, op8_ngram_join
from .op9_bpe import op9_bpe_backtrack


QUERIES = (
    op1_crf_language, op2_suffix_tree, op3_line_first, op4_paragraph_minhash, op5_neighbours, op6_ownership, op7_containment, op8_ngram_join,
    op9_bpe_backtrack, op10_segment_edit, op11_lookaround_middle, op12_merkle_store, op13_token_files,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_first": OP3_SQL, "op6_ownership": OP6_SQL, "op7_containment": OP7_SQL, "op8_ngram_join": OP8_SQL, "op11_lookaround_middle": OP11_SQL, "op12_merkle_store": OP12_SQL}
