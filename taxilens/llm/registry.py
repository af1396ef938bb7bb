"""Queries and statements of this subpackage, by name."""

from __future__ import annotations

from .backoff_lm import OP11_SQL, op11_backoff_lm
from .decontaminate import op7_decontaminate
from .jaccard import OP4_SQL, op4_jaccard_join
from .language import op2_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_fair_mix
from .passage_dedup import op10_passage_dedup
from .phrases import OP13_SQL, op13_collocations
from .pii import op8_pii
from .quality import op9_quality_rules
from .spelling import OP12_SQL, op12_spelling
from .substring_dedup import op3_suffix_dedup
from .token_store import op1_token_store

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_fair_mix": op5_fair_mix,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_backoff_lm": op11_backoff_lm,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}

SQL = {
    "op4_jaccard_join": OP4_SQL,
    "op5_fair_mix": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_backoff_lm": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
