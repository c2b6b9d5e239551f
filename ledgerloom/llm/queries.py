"""Queries of the training-data operators, by name."""

from __future__ import annotations

from .ann import op6_nearest
from .chat import op7_chat
from .decontamination import op2_decontamination
from .divergence import OP11_SQL, op11_divergence
from .exact_dup import OP13_SQL, op13_exact_dup
from .html_text import op10_html_text
from .language import op3_language
from .mixing import op9_mix
from .near_dup import op5_near_duplicates
from .passages import op8_repeated_passages
from .repair import OP12_SQL, op12_repair
from .sharding import op4_shards
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "op4_shards": op4_shards,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_nearest": op6_nearest,
    "op7_chat": op7_chat,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_mix": op9_mix,
    "op10_html_text": op10_html_text,
    "op11_divergence": op11_divergence,
    "op12_repair": op12_repair,
    "op13_exact_dup": op13_exact_dup,
}

#: SQL equivalents, where SQL can express the operator in reasonable time.
ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op11_divergence": OP11_SQL, "op12_repair": OP12_SQL, "op13_exact_dup": OP13_SQL}
