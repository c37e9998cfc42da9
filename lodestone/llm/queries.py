"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from .language_id import op9_language_id
from .mixing import op3_mixing
from .near_dedup import op5_near_dedup
from .nearest import op7_nearest
from .packing import op8_packing
from .quality import op6_quality
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op4_token_counts
from .vector_dedup import op10_vector_dedup

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_substring_dedup, op3_mixing, op4_token_counts, op5_near_dedup, op6_quality, op7_nearest, op8_packing, op9_language_id, op10_vector_dedup)}
ORACLE_SQL: dict[str, str] = {}
