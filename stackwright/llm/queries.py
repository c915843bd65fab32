"""The subpackage's queries, and SQL for those that SQL can express.

The others are tested against brute force, exact round trips or held-out
accuracy in ``tests/llm``."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_format
from .decontam import OP9_SQL, op9_decontaminate
from .langid import op4_language_id
from .lm import op8_lm_scores
from .mixing import op1_mix_sources
from .neardup import op6_near_duplicates
from .quality import op7_quality_rules
from .sharding import op3_shard_documents
from .token_counts import op5_token_counts
from .token_io import op10_token_ids

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_chat_format, op3_shard_documents, op4_language_id, op5_token_counts,
        op6_near_duplicates, op7_quality_rules, op8_lm_scores, op9_decontaminate, op10_token_ids,
    )
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op9_decontaminate": OP9_SQL}
