"""The opN_ queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontaminate
from .langid import op7_language_id
from .minhash import OP2_SQL, op2_minhash_dedup
from .packing import op3_packing
from .quality import op5_quality
from .secrets import op4_secrets
from .tokenfile import op10_token_file
from .toxicity import op9_toxicity
from .urlfilter import OP6_SQL, op6_url_filter
from .vectordedup import OP1_SQL, op1_embedding_dedup

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_token_file": op10_token_file,
}

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op2_minhash_dedup": OP2_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_decontaminate": OP8_SQL,
}
