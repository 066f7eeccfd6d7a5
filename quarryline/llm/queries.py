"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .language import op2_language_id
from .media import op8_media_columns
from .near_dedup import op3_near_dedup
from .oracles import OP3_SQL, OP5_SQL, OP10_SQL
from .packing import op9_packing
from .records import op1_token_records
from .secrets import op5_secret_scans
from .substring_dedup import op10_substring_dedup
from .toxicity import op6_toxicity

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_media_columns": op8_media_columns,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL = {"op3_near_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_secret_scans": OP5_SQL, "op10_substring_dedup": OP10_SQL}
