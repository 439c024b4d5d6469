"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from .license_scan import op4_license_scan
from .line_templates import op6_line_dedup
from .lm_scoring import op3_lm_scoring
from .media import op2_media_columns
from .near_duplicates import op8_near_duplicates
from .packing import op7_packing
from .quality_rules import OP10_SQL, op10_quality_rules
from .repeats import op9_suffix_dedup
from .sentencepiece_codec import op1_sentencepiece
from .token_output import op5_token_records

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_media_columns": op2_media_columns,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_license_scan": op4_license_scan,
    "op5_token_records": op5_token_records,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {"op10_quality_rules": OP10_SQL}
