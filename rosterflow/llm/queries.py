"""The registered queries of this subpackage and their SQL."""

from .decontam import op10_decontamination
from .fingerprint import op3_fingerprint
from .licenses import op8_licenses, report_sql
from .lm import op9_lm
from .packing import op6_packing
from .quality import op4_quality
from .simhash import op1_simhash
from .suffix import op5_suffix
from .tokencount import op2_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprint": op3_fingerprint,
    "op4_quality": op4_quality,
    "op5_suffix": op5_suffix,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_lm": op9_lm,
    "op10_decontamination": op10_decontamination,
}
ORACLE = {"op8_licenses": report_sql()}
