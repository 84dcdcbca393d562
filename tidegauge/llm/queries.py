"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .bpe_codec import op4_bpe_codec
from .decontaminate import OP3_SQL, op3_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .fingerprints import op11_fingerprints
from .license_scan import op10_license_scan
from .near_dedup import OP5_SQL, op5_near_dedup
from .phrases import OP12_SQL, op12_phrases
from .quality_lm import op2_quality_lm
from .quality_rules import op8_quality_rules
from .sharding import OP1_SQL, op1_sharding
from .substring_dedup import op9_substring_dedup
from .token_counts import op7_token_counts
from .token_files import op6_token_files

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_lm": op2_quality_lm,
    "op3_decontamination": op3_decontamination,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_fingerprints": op11_fingerprints,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op1_sharding": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_near_dedup": OP5_SQL, "op12_phrases": OP12_SQL, "op13_filter_audit": OP13_SQL}
