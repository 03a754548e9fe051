"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .additive_ann import op10_additive_ann
from .decontamination import OP1_SQL, op1_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .fuzzy_simhash import op12_fuzzy_simhash
from .importance import op11_importance_resampling
from .license_scan import OP7_SQL, op7_license_scan
from .line_dedup import op9_line_dedup
from .mixing import op8_mixing
from .ngram_join import op6_ngram_join
from .pitman_yor import op3_pitman_yor
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op5_toxicity
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_additive_ann": op10_additive_ann,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fuzzy_simhash": op12_fuzzy_simhash,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op7_license_scan": OP7_SQL,
    "op13_filter_audit": OP13_SQL,
}
