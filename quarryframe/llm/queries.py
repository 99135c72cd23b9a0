"""The queries of the corpus operators and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

from .ann import op3_ann
from .decontaminate import op1_decontamination
from .html_wrapper import op4_html_extraction
from .line_dedup import OP8_SQL, op8_line_dedup
from .minhash import op10_minhash_near_dedup
from .packing import op6_best_fit_packing
from .quality import op5_quality_classifier
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import OP7_SQL, op7_suffix_array_dedup
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_ann": op3_ann,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLE = {
    "op2_warc": OP2_SQL,
    "op7_suffix_array_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
}
