"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op9_decontamination
from .filter_audit import OP11_SQL, op11_filter_audit
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .kd_sharding import op2_kd_sharding
from .line_dedup import OP7_SQL, op7_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .packing import op10_packing
from .ppm import op4_ppm_scores
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_counts import op12_token_counts
from .topk import OP5_SQL, op5_ball_tree_topk
from .toxicity import op3_toxicity
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_ball_tree_topk": op5_ball_tree_topk,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op5_ball_tree_topk": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
