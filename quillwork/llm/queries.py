"""The queries of this subpackage by name, and SQL where SQL can express one."""

from __future__ import annotations

from quillwork.llm import op6_exact, op11_middle, op13_centroids
from quillwork.llm.op1_shards import op1_training_order
from quillwork.llm.op2_minhash import op2_minhash_near_dedup
from quillwork.llm.op3_bpe import op3_bpe_round_trip
from quillwork.llm.op4_counts import op4_token_counts
from quillwork.llm.op5_secrets import op5_secret_scan
from quillwork.llm.op7_langid import op7_language_id
from quillwork.llm.op8_quality import op8_quality_rules
from quillwork.llm.op9_lm import op9_lm_scores
from quillwork.llm.op10_packing import op10_packing
from quillwork.llm.op12_suffixes import op12_suffix_dedup

QUERIES = {
    "op1_training_order": op1_training_order,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact.op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scores": op9_lm_scores,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_middle.op11_fill_in_middle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_centroid_clusters": op13_centroids.op13_centroid_clusters,
}
ORACLE_SQL = {"op6_exact_dedup": op6_exact.ORACLE, "op11_fill_in_middle": op11_middle.ORACLE, "op13_centroid_clusters": op13_centroids.ORACLE}
