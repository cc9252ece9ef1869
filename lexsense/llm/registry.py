"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""
from __future__ import annotations

from lexsense.llm import (
    collocations, divergence, hosts, language, lines, neardup, packing, pieces, quality, substrings, suffixes, toxicity,
    vectors,
)

QUERIES = {
    "op1_suffix_array_dedup": suffixes.op1_suffix_array_dedup,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
    "op5_quality_rules": lines.op5_quality_rules,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_language_id": language.op7_language_id,
    "op8_packing": packing.op8_packing,
    "op9_embedding_dedup": vectors.op9_embedding_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_collocations": collocations.op12_collocations,
    "op13_url_filter": hosts.op13_url_filter,
}
ORACLE = {
    "op1_suffix_array_dedup": suffixes.OP1_SQL, "op2_substring_dedup": substrings.OP2_SQL,
    "op4_minhash_near_dedup": neardup.OP4_SQL, "op5_quality_rules": lines.OP5_SQL,
    "op9_embedding_dedup": vectors.OP9_SQL, "op11_source_divergence": divergence.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL, "op13_url_filter": hosts.OP13_SQL,
}
