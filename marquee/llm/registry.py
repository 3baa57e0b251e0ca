"""The queries of this folder and their DuckDB twins."""

from __future__ import annotations

from marquee.llm import chat, leaks, licenses, neardup, pieces, prefixtrie, quality, repeats, secretscan, sharding, spelling, topk, toxicity

QUERIES = {
    "op11_top_neighbours": topk.op11_top_neighbours,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "op7_licenses": licenses.op7_licenses,
    "op6_shards": sharding.op6_shards,
    "op5_repeated_bytes": repeats.op5_repeated_bytes,
    "op4_toxicity": toxicity.op4_toxicity,
    "op2_chat_format": chat.op2_chat_format,
    "op3_secrets": secretscan.op3_secrets,
    "op1_benchmark_leaks": leaks.op1_benchmark_leaks,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_pieces": pieces.op9_pieces,
    "op10_quality_rules": quality.op10_quality_rules,
}

SQL = {
    "op11_top_neighbours": topk.oracle(),
    "op10_quality_rules": quality.oracle(),
}
