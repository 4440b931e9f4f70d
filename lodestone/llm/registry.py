"""Queries and oracle SQL of the training-data operators, by name."""

from lodestone.llm import exact_dedup, fill_middle, html_extract, jaccard_join, mixing, packing, secrets, source_audit, token_counts, token_store, topk_search, toxicity, url_filter

MODULES = (token_store, html_extract, exact_dedup, toxicity, packing, url_filter, jaccard_join, secrets, mixing, topk_search, fill_middle, token_counts, source_audit)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
