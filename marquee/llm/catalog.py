"""Importing this module gathers the queries of the operators in this package."""

from marquee.llm import (
    bpe, exact_dedup, filter_audit, jaccard, language, line_dedup, lm_scoring, neighbours, packing,
    sentencepieces, sharding, spelling, toxicity,
)

MODULES = (toxicity, language, neighbours, bpe, packing, lm_scoring, sharding, exact_dedup, line_dedup,
           jaccard, filter_audit, sentencepieces, spelling)
QUERIES = {name: query for module in MODULES for name, query in module.REGISTRY.queries.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.REGISTRY.oracles.items()}
