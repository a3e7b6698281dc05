"""Imports every operator of the subpackage, so that its query is registered."""

import importlib

from voltlane.llm.common import QUERIES, SQL  # noqa: F401

OPERATORS = (
    "quality_rules", "mixing", "embedding_dedup", "url_filter", "quality_classifier", "bpe", "toxicity", "ngram_model", "token_counts", "minhash_dedup",
    "centroids", "byte_bpe", "divergence",
)
for _name in OPERATORS:
    importlib.import_module(f"voltlane.llm.{_name}")
