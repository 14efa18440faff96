"""All queries of the subpackage."""

from __future__ import annotations

import corpus_pipeline
from loomtrail.llm import alignment_queries, archives_queries, prefix_trie_queries  # noqa: F401
from loomtrail.llm import fingerprints_queries, html_text_queries, licenses_queries, near_dedup_queries, packing_queries, pii_queries, quality_queries, subwords_queries, tokenfiles_queries, url_filters_queries  # noqa: F401
from loomtrail.llm.registry import ORACLES, QUERIES, Query, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
