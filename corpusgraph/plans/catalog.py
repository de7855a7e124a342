"""All registered queries of the library and their SQL."""

from . import concept_queries, corpus_queries, frame_queries, graph_queries, merge_queries, passage_queries, position_queries, retrieval_queries, upkeep_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "distill_stats"
