"""Retrieval end to end as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.memory import format_context
from quarry.operators.retrieval import hybrid_search, rerank, top_k


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top: int = 3, relevance: DataFrame | None = None) -> DataFrame:
    """queries(query_id, text, embedding) -> query_id, doc_id, rank, score.

    With a table relevance(query_id, doc_id, relevance) three times as many hits are fetched and reranked; each side of
    the hybrid search looks three times further again.
    """
    wanted = 3 * top if relevance is not None else top
    hits = hybrid_search(docs, vectors, queries, wanted, candidate_k=3 * wanted)
    if relevance is None:
        return hits.select("query_id", "doc_id", "rank", "score")
    return rerank(hits.select("query_id", "doc_id", "rank"), relevance, top).select("query_id", "doc_id", "rank", F.col("relevance").alias("score"))


def answer_context(docs: DataFrame, hits: DataFrame, top: int = 3) -> DataFrame:
    """The context text of each query's best hits."""
    rows = hits.select("query_id", "doc_id", "rank").join(docs.select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    return format_context(top_k(rows, top, "rank"))
