"""Parameters of a question, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QueryParam:
    mode: str = "mix"
    top_k: int = 10
    chunk_top_k: int = 20
    kg_pick_method: str = "ENTITY_OVERLAP"
    kg_chunk_top_k: int = 2000
    max_related_chunks: int = 5
    min_related_chunks: int = 1
    cosine_threshold: float = 0.5
    candidate_top_k: int = 2000
    num_query_expansions: int = 5
    min_intersection_size: int = 100
    high_similarity_threshold: float = 0.7
    max_hyde: int = 5
    max_subqueries: int = 5
    graph_hops: int = 1
    graph_per_hop: int = 20
    min_paper_support: float = 0.1
    rerank_min_score: float = 0.5
    stage1_top_k: int = 1024
    stage1_min_score: float = 0.5
    stage2_min_score: float = 0.5
    score_aggregation: str = "max"
    entity_min_score: float = 0.4
    max_entities: int = 200
    ngram_min: int = 1
    ngram_max: int = 5
    ngram_min_similarity: float = 0.85
    max_pct_paper: float | None = 25
    max_pct_chunk: float | None = 25
    max_text_variations: int | None = 50_000
    shuffles: int = 200
    vote_threshold: float = 0.25
    vote_min_similarity: float = 0.5
    vote_top_k: int = 5
    es_top_k: int = 5000
    es_top_k_per_query: int = 1000
    milvus_top_k: int = 5000
    merged_top_k: int = 5000
    rrf_k: int = 60
    max_total_tokens: int = 30_000
    description_length: int = 300
    expand_documents: bool = True
    entities_only: bool = False
