"""Tunables that are part of operator semantics, with their cross-field rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Chunking, in estimated tokens.
    chunk_target_tokens: int = 512
    chunk_max_tokens: int = 768
    chunk_overlap_tokens: int = 64
    # Embedding and reranking.
    embed_batch_size: int = 96
    rerank_top_n: int = 50
    # Fusion.
    rrf_k: int = 60
    top_n: int = 40
    top_k: int = 8
    vector_weight: float = 1.0
    lexical_weight: float = 0.5
    similarity_threshold: float = 0.15
    # A fused score never exceeds (vector_weight + lexical_weight) / (rrf_k + 1),
    # about 0.0246 here, so both floors sit below that; see the README.
    cross_lingual_floor: float = 0.02
    decline_recall_floor: float = 0.001
    decline_gate_enabled: bool = True
    # Confidence tiers.
    confidence_high: float = 0.85
    confidence_medium: float = 0.60
    confidence_keep: float = 0.40
    # Cost guard, USD.
    cost_per_1k_input: float = 0.003
    cost_per_1k_output: float = 0.015
    cost_ceiling: float = 0.10
    max_output_tokens: int = 2048
    # Time windows, seconds.
    cache_ttl_seconds: int = 86_400
    rate_limit_max: int = 20
    rate_limit_seconds: int = 60
    # Active versions.
    disclaimer_version: str = "v1"
    decline_version: str = "v1"
    prompt_version: str = "v2"
    # Physical knobs: results do not depend on them.
    salts: int = 16
    query_block_rows: int = 1024
    chunk_columns: int = 64
    cell_bytes: int = 262_144
    first_blocks: int = 8
    common_share: int = 32

    def __post_init__(self) -> None:
        rules = [
            (self.chunk_max_tokens >= self.chunk_target_tokens,
             "chunk_max_tokens must be >= chunk_target_tokens"),
            (self.chunk_overlap_tokens < self.chunk_target_tokens,
             "chunk_overlap_tokens must be < chunk_target_tokens"),
            (self.top_k <= self.top_n, "top_k must be <= top_n"),
            (self.vector_weight > 0 or self.lexical_weight > 0,
             "one of vector_weight and lexical_weight must be > 0"),
            (self.confidence_medium <= self.confidence_high,
             "confidence_medium must be <= confidence_high"),
            (self.confidence_keep <= self.confidence_medium,
             "confidence_keep must be <= confidence_medium"),
            (min(self.vector_weight, self.lexical_weight) >= 0, "weights must be >= 0"),
            (min(self.salts, self.query_block_rows, self.chunk_columns, self.cell_bytes) >= 1,
             "salts, query_block_rows, chunk_columns and cell_bytes must be >= 1"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)
