"""Defaults of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Weights, limits and bounds that callers may override."""

    dense_weight: float = 1.0
    sparse_weight: float = 0.8
    rrf_k: int = 60
    prefetch_limit: int = 50
    fuzzy_threshold: float = 0.75
    min_token_length: int = 2
    reindex_growth: float = 0.10
    scroll_cap: int = 100_000
    graph_depth: int = 10
    graph_visited: int = 10_000
    max_file_size_kb: int = 1024
    embedding_batch: int = 8

    def __post_init__(self) -> None:
        if self.dense_weight <= 0 and self.sparse_weight <= 0:
            raise ValueError("dense_weight or sparse_weight must be above 0")


DEFAULTS = Settings()
