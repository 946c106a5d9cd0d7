"""Settings of indexing and search, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from marlstone.operators.fusion import SearchWeights


@dataclass(frozen=True)
class ChunkingConfig:
    """min_tokens and max_paragraphs are accepted for old settings and have no effect."""

    max_tokens: int = 8192
    stride_tokens: int = 256
    min_tokens: int = 1
    max_paragraphs: int = 1

    def __post_init__(self):
        if min(self.max_tokens, self.stride_tokens, self.min_tokens, self.max_paragraphs) <= 0:
            raise ValueError("sizes must be positive")
        if self.stride_tokens >= self.max_tokens:
            raise ValueError("stride_tokens must be smaller than max_tokens")


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 20
    weights: SearchWeights = field(default_factory=SearchWeights)
    bm25_scope: str = "global"

    def __post_init__(self):
        if self.top_k <= 0 or self.bm25_scope not in ("global", "partition"):
            raise ValueError("top_k must be positive, bm25_scope global or partition")


@dataclass(frozen=True)
class Config:
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
