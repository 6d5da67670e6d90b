"""Settings of retrieval and serving, read once on the driver and passed on as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def _flag(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    top_k: int = 8
    min_similarity: float = 0.30
    use_hybrid: bool = True
    rrf_k: int = 60
    recency_boost: float = 0.01
    row_weight: float = 1.0
    period_boost: float = 0.02
    focus_query: bool = True
    common_term_ratio: float = 0.5
    use_reranker: bool = False
    rerank_candidates: int = 25
    rerank_rrf_k: int = 10
    max_question_chars: int = 1000
    rate_limit_per_minute: int = 30
    cache_size: int = 128
    chunk_max_tokens: int = 350
    chunk_overlap_tokens: int = 60
    row_chunks: bool = True
    ocr_threshold: int = 50
    query_prefix: str = ""  # what an embedding model wants before a question

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings from upper-case variables; a bad value is an error that names its variable."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            name = f.name.upper()
            if name not in env or f.name in ("chunk_max_tokens", "chunk_overlap_tokens", "ocr_threshold"):
                continue
            kind = type(f.default)
            try:
                found[f.name] = _flag(env[name]) if kind is bool else kind(env[name])
            except ValueError:
                raise ValueError(f"{name} must be {'an integer' if kind is int else 'a number'}, not {env[name]!r}") from None
        return cls(**found)
