"""Settings with their defaults; the named ones can be set by environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    docs_dir: str = "documents"
    index_dir: str = "index"
    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 5
    max_files: int | None = None
    min_alpha_ratio: float = 0.55
    fetch_factor: int = 10
    rrf_k: int = 60
    alpha: float = 0.5
    embedding_model: str = "hashed-words"
    llm_backend: str = "none"
    llm_model: str = "gemma3:4b"
    llm_host: str = "http://localhost:11434"
    openai_model: str = "gpt-4.1-mini"
    openai_host: str = "https://api.openai.com"
    openai_key: str = field(default="", repr=False)
    claude_model: str = "claude-sonnet-4-5"
    claude_host: str = "https://api.anthropic.com"
    claude_key: str = field(default="", repr=False)

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")


#: Environment names and the settings they fill.
ENVIRONMENT = {
    "LUTRIN_MAX_FILES": "max_files", "LUTRIN_MIN_ALPHA_RATIO": "min_alpha_ratio", "LUTRIN_EMBEDDING_MODEL": "embedding_model",
    "LUTRIN_LLM_BACKEND": "llm_backend", "LUTRIN_LLM_MODEL": "llm_model", "LUTRIN_LLM_HOST": "llm_host",
    "OPENAI_API_KEY": "openai_key", "LUTRIN_OPENAI_MODEL": "openai_model", "LUTRIN_OPENAI_HOST": "openai_host",
    "ANTHROPIC_API_KEY": "claude_key", "LUTRIN_CLAUDE_MODEL": "claude_model", "LUTRIN_CLAUDE_HOST": "claude_host",
}


def load(environment: Mapping[str, str] = os.environ, **overrides) -> Settings:
    types = {"max_files": int, "min_alpha_ratio": float}
    given = {name: types.get(name, str)(environment[key]) for key, name in ENVIRONMENT.items() if environment.get(key)}
    known = {f.name for f in fields(Settings)}
    return replace(Settings(), **given, **{k: v for k, v in overrides.items() if k in known and v is not None})
