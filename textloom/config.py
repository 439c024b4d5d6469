"""Settings of curation and training with their defaults; a YAML file may override them, nested or flat."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class CurationConfig:
    min_words_per_doc: int = 50
    min_sentences_per_doc: int = 2
    min_quality_score: float = 0.25
    fuzzy_dedup_threshold: float = 0.85
    semantic_dedup_threshold: float = 0.80
    semantic: bool = True
    domain_relevance_threshold: float = 0.1
    domain_boost: float = 1.2
    enable_pii_removal: bool = True
    #: "redacted" or "original": which text the training rows carry.
    text_source: str = "redacted"


@dataclass(frozen=True)
class VocabularyConfig:
    enable: bool = True
    min_frequency: int = 200
    max_tokens: int | None = None
    sample_limit: int = 500
    #: Tokens to add by hand where the vocabulary lacks them.
    manual_tokens: tuple[str, ...] = ("pytorch", "tensorflow", "cuda", "gpu", "transformer", "bert", "llama")


def load(kind: type, path: str | None = None, section: str | None = None):
    """kind with what the file (or its section, or the file's top level) says about it."""
    if path is None or not Path(path).exists():
        return kind()
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    data = {**data, **(data.get(section) or {})} if section else data
    return kind(**{f.name: data[f.name] for f in fields(kind) if f.name in data})
