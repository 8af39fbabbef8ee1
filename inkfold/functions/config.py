"""Thresholds of all stages in one place; JSON overrides are merged deeply, bad JSON leaves the defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    max_chars: int = 50_000
    short_words: int = 1000
    segment_words: int = 800
    overlap_sentences: int = 2
    chunk_chars: int = 200
    useful_std: float = 0.03
    z_clean: float = 1.5
    z_medium: float = 1.0
    z_high: float = -1.0
    human_score: float = 0.35
    human_score_soft: float = 0.45
    human_clean_ratio: float = 0.70
    viable_sem: float = 0.5
    least_words: int = 5
    length_from_words: int = 20
    length_change: float = 0.40
    retry_improvement: float = 0.15
    retry_score: float = 0.25
    rewrite_sem: float = 0.65
    delete_sem: float = 0.85
    formality_slack: float = 0.05


def deep_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | None = None) -> Config:
    """The defaults, overridden by the JSON object at ``path`` if there is one that can be read."""
    values = asdict(Config())
    if path and Path(path).exists():
        try:
            found = json.loads(Path(path).read_text())
        except ValueError:
            found = {}
        if isinstance(found, dict):
            values = deep_merge(values, found)
    return Config(**{f.name: values[f.name] for f in fields(Config)})


DEFAULT = Config()
