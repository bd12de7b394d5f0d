"""Settings of an index and a search, from defaults and the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from .operators.fusion import check_limit, check_weight


@dataclass(frozen=True)
class Settings:
    content: str = "content"
    formats: tuple[str, ...] = ("md",)
    ignore: tuple[str, ...] = ()
    chunk_size: int = 512
    chunk_overlap: float = 0.15
    embedding_dims: int = 384
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    per_retriever: int = 30
    candidates: int = 30
    final: int = 10
    rrf_k: float = 10.0
    path_boost: float = 2.0
    heading_boost: float = 1.0
    dedup_by_page: bool = True
    lexical_tie_break: bool = False
    history_keep: int = 50
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("per_retriever", "candidates", "final", "chunk_size", "embedding_dims"):
            check_limit(name, getattr(self, name))
        for name in ("bm25_weight", "vector_weight", "rrf_k"):
            check_weight(name, getattr(self, name))
        if not 0 <= self.chunk_overlap <= 0.5:
            raise ValueError("chunk_overlap must be between 0 and 0.5")


def read_env(text: str) -> dict[str, str]:
    """KEY=value lines of an env file; quotes around a value go, comments and other lines are skipped."""
    pairs = (line.strip().removeprefix("export ").partition("=") for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip()[1:-1] if len(v.strip()) > 1 and v.strip()[0] in "'\"" and v.strip()[-1] == v.strip()[0] else v.strip() for k, _, v in pairs}


def _typed(name: str, raw, default):
    """A setting from text or JSON, in the type of its default."""
    try:
        if isinstance(default, bool):
            return raw if isinstance(raw, bool) else {"true": True, "1": True, "false": False, "0": False}[raw.strip().lower()]
        if isinstance(default, tuple):
            return tuple(x.strip() for x in raw.split(",") if x.strip()) if isinstance(raw, str) else tuple(raw)
        return type(default)(raw)
    except (ValueError, KeyError, TypeError):
        raise ValueError(f"{name}: not a {type(default).__name__}: {raw!r}") from None


def load_settings(env: Mapping[str, str] | None = None, file: str | None = None, **given) -> Settings:
    """Given values over LEXILOOM_<NAME> variables over a JSON ``file`` of settings over the defaults; unknown names in the file are an error."""
    env = os.environ if env is None else env
    defaults = {f.name: getattr(Settings(), f.name) for f in fields(Settings) if f.name != "extra"}
    found: dict = {}
    if file:
        with open(file, encoding="utf-8") as f:
            held = json.load(f)
        if unknown := sorted(set(held) - set(defaults)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        found |= {k: _typed(k, v, defaults[k]) for k, v in held.items()}
    found |= {k: _typed(k, env[f"LEXILOOM_{k.upper()}"], v) for k, v in defaults.items() if env.get(f"LEXILOOM_{k.upper()}")}
    return Settings(**(found | given))


def capabilities() -> dict:
    """What this engine can do, as data."""
    from . import __version__
    from .sources.markdown import FORMATS

    return {
        "version": __version__, "formats": sorted(FORMATS), "built_in_formats": ["csv", "md"], "retrievers": ["bm25", "vector"], "fusion": "weighted_rrf",
        "features": ["boosts", "dedup_by_page", "evaluation", "evidence", "health", "history", "incremental_index", "lexical_tie_break", "metadata_filters", "snippets", "streaming_changes"],
    }
