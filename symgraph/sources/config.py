"""Layered configuration: defaults, user, repository, environment; what comes later and is set wins."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

# fixed values: defaults, and the models of each memory tier
DEFAULTS = {"endpoint": "http://127.0.0.1:11434", "embedder": {"model": "embeddinggemma", "dimension": 768}, "synthesizer": None, "reranker": None, "concurrency": 4}
TIERS = {"minimal": None, "balanced": "qwen2.5-coder:3b", "max": "qwen2.5-coder:7b"}


def merge(*layers: dict) -> dict:
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merge(out[k], v)
            elif v is not None:
                out[k] = v
            else:
                out.setdefault(k, None)
    return out


def memory_gb() -> float | None:
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    except (ValueError, OSError):
        return None


def tier_of(gb: float | None) -> str:
    return "balanced" if gb is None else "minimal" if gb < 12 else "balanced" if gb < 24 else "max"


def load(repo: str | None = None, user: str | None = None, env: dict | None = None) -> dict:
    env = os.environ if env is None else env
    layers = [DEFAULTS, {"synthesizer": TIERS[tier_of(memory_gb())]}]
    for p in (user, f"{repo}/.symgraph.toml" if repo else None):
        if p and Path(p).is_file():
            layers.append(tomllib.loads(Path(p).read_text()))
    layers.append({"endpoint": env.get("SYMGRAPH_ENDPOINT"), "synthesizer": env.get("SYMGRAPH_SYNTHESIZER")})
    return merge(*layers)
