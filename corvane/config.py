"""Settings from the environment, with casts."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Prefix of the variables: CORVANE_. Booleans are true as 1, true, yes or on."""

    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    index_dir: str = "data/index"
    code_files: str = "examples.jsonl,tests.jsonl"
    docs_file: str = "docs.jsonl"
    code_collection: str = "code"
    docs_collection: str = "docs"
    dimension: int = 384
    top_k: int = 5
    prefetch: int = 20
    use_hybrid: bool = True
    min_visibility_score: float = 0.0

    def path(self, name: str) -> str:
        return f"{self.raw_dir.rstrip('/')}/{name}"


def read_env_file(path: str | Path = ".env") -> dict[str, str]:
    """NAME=value lines of a file, if it exists; comments and lines without = are skipped, quotes around values are taken off."""
    try:
        lines = Path(path).read_text().splitlines()
    except FileNotFoundError:
        return {}
    pairs = (x.split("=", 1) for x in lines if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, v in pairs}


def load_config(env: dict[str, str] | None = None) -> Config:
    """From env, else from the environment over an .env file."""
    env = read_env_file() | dict(os.environ) if env is None else env
    casts = {"int": int, "float": float, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on"), "str": str}
    return Config(**{f.name: casts[str(f.type)](v) for f in fields(Config) if (v := env.get(f"CORVANE_{f.name.upper()}")) is not None})
