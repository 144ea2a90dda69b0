"""Settings from the environment; command-line options go before them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def is_yes(text: str) -> bool:
    """The reader's vocabulary: four exact words."""
    return text in ("1", "true", "TRUE", "yes")


def is_on(text: str) -> bool:
    """The refresh's vocabulary: four words in any case."""
    return text.lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class ReadSettings:
    """What queries read from."""

    catalog: str | None = None
    memory: str | None = None
    embedding_endpoint: str | None = None
    instances: str | None = None
    local: bool = False


@dataclass(frozen=True)
class RefreshSettings:
    """What a refresh reads and writes, and its limits."""

    registry: str = "registry.json"
    root: str = "refresh"
    embedding_endpoint: str | None = None
    http_timeout: int = 20
    embedding_timeout: int = 30
    max_changed_records: int = 200
    max_deleted_records: int = 25
    staging_local: bool = True
    prod_local: bool = False

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def load(kind: type, env: Mapping[str, str] | None = None, **given):
    """Settings of a kind: given values, else SLATEFLOW_<NAME> of the environment, else the defaults."""
    env = os.environ if env is None else env
    yes = is_yes if kind is ReadSettings else is_on
    out = {k: v for k, v in given.items() if v is not None}
    for f in fields(kind):
        raw = env.get(f"SLATEFLOW_{f.name.upper()}")
        if f.name not in out and raw is not None:
            out[f.name] = yes(raw) if f.type == "bool" else int(raw) if f.type == "int" else raw
    return kind(**out)
