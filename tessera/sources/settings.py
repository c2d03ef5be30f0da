"""Service settings from the environment or an .env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Every value is required; names are case-sensitive."""

    APP_NAME: str
    APP_VERSION: str
    DEBUG: bool
    POSTGRES_HOST: str
    POSTGRES_PORT: int
    POSTGRES_DB: str
    POSTGRES_USER: str
    POSTGRES_PASSWORD: str
    NEO4J_URI: str
    NEO4J_USERNAME: str
    NEO4J_PASSWORD: str
    QDRANT_HOST: str
    QDRANT_PORT: int

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | Path = ".env") -> Settings:
        """The environment goes before the file; what is missing or malformed is a ValueError."""
        values: dict[str, str] = {}
        if Path(env_file).is_file():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    values[name.strip()] = value.strip().strip("\"'")
        values |= os.environ if env is None else env
        missing = [f.name for f in fields(cls) if f.name not in values]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        return cls(**{f.name: _typed(f.name, str(f.type), values[f.name]) for f in fields(cls)})


def _typed(name: str, kind: str, value: str) -> str | int | bool:
    if kind == "int":
        return int(value)
    if kind == "bool":
        if value.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"{name} is not a truth value: {value}")
        return value.lower() in ("true", "1", "yes", "on")
    return value
