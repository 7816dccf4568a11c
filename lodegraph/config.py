"""Settings and errors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .functions.languages import DEFAULT_IGNORES


class LodegraphError(Exception):
    """The root of this library's errors."""


class InvalidPath(LodegraphError):
    pass


class IndexNotFound(LodegraphError):
    pass


class QueryError(LodegraphError):
    pass


class ConfigError(LodegraphError):
    pass


@dataclass(frozen=True)
class Config:
    """What an index is built and searched with."""

    watched_dirs: tuple[str, ...] = ()
    ignore_patterns: tuple[str, ...] = field(default=DEFAULT_IGNORES)
    k1: float = 1.2
    b: float = 0.75
    dim: int = 384
    limit: int = 10
    rrf_k: int = 60
    snippet_lines: int = 6
    surface: str = "library"

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            d = json.loads(Path(path).read_text())
            return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
        except (OSError, ValueError, TypeError) as e:
            raise ConfigError(f"{path}: {e}") from e
