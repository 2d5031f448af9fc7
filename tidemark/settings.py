"""Options from the environment, with defaults. Where no folder is named, it lies in the one that driver and executors share."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "TIDEMARK_"


@dataclass(frozen=True)
class Settings:
    backend: str = "memory"
    path: str = ""
    servers: str = ""
    checkpoints: str = ""
    batch_size: int = 10
    max_retries: int = 3
    min_idle_ms: int = 60_000
    partitions: int = 4
    segment_rows: int = 1_000_000
    log_format: str = "text"

    def options(self, backend: str) -> dict[str, str]:
        """What a backend takes from the settings."""
        if backend in ("file", "log"):
            return {"path": self.path} if self.path else {}
        if backend == "kafka":
            return {"servers": self.servers}
        if backend == "redis":
            host, _, port = (self.servers or "127.0.0.1:6379").partition(":")
            return {"host": host, "port": port or "6379"}
        return {}

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {f.name: env[PREFIX + f.name.upper()] for f in fields(cls) if PREFIX + f.name.upper() in env}
        return cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in found.items()})
