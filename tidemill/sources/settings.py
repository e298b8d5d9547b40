"""Settings from environment variables: numbers with lower bounds and switches."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# What switches a setting off.
OFF = frozenset({"0", "false", "no"})


@dataclass(frozen=True)
class Settings:
    """Limits of a run. A malformed number is an error."""

    command_timeout: int = 600
    settle_timeout: int = 30
    scroll_delay: float = 0.15
    page_concurrency: int = 8
    page_timeout: int = 120
    export_batch: int = 8
    chunk_bytes: int = 1 << 20
    headless: bool = True

    @staticmethod
    def of(env: Mapping[str, str], prefix: str = "") -> Settings:
        """Of variables named like the fields, in capitals behind ``prefix``; what is not set has its default."""
        default = Settings()
        least = {"page_concurrency": 1, "page_timeout": 10, "export_batch": 1}
        values: dict[str, object] = {}
        for name, old in vars(default).items():
            raw = env.get(prefix + name.upper())
            if raw is None:
                continue
            if isinstance(old, bool):
                values[name] = raw.strip().lower() not in OFF
            else:
                number = type(old)(raw)
                values[name] = max(least[name], number) if name in least else number
        return Settings(**values)
