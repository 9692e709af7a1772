"""Settings from a TOML file; a missing file gives the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    warehouse: str = "warehouse"
    accounts: tuple[dict, ...] = field(default_factory=tuple)

    @classmethod
    def from_file(cls, path: str = "config.toml") -> Settings:
        if not Path(path).exists():
            return cls()
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        accounts = tuple({**a, "guilds": [str(g) for g in a.get("guilds", [])]} for a in data.get("accounts", []))
        return cls(data.get("warehouse", cls.warehouse), accounts)
