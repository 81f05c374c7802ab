"""Settings: process environment over an env file over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "HASHLODE_"


def switch(value: str | None, default: bool) -> bool:
    """0/false/off/no, 1/true/on/yes in any case and spacing; anything else is the default (C17)."""
    word = (value or "").strip().lower()
    return True if word in ("1", "true", "on", "yes") else False if word in ("0", "false", "off", "no") else default


def whole(value: str | None, default: int) -> int:
    """A bad or negative number is silently the default."""
    try:
        n = int((value or "").strip())
    except ValueError:
        return default
    return n if n >= 0 else default


def listed(value: str | None, default: tuple[str, ...]) -> tuple[str, ...]:
    """Comma-separated, trimmed, empty items dropped; the default if nothing is left."""
    return tuple(x.strip() for x in (value or "").split(",") if x.strip()) or default


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    web_port: int = 3000
    known_nodes_cap: int = 10_000
    seen_rotate_secs: int = 15 * 60
    samples_per_message: int = 256
    worklist_limit: int = 200
    peers_per_hash: int = 64
    popularity_cap: int = 50
    query_timeout_ms: int = 900
    cleanup_enabled: bool = True
    cleanup_batch: int = 5_000
    ttl_secs: int = 24 * 60 * 60
    low_seed_grace_secs: int = 20 * 60
    max_records: int = 0
    bootstrap: tuple[str, ...] = ()

    @classmethod
    def load(cls, env_file: str | None = None, environ: dict[str, str] | None = None) -> Config:
        found: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            with open(env_file) as f:
                pairs = (line.split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
                found = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
        found |= environ if environ is not None else dict(os.environ)
        read = {bool: switch, int: whole, tuple: listed, str: lambda v, d: v if v and v.strip() else d}
        return cls(**{f.name: read[type(f.default)](found.get(PREFIX + f.name.upper()), f.default) for f in fields(cls)})
