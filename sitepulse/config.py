"""Settings of the engine: defaults, then a TOML file, then the environment, then the privacy bundle."""

from __future__ import annotations

import os
import tomllib
import uuid
from dataclasses import dataclass, fields, replace
from pathlib import Path

PRECISIONS = ("none", "country", "region", "city")


@dataclass(frozen=True)
class EngineConfig:
    allowed_sites: tuple[str, ...] = ()
    filter_bots: bool = True
    strip_referrer_query: bool = False
    round_timestamps: bool = False
    suppress_visitor_id: bool = False
    suppress_browser_version: bool = False
    suppress_os_version: bool = False
    suppress_screen_size: bool = False
    geoip_precision: str = "city"
    gdpr_mode: bool = False
    flush_interval_secs: int = 60
    flush_event_count: int = 1000
    rate_limit_per_site: int = 0
    cache_ttl_secs: int = 60
    cache_max_entries: int = 10_000
    retention_days: int = 0
    max_concurrent_queries: int = 10

    def resolved(self) -> EngineConfig:
        """With what ``gdpr_mode`` forces on; precisions finer than country fall back to it only from city."""
        if self.geoip_precision not in PRECISIONS:
            raise ValueError(f"geoip_precision is one of {PRECISIONS}")
        if not self.gdpr_mode:
            return self
        return replace(
            self,
            strip_referrer_query=True,
            round_timestamps=True,
            suppress_browser_version=True,
            suppress_os_version=True,
            suppress_screen_size=True,
            geoip_precision="country" if self.geoip_precision == "city" else self.geoip_precision,
        )


def _parse(value, default):
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, int):
        return int(value)
    if isinstance(default, tuple):
        return tuple(value) if isinstance(value, (list, tuple)) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    return str(value)


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "SITEPULSE_") -> EngineConfig:
    """Settings from ``path`` and from variables such as SITEPULSE_FILTER_BOTS, which win."""
    env = dict(os.environ) if env is None else env
    given = tomllib.loads(Path(path).read_text()) if path else {}
    known = {f.name: f.default for f in fields(EngineConfig)}
    given = {k: v for k, v in given.items() if k in known}
    given |= {k: env[prefix + k.upper()] for k in known if prefix + k.upper() in env}
    return EngineConfig(**{k: _parse(v, known[k]) for k, v in given.items()}).resolved()


def load_secret(path: str, env: dict[str, str] | None = None, name: str = "SITEPULSE_SECRET") -> str:
    """The visitor secret from the environment, else from ``path``, else a new one, which is saved there.

    It stays at the driver; plans carry only the day's salt.
    """
    env = dict(os.environ) if env is None else env
    if env.get(name):
        return env[name]
    file = Path(path)
    if file.exists() and (found := file.read_text().strip()):
        return found
    secret = str(uuid.uuid4())
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(secret)
    file.chmod(0o600)
    return secret
