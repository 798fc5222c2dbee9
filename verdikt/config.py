"""Settings of a scan, with the values that hold where none is given."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import NamedTuple


class Feed(NamedTuple):
    name: str
    format: str = "text"
    refresh: str = "full"
    enabled: bool = True
    url: str = ""
    header_name: str = ""
    header_value: str = ""

    def check(self) -> None:
        if self.format not in ("text", "zip") or self.refresh not in ("full", "incremental", "append"):
            raise ValueError(f"feed {self.name}: format {self.format}, refresh {self.refresh}")
        if self.refresh == "append" and "%" not in self.url:
            raise ValueError(f"feed {self.name}: an append feed's url needs a place for the shard's number")


#: Names, formats and refresh modes of the feeds; urls and keys are the user's.
FEEDS = (
    Feed("malwarebazaar-full", "zip", "full"),
    Feed("malwarebazaar-recent", "text", "incremental"),
    Feed("threatfox-full", "zip", "full"),
    Feed("threatfox-recent", "text", "incremental"),
    Feed("urlhaus-payloads", "zip", "full"),
    Feed("virusshare", "text", "append", enabled=False, url="%05d"),
)

_UNITS = {"h": 3600, "m": 60, "s": 1, "ms": 0.001, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def seconds(value: str | float) -> float:
    """'1h30m' or a bare number of seconds."""
    if not isinstance(value, str):
        return float(value)
    parts = re.findall(r"(\d+(?:\.\d*)?)(h|ms|us|µs|ns|m|s)", value)
    if not parts or "".join(a + b for a, b in parts) != value.strip():
        raise ValueError(f"bad duration {value!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Config:
    """Values that make no sense (a depth, ratio or threshold under 1) count as the defaults."""

    max_file_size: int = 256 << 20
    max_total_extract: int = 1 << 30
    max_archive_depth: int = 6
    max_archive_files: int = 20_000
    max_compress_ratio: int = 100
    heuristics: bool = True
    threshold: int = 100
    unscannable: str = "error"
    require_signatures: bool = True
    max_signature_age: float = 86_400
    update_interval: float = 3_600
    full_refresh_interval: float = 7 * 86_400
    clamav: str = "off"
    clamav_address: str = ""
    clamav_timeout: float = 60
    feeds: tuple[Feed, ...] = field(default=FEEDS)

    def __post_init__(self):
        for name, default in (("max_archive_depth", 6), ("max_compress_ratio", 100), ("threshold", 100)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)
        if self.unscannable not in ("error", "malicious"):
            raise ValueError(f"unscannable: {self.unscannable}")
        if self.clamav not in ("off", "auto", "required"):
            raise ValueError(f"clamav: {self.clamav}")
        for feed in self.feeds:
            feed.check()

    @property
    def enabled_sources(self) -> list[str]:
        return [f.name for f in self.feeds if f.enabled]


#: Folders of a system-wide installation: settings, data.
SYSTEM = (Path("/etc/verdikt"), Path("/var/lib/verdikt"))
FILE = "config.json"


def _user(variable: str, fallback: str) -> Path:
    return Path(os.environ.get(variable) or Path.home() / fallback) / "verdikt"


def config_path(explicit: str | None = None, system: tuple[Path, Path] = SYSTEM, root: bool | None = None) -> Path:
    """Which file holds the settings: the one named, $VERDIKT_CONFIG, the system's if it is there or root runs, the user's.

    Without either file it is the system's where its data are there, so that a table
    that root keeps is shared, else the user's.
    """
    if named := explicit or os.environ.get("VERDIKT_CONFIG"):
        return Path(named)
    root = os.geteuid() == 0 if root is None else root
    shared, own = system[0] / FILE, _user("XDG_CONFIG_HOME", ".config") / FILE
    if shared.exists() or root:
        return shared
    return shared if not own.exists() and system[1].exists() else own


def data_folder(config: Path, system: tuple[Path, Path] = SYSTEM, root: bool | None = None) -> Path:
    """Where the signature table is kept if no folder is named."""
    root = os.geteuid() == 0 if root is None else root
    return system[1] if root or config.parent == system[0] else _user("XDG_DATA_HOME", ".local/share")


def load(path: str | Path) -> Config:
    """The settings of a JSON file; defaults where it is missing."""
    if not Path(path).exists():
        return Config()
    raw = json.loads(Path(path).read_text())
    known = {f.name for f in fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name in ("max_signature_age", "update_interval", "full_refresh_interval", "clamav_timeout"):
        if name in raw:
            raw[name] = seconds(raw[name])
    if "feeds" in raw:
        raw["feeds"] = tuple(Feed(**f) for f in raw["feeds"])
    return Config(**raw)
