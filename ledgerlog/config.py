"""Configuration in layers: command line over environment over file over defaults."""

from __future__ import annotations

import ipaddress
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from .model import FlushMode

PREFIX = "LEDGERLOG_"
FILE_NAME = "ledgerlog.toml"
MIB = 1 << 20


class ConfigError(ValueError):
    def __init__(self, name: str, message: str):
        super().__init__(f"{name}: {message}")
        self.name = name


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    memtable_flush_threshold: int = 4 * MIB
    compaction_threshold: int = 4
    compaction_enabled: bool = True
    flush_mode: FlushMode = FlushMode.CAUTIOUS
    segment_size: int = 16 * MIB
    channel_capacity: int = 1024
    stdin: bool = False
    files: tuple[str, ...] = field(default=())
    tcp: tuple[str, ...] = field(default=())
    udp: tuple[str, ...] = field(default=())

    @property
    def has_source(self) -> bool:
        return bool(self.stdin or self.files or self.tcp or self.udp)

    def check(self) -> Config:
        if self.memtable_flush_threshold < MIB:
            raise ConfigError("memtable_flush_threshold_mib", "must be at least 1")
        if self.compaction_threshold < 2:
            raise ConfigError("compaction_threshold", "must be at least 2")
        if self.segment_size < MIB:
            raise ConfigError("segment_size_mib", "must be at least 1")
        if self.segment_size % 4096:
            raise ConfigError("segment_size_mib", "must be whole sectors of 4096 bytes")
        if self.channel_capacity < 1:
            raise ConfigError("channel_capacity", "must be at least 1")
        for name in ("tcp", "udp"):
            for address in getattr(self, name):
                parse_address(address, name)
        return self


def parse_address(text: str, name: str = "address") -> tuple[str, int]:
    """Host and port of `127.0.0.1:5000` or `[::1]:5000`."""
    host, _, port = text.rpartition(":")
    bare = host[1:-1] if host.startswith("[") and host.endswith("]") else host
    try:
        known = ipaddress.ip_address(bare)
        number = int(port) if port.isascii() and port.isdigit() else -1
    except ValueError:
        known, number = None, -1
    if known is None or not 0 <= number < 65536 or (known.version == 6) != host.startswith("["):
        raise ConfigError(name, f"invalid address: {text!r}")
    return bare, number


def parse_bool(text: str) -> bool | None:
    return {**dict.fromkeys(["true", "1", "yes", "on"], True), **dict.fromkeys(["false", "0", "no", "off"], False)}.get(text.lower())


def expand_path(text: str) -> str:
    """A leading `~` alone, or before a slash, is the home folder."""
    return str(Path.home()) + text[1:] if text == "~" or text.startswith("~/") else text


def _mode(text: str) -> FlushMode | None:
    try:
        return FlushMode.parse(text)
    except ValueError:
        return None


#: section and key of the file → (field, what makes its value)
_FILE: dict[tuple[str, str], tuple[str, Any]] = {
    ("storage", "memtable_flush_threshold_mib"): ("memtable_flush_threshold", lambda v: v * MIB),
    ("storage", "compaction_threshold"): ("compaction_threshold", int),
    ("storage", "compaction_enabled"): ("compaction_enabled", bool),
    ("wal", "flush_mode"): ("flush_mode", _mode),
    ("wal", "segment_size_mib"): ("segment_size", lambda v: v * MIB),
    ("ingester", "channel_capacity"): ("channel_capacity", int),
    ("sources", "stdin"): ("stdin", bool),
    ("sources", "files"): ("files", lambda v: tuple(map(expand_path, v))),
    ("sources", "tcp"): ("tcp", tuple),
    ("sources", "udp"): ("udp", tuple),
}


def from_file(path: str) -> dict[str, Any]:
    """Settings of a TOML file; a section or key that is not known is an error."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    out: dict[str, Any] = {}
    sections = {s for s, _ in _FILE}
    for section, content in raw.items():
        if section not in sections or not isinstance(content, dict):
            raise ConfigError(section, "unknown section")
        for key, value in content.items():
            if (section, key) not in _FILE:
                raise ConfigError(f"{section}.{key}", "unknown key")
            name, make = _FILE[section, key]
            if (made := make(value)) is not None:
                out[name] = made
    return out


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def from_environment(env: Mapping[str, str] = os.environ) -> dict[str, Any]:
    """Settings of the environment; a value that can't be read counts as not given."""
    listed = lambda v: tuple(x for x in v.split(",") if x)
    readers = {
        "DATA_DIR": ("data_dir", expand_path),
        "MEMTABLE_FLUSH_THRESHOLD_MIB": ("memtable_flush_threshold", lambda v: None if (n := _number(v)) is None else n * MIB),
        "COMPACTION_THRESHOLD": ("compaction_threshold", _number),
        "COMPACTION_ENABLED": ("compaction_enabled", parse_bool),
        "FLUSH_MODE": ("flush_mode", _mode),
        "SEGMENT_SIZE_MIB": ("segment_size", lambda v: None if (n := _number(v)) is None else n * MIB),
        "CHANNEL_CAPACITY": ("channel_capacity", _number),
        "STDIN": ("stdin", parse_bool),
        "FILES": ("files", lambda v: tuple(map(expand_path, listed(v)))),
        "TCP": ("tcp", listed),
        "UDP": ("udp", listed),
    }
    out = {}
    for key, (name, make) in readers.items():
        if (text := env.get(PREFIX + key)) is not None and (value := make(text)) is not None:
            out[name] = value
    return out


def load(given: Mapping[str, Any] | None = None, config_file: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """The merged configuration, checked; ``given`` comes from the command line, None standing for not given."""
    given = {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := given.keys() - {f.name for f in fields(Config)}:
        raise ConfigError(sorted(unknown)[0], "unknown setting")
    path = config_file or (str(Path(given["data_dir"], FILE_NAME)) if "data_dir" in given else None)
    layers = [from_file(path) if path and Path(path).exists() else {}, from_environment(env), given]
    config = Config()
    for layer in layers:
        config = replace(config, **layer)
    return config.check()
