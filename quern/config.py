"""Settings of the operators, with defaults and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import timedelta

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> timedelta:
    """'5s', '500ms', '1h30m', '-1.5s' -> timedelta."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    if body == "0":
        return timedelta(0)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sign * sum(float(a) * _UNITS[b] for a, b in parts))


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _unit(value: float) -> bool:
    return 0.0 <= value <= 1.0


@dataclass(frozen=True)
class RecordField:
    field: str
    weight: float = 1.0
    required: bool = False
    default: str | None = None

    def __post_init__(self):
        _need(bool(self.field), "a record id field needs a name")
        _need(self.weight >= 0, "weights can't be negative")


@dataclass(frozen=True)
class ContentFilter:
    field: str
    pattern: str
    action: str = "include"
    probability: float = 1.0

    def __post_init__(self):
        _need(bool(self.field and self.pattern), "a content filter needs field and pattern")
        _need(self.action in ("include", "exclude", "weighted"), f"unknown action {self.action!r}")
        _need(self.action != "weighted" or _unit(self.probability), "a weighted filter needs a probability in [0, 1]")


@dataclass(frozen=True)
class CriticalPattern:
    field: str
    pattern: str
    level: int = 1

    def __post_init__(self):
        _need(bool(self.field and self.pattern), "a critical pattern needs field and pattern")
        object.__setattr__(self, "level", max(1, self.level))


@dataclass(frozen=True)
class HeadConfig:
    probability: float = 1.0
    min_p: float = 0.01
    max_p: float = 1.0
    mode: str = "trace_id"
    record_fields: tuple[RecordField, ...] = ()
    filters: tuple[ContentFilter, ...] = ()
    critical: tuple[CriticalPattern, ...] = ()
    tunable_id: str = "head_sampler_traces"

    def __post_init__(self):
        _need(all(map(_unit, (self.probability, self.min_p, self.max_p))), "probabilities lie in [0, 1]")
        _need(self.min_p <= self.max_p, "min_p must not exceed max_p")
        _need(self.mode in ("trace_id", "record_id"), f"unknown hash mode {self.mode!r}")
        _need(self.mode != "record_id" or bool(self.record_fields), "record_id mode needs fields")

    def clamp(self, p: float) -> float:
        return min(max(p, self.min_p), self.max_p)


@dataclass(frozen=True)
class ReservoirConfig:
    k: int = 5000
    window: str = "60s"
    trace_aware: bool = True
    trace_timeout: str = "5s"
    checkpoint_interval: str = "10s"
    close_on_root: bool = False

    def __post_init__(self):
        _need(self.k > 0, "k must be positive")
        for text in (self.window, self.trace_timeout, self.checkpoint_interval):
            _need(parse_duration(text) > timedelta(0), "durations must be positive")


@dataclass(frozen=True)
class TopNConfig:
    n: int = 50
    cpu_threshold: float = 0.01
    memory_threshold: float = 0.01
    idle_ttl: str = "5m"
    max_scanned: int | None = None

    def __post_init__(self):
        _need(self.n > 0, "n must be positive")
        _need(_unit(self.cpu_threshold) and _unit(self.memory_threshold), "thresholds lie in [0, 1]")
        parse_duration(self.idle_ttl)


FETCHABLE = ("command_line", "owner", "io", "executable_path")


@dataclass(frozen=True)
class EnrichConfig:
    enabled: bool = True
    fetch: tuple[str, ...] = FETCHABLE
    strict: bool = False
    critical: tuple[str, ...] = ("process.executable.name", "process.command_line")
    ttl_seconds: int = 300
    owner_ttl_seconds: int = 1800
    path_ttl_seconds: int = 3600
    slow_ms: float = 100.0
    cooldown_seconds: float = 60.0
    slow_limit: int = 3
    reopen_on_failed_probe: bool = False

    def __post_init__(self):
        if not self.enabled:
            return
        _need(set(self.fetch) <= set(FETCHABLE), "unknown attribute to fetch")
        _need(min(self.ttl_seconds, self.owner_ttl_seconds, self.path_ttl_seconds) >= 0, "a TTL can't be negative")


@dataclass(frozen=True)
class ControllerConfig:
    exporters: tuple[str, ...] = field(default_factory=tuple)
    target: str = "head_sampler_traces"
    interval: str = "15s"
    high: float = 0.8
    low: float = 0.2
    up: float = 1.25
    down: float = 0.8
    alpha: float = 0.3
    drop: float = 0.5
    patience: int = 3
    min_p: float = 0.01
    max_p: float = 0.9

    def __post_init__(self):
        _need(0 < self.low < self.high <= 1, "0 < low < high <= 1")
        _need(self.up > 0 and 0 < self.down < 1 and 0 < self.drop < 1, "factors out of range")
        _need(0 < self.alpha <= 1 and self.patience > 0, "alpha or patience out of range")
        _need(bool(self.exporters), "exporters must be named")
        _need(bool(self.target), "a target id is needed")
