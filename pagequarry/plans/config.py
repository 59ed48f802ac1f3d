"""Configuration and policies: frozen dataclasses with checks, overlays from JSON, YAML or maps, versions and hot change detection.

(CFG-01 to CFG-03, POL-06, POL-07, POL-12, POL-14, POL-16, POL-18, SRC-11 to SRC-14, OBS-10, STR-15, STR-17.)
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class CrawlPolicy:
    """Domains (domain -> allowed), links, selectors and delays."""

    allowed: dict[str, bool] = dataclasses.field(default_factory=dict)
    max_depth: int = 10
    max_pages: int = 1000
    follow_external: bool = False
    default_selectors: tuple[str, ...] = ("main", "article", ".content")
    site_selectors: dict[str, tuple[str, ...]] = dataclasses.field(default_factory=dict)
    default_delay: float = 1.0
    site_delays: dict[str, float] = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        if self.max_depth < 0 or self.max_pages < 0:
            raise ConfigError("max_depth and max_pages must not be negative")

    def selectors(self, host: str) -> tuple[str, ...]:
        """POL-05."""
        return self.site_selectors.get(host, self.default_selectors)

    def delay(self, host: str) -> float:
        """POL-05."""
        return self.site_delays.get(host, self.default_delay)

    def table(self, spark):
        """POL-06: the dimension table that decisions join."""
        return spark.createDataFrame(sorted(self.allowed.items()), "domain string, allowed boolean")


@dataclasses.dataclass(frozen=True)
class ProcessingPolicy:
    quality_threshold: float = 0.0
    metadata_extraction: bool = True
    image_extraction: bool = True
    markdown_conversion: bool = True
    content_validation: bool = True

    def __post_init__(self):
        if not 0 <= self.quality_threshold <= 1:
            raise ConfigError("quality_threshold must be between 0 and 1")


@dataclasses.dataclass(frozen=True)
class OutputPolicy:
    default_format: str = "markdown"
    formats: tuple[str, ...] = ("markdown", "html", "json")
    routes: tuple[tuple[str, str], ...] = ()
    default_sink: str = "stdout"
    compression: bool = False


@dataclasses.dataclass(frozen=True)
class GlobalPolicy:
    max_concurrency: int = 8
    timeout_s: float = 30.0
    retry_attempts: int = 3

    def __post_init__(self):
        if self.max_concurrency <= 0 or self.timeout_s <= 0:
            raise ConfigError("max_concurrency and timeout must be positive")


@dataclasses.dataclass(frozen=True)
class HealthPolicy:
    """OBS-10: thresholds of the probes."""

    probe_ttl_s: float = 2.0
    least_samples: int = 10
    degraded_ratio: float = 0.5
    unhealthy_ratio: float = 0.8
    sample_percent: float = 20.0

    def normalised(self) -> HealthPolicy:
        fresh = HealthPolicy()
        fixed = {f.name: getattr(fresh, f.name) for f in dataclasses.fields(self) if getattr(self, f.name) <= 0}
        out = dataclasses.replace(self, **fixed)
        return dataclasses.replace(out, unhealthy_ratio=max(out.unhealthy_ratio, out.degraded_ratio), sample_percent=min(100.0, out.sample_percent))


@dataclasses.dataclass(frozen=True)
class FetchPolicy:
    """POL-18: how pages are fetched."""

    timeout_s: float = 30.0
    max_retries: int = 3
    request_delay_s: float = 0.0

    def __post_init__(self):
        if self.timeout_s <= 0:
            raise ConfigError("the timeout must be positive")
        if self.max_retries < 0 or self.request_delay_s < 0:
            raise ConfigError("retries and delays must not be negative")


@dataclasses.dataclass(frozen=True)
class ScrapeConfig:
    """POL-18: a crawl as the command line describes it; fewer than one worker count as one."""

    start_url: str
    allowed_domains: tuple[str, ...]
    max_depth: int = 1
    workers: int = 1

    def __post_init__(self):
        if not self.start_url or not self.allowed_domains or self.max_depth < 1:
            raise ConfigError("a crawl needs a start URL, an allowed domain and a depth of one or more")
        object.__setattr__(self, "workers", max(1, self.workers))

    def crawl_policy(self) -> CrawlPolicy:
        return CrawlPolicy(allowed=dict.fromkeys(self.allowed_domains, True), max_depth=self.max_depth)


@dataclasses.dataclass(frozen=True)
class ProcessorView:
    """POL-12, POL-16: what processing takes from the policies."""

    selectors: tuple[str, ...]
    metadata: bool
    images: bool
    markdown: bool
    min_words: int

    def steps(self) -> dict[str, bool]:
        """The flags of `rules.processing_steps`."""
        return {"metadata_extraction": self.metadata, "image_extraction": self.images, "markdown_conversion": self.markdown}

    def accepts(self, words):
        return words >= self.min_words


@dataclasses.dataclass(frozen=True)
class OutputView:
    """POL-12, POL-16: what output takes from the policies."""

    format: str
    compression: bool
    require_validation: bool = True
    max_bytes: int = 1 << 20

    def accepts(self, size, valid):
        return (size <= self.max_bytes) & valid if self.require_validation else size <= self.max_bytes


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    crawl: CrawlPolicy = CrawlPolicy()
    processing: ProcessingPolicy = ProcessingPolicy()
    output: OutputPolicy = OutputPolicy()
    general: GlobalPolicy = GlobalPolicy()
    health: HealthPolicy = HealthPolicy()
    resume: bool = False
    journal: str = ""

    def processor(self) -> ProcessorView:
        """POL-12: a quality threshold of 0 to 1 asks for so many hundredths of a hundred words."""
        p = self.processing
        return ProcessorView(self.crawl.default_selectors, p.metadata_extraction, p.image_extraction, p.markdown_conversion, int(p.quality_threshold * 100))

    def outlet(self) -> OutputView:
        """POL-12."""
        return OutputView(self.output.default_format, self.output.compression)


def seconds(text: str) -> float:
    """`1h2m3.5s`, `200ms` and the like in seconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ConfigError(f"no duration: {text!r}")
    return sum(float(a) * {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}[b] for a, b in parts)


def overlay(base: Any, values: dict[str, Any]) -> Any:
    """SRC-11, SRC-13: base with the non-null values of a map; nested maps go into nested policies, values of a wrong type are errors."""
    changes = {}
    known = {f.name: getattr(base, f.name) for f in dataclasses.fields(base)}
    for key, value in values.items():
        if value is None:
            continue
        if key not in known:
            raise ConfigError(f"unknown setting {key!r}")
        now = known[key]
        if dataclasses.is_dataclass(now):
            value = overlay(now, value)
        elif isinstance(now, float) and isinstance(value, str):
            value = seconds(value)
        elif isinstance(now, tuple):
            value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
        elif isinstance(now, bool) != isinstance(value, bool) or not isinstance(value, (type(now), int) if isinstance(now, float) else type(now)):
            raise ConfigError(f"{key} must be {type(now).__name__}")
        changes[key] = value
    return dataclasses.replace(base, **changes)


def load(path: str) -> EngineConfig:
    """SRC-11, SRC-12: a JSON or YAML file on the driver; a missing file is the default."""
    file = Path(path)
    if not file.exists():
        return EngineConfig()
    text = file.read_text()
    if file.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML needs the yaml package") from e
        return overlay(EngineConfig(), yaml.safe_load(text) or {})
    return overlay(EngineConfig(), json.loads(text))


def checksum(config: EngineConfig) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest()


def host_settings(policy: CrawlPolicy, host):
    """POL-05 for tables: struct<delay, selectors> of a host column, the defaults where the policy has nothing of its own."""
    from pyspark.sql import functions as F

    def known(values, default):
        return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])[host], F.lit(default)) if values else F.lit(default)

    listed = {k: "\n".join(v) for k, v in policy.site_selectors.items()}
    return F.struct(known(policy.site_delays, policy.default_delay).alias("delay"), F.split(known(listed, "\n".join(policy.default_selectors)), "\n").alias("selectors"))


class PolicyManager:
    """POL-07: the policies in force; none but valid ones are taken, and the settings of a host are looked up in them."""

    def __init__(self, config: EngineConfig | None = None):
        self.current = config or EngineConfig()

    def configure(self, values: dict[str, Any]) -> EngineConfig:
        """The policies with these values laid over them; what is not valid raises and changes nothing."""
        self.current = overlay(self.current, values)
        return self.current

    def for_host(self, host: str) -> dict[str, Any]:
        crawl = self.current.crawl
        return {"selectors": crawl.selectors(host), "delay": crawl.delay(host), "max_depth": crawl.max_depth}


class Runtime:
    """CFG-02, CFG-03, STR-17, STR-19: the configuration in force, its validators, observers and versions (JSON files in a folder)."""

    def __init__(self, config: EngineConfig, folder: str):
        self.config, self.folder = config, Path(folder)
        self.validators: list[Callable[[EngineConfig], None]] = []
        self.observers: list[Callable[[EngineConfig, EngineConfig], None]] = []
        self.folder.mkdir(parents=True, exist_ok=True)

    def update(self, values: dict[str, Any], author: str = "", description: str = "") -> bool:
        """Applies values if all validators agree; False if nothing changes."""
        new = overlay(self.config, values)
        for check in self.validators:
            check(new)
        return self._set(new, author, description)

    def _set(self, new: EngineConfig, author: str, description: str) -> bool:
        if checksum(new) == checksum(self.config):
            return False
        old, self.config = self.config, new
        number = len(self.history()) + 1
        record = {"version": str(number), "author": author, "description": description, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "config": dataclasses.asdict(new)}
        (self.folder / f"{number:06d}.json").write_text(json.dumps(record, sort_keys=True))
        for tell in self.observers:
            tell(old, new)
        return True

    def history(self) -> list[dict]:
        out = []
        for file in sorted(self.folder.glob("*.json")):
            try:
                out.append(json.loads(file.read_text()))
            except ValueError:
                continue  # a bad file is no version
        return out

    def rollback(self, version: str) -> EngineConfig:
        found = next((h for h in self.history() if h["version"] == version), None)
        if found is None:
            raise ConfigError(f"no version {version}")
        self._set(overlay(EngineConfig(), found["config"]), "", f"rollback to {version}")
        return self.config

    def reload(self, path: str) -> bool:
        """STR-19: True if the file's content changes the configuration."""
        return self._set(load(path), "", f"reload of {path}")


class Cached:
    """STR-15: a value that is made anew after `ttl` seconds."""

    def __init__(self, make: Callable[[], Any], ttl: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.ttl, self.clock, self.at, self.value = make, ttl, clock, None, None

    def get(self) -> Any:
        if self.at is None or self.clock() - self.at >= self.ttl:
            self.value, self.at = self.make(), self.clock()
        return self.value
