"""Settings, read from YAML near the caller and the environment; nothing here touches Spark."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class PipelineConfig:
    """Bounds and sizes of the topic pipeline."""

    n_neighbors_low: int = 15
    n_neighbors_high: int = 25
    components: int = 5
    min_cluster_size: int = 10
    min_samples: int = 1
    seed: int = 42
    top_n: int = 20
    keyword_chars: int = 12_000
    summary_chars: int = 600_000


@dataclass(frozen=True)
class GeneratorConfig:
    """Settings of the generators; chunks and retries are at least one, a timeout of 0 means none."""

    chunk_size: int = 10
    max_retries: int = 3
    retry_backoff_seconds: float = 1.5
    timeout_ms: int | None = 900_000
    anonymous_fraction: float = 0.2
    timezone: str = "+07:00"
    raw: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(d: dict) -> GeneratorConfig:
        t = d.get("timeout_ms", 900_000)
        return GeneratorConfig(max(1, int(d.get("chunk_size", 10))), max(1, int(d.get("max_retries", 3))), float(d.get("retry_backoff_seconds", 1.5)), int(t) if t else None, d.get("anonymous_fraction") or 0.2, d.get("timezone") or "+07:00", d)

    @staticmethod
    def near(start: str, block: str = "generator") -> GeneratorConfig:
        """From the nearest settings file that has the block; the defaults where there is none."""
        found = find_settings(start, block)
        return GeneratorConfig.of(found[1]) if found else GeneratorConfig()


def find_settings(start: str, block: str, name: str = "config.yaml") -> tuple[Path, dict] | None:
    """The nearest settings file of `start` or a folder above it that has the block; unreadable ones are passed over."""
    import yaml

    here = Path(start).resolve()
    for d in [here, *here.parents]:
        try:
            got = yaml.safe_load((d / name).read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError, UnicodeDecodeError):
            continue
        if isinstance(got, dict) and isinstance(got.get(block), dict):
            return d / name, got[block]
    return None


def secret(given: str | None, settings: dict | None, default_env: str) -> str | None:
    """A key: the given one, that of the settings, that of the variable they name, that of the usual variable."""
    settings = settings or {}
    for got in (given, settings.get("api_key"), os.environ.get(settings.get("api_key_env") or ""), os.environ.get(default_env)):
        if got and str(got).strip():
            return str(got).strip()
    return None


def service(start: str, block: str, default_env: str, given: str | None = None) -> tuple[dict, str]:
    """(settings, key) of a remote service: the nearest settings file that has the block, none being fine, and the key.

    The key is put into the variable where clients look for it. No key anywhere is a ValueError.
    """
    found = find_settings(start, block)
    settings = found[1] if found else {}
    key = secret(given, settings, default_env)
    if not key:
        raise ValueError(f"no key: give one, or set {settings.get('api_key_env') or default_env}")
    os.environ[default_env] = key
    return settings, key


def check_range(name: str, low: float, high: float, least: float = 0) -> None:
    """Raises ValueError unless least <= low <= high."""
    if not least <= low <= high:
        raise ValueError(f"{name}: {least} <= {low} <= {high} does not hold")
