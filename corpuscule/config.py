"""Settings of a build, from defaults, a YAML or JSON file, and arguments."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .sources.files import DEFAULT_EXCLUDE


@dataclass(frozen=True)
class InputConfig:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "heading"
    max_chars: int = 3000
    overlap_chars: int = 200


@dataclass(frozen=True)
class SecurityConfig:
    pii: bool = True
    secrets: bool = True
    prompt_injection: bool = True
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReportConfig:
    html: bool = False


@dataclass(frozen=True)
class OutputConfig:
    path: str = ""
    normalized_markdown: bool = True


_PARTS = {"input": InputConfig, "chunking": ChunkingConfig, "security": SecurityConfig, "report": ReportConfig, "output": OutputConfig}


@dataclass(frozen=True)
class Config:
    """All settings; ``as_of`` is the one time stamp that a build writes, the current time if empty."""

    input: InputConfig = field(default_factory=InputConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    security: SecurityConfig = field(default_factory=SecurityConfig)
    report: ReportConfig = field(default_factory=ReportConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    as_of: str = ""

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def check(self) -> Config:
        c = self.chunking
        if c.max_chars <= 0 or not 0 <= c.overlap_chars < c.max_chars:
            raise ConfigError("chunking.max_chars must be positive and overlap_chars smaller")
        return self


def from_mapping(value: Any) -> Config:
    if not isinstance(value, dict):
        raise ConfigError("a configuration must be a mapping")
    parts: dict[str, Any] = {}
    for key, content in value.items():
        if key == "as_of":
            parts[key] = str(content)
            continue
        if key not in _PARTS or not isinstance(content, dict):
            raise ConfigError(f"unknown or malformed section: {key}")
        try:
            parts[key] = _PARTS[key](**{k: tuple(v) if isinstance(v, list) else v for k, v in content.items()})
        except TypeError as e:
            raise ConfigError(f"section {key}: {e}") from e
    return Config(**parts).check()


def load(path: str | Path) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return from_mapping(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs the yaml package; use JSON") from e
    return from_mapping(yaml.safe_load(text))


def merged(config: Config, *, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), strategy: str | None = None, max_chars: int | None = None, overlap_chars: int | None = None, output: str | None = None) -> Config:
    """Arguments over the file: ``include`` replaces, ``exclude`` is added, the others count where they are given."""
    given = {k: v for k, v in (("strategy", strategy), ("max_chars", max_chars), ("overlap_chars", overlap_chars)) if v is not None}
    return replace(
        config,
        input=InputConfig(include or config.input.include, (*config.input.exclude, *exclude)),
        chunking=replace(config.chunking, **given),
        output=replace(config.output, path=output) if output is not None else config.output,
    ).check()
