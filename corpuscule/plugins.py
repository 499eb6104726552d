"""Extension points: decoders, chunkers, exporters, metrics and evaluation suites, all of them in effect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.metadata import entry_points
from typing import Protocol

from pyspark.sql import DataFrame

from .errors import ConfigError
from .operators import chunk
from .sources.decoders import BUILT_IN, Decoder

GROUP = "corpuscule.plugins"

#: From documents and chunks to one row.
Metric = Callable[[DataFrame, DataFrame], DataFrame]
#: From a build's DataFrames to a report.
Suite = Callable[..., DataFrame]
Exporter = Callable[[DataFrame], DataFrame]


class Plugin(Protocol):
    def register(self, registry: Registry) -> None: ...


@dataclass
class Registry:
    """What is known besides the built-in parts. Names of plugins' metadata begin with ``ns:plugin:``."""

    decoders: list[Decoder] = field(default_factory=list)
    chunkers: dict[str, Callable] = field(default_factory=dict)
    exporters: dict[str, Exporter] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    suites: dict[str, Suite] = field(default_factory=dict)
    #: Put into every document's metadata.
    metadata: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def all_decoders(self) -> tuple[Decoder, ...]:
        return (*self.decoders, *BUILT_IN)

    def chunker_names(self) -> list[str]:
        return sorted({*chunk.CHUNKERS, *self.chunkers})

    def register(self, kind: str, name: str, value) -> None:
        if kind == "decoders":
            self.decoders.append(value)
            return
        table = getattr(self, kind, None)
        if kind == "metadata":
            if not metadata_name_ok(name):
                raise ConfigError(f"metadata of a plugin must be named ns:plugin:key, not {name}")
            self.metadata[name] = str(value)
            return
        if not isinstance(table, dict):
            raise ConfigError(f"unknown kind of plugin: {kind}")
        table[name] = value


def metadata_name_ok(name: str) -> bool:
    """Whether a plugin's metadata key is namespaced as it should be."""
    parts = name.split(":")
    return len(parts) == 3 and parts[0] == "ns" and all(parts)


@lru_cache(maxsize=1)
def installed() -> Registry:
    """Plugins of installed packages; one that can't be loaded is left out and named in ``skipped``."""
    registry = Registry()
    for point in entry_points(group=GROUP):
        try:
            point.load()().register(registry)
        except Exception as e:
            registry.skipped.append(f"{point.name}: {e}")
    return registry
