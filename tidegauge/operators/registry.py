"""Metrics register themselves here, in order, with what they need of a subject."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Requires:
    """What a stream must be for a metric to run on it: one of these taxonomies (any if none is named), regular, of so many samples.

    An episode's metric needs streams of all its taxonomies.
    """

    taxonomy: tuple[str, ...] = ()
    samples: int = 0
    regular: bool = False


@dataclass(frozen=True)
class Metric:
    name: str
    level: str  # channel, stream, episode
    family: str
    unit: str
    run: Callable[..., DataFrame]
    requires: Requires = Requires()
    label: str = ""


METRICS: dict[str, Metric] = {}


def metric(name: str, *, level: str, family: str, unit: str, requires: Requires = Requires(), label: str = "") -> Callable:
    """Registers a builder of results; a second one of the same name is an error."""

    def keep(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in METRICS:
            raise ValueError(f"metric {name!r} is registered twice")
        METRICS[name] = Metric(name, level, family, unit, run, requires, label or name.replace("_", " "))
        return run

    return keep


def listed(level: str | None = None) -> list[Metric]:
    return [m for m in METRICS.values() if level in (None, m.level)]
