"""Feature programs: a typed dataflow graph over declared streams, as JSON or YAML documents."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from typing import Any

from pydantic import BaseModel, ConfigDict, Field, ValidationError, field_validator

SCHEMA_VERSION = "0.1.0"
_DURATION = re.compile(r"^(-?\d+(?:\.\d+)?)([smhd])$")
_UNIT_US = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def duration_us(text: str) -> int:
    m = _DURATION.match(text)
    if not m:
        raise ValueError(f"{text!r} isn't a duration such as '90s', '15m', '2h' or '7d'")
    return round(float(m[1]) * _UNIT_US[m[2]])


def duration_text(us: int) -> str:
    """The shortest text of a duration (fractions of a second are dropped)."""
    seconds = int(us / 1_000_000)
    for unit in "dhm":
        size = _UNIT_US[unit] // 1_000_000
        if seconds and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


class _Part(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Source(_Part):
    source_id: str
    feature_name: str
    kind: str = "measurement"
    value_type: str = "number"
    unit: str | None = None
    categories: tuple[str, ...] | None = None
    max_input_rate_per_hour: float | None = Field(default=None, gt=0)
    max_forecast_horizon: str | None = None

    @field_validator("kind")
    @classmethod
    def _known_kind(cls, v: str) -> str:
        if v not in ("measurement", "static", "forecast", "label"):
            raise ValueError(f"unknown kind {v!r}")
        return v

    @field_validator("value_type")
    @classmethod
    def _known_type(cls, v: str) -> str:
        if v not in ("number", "category"):
            raise ValueError(f"unknown value type {v!r}")
        return v


class EntityGraph(_Part):
    name: str
    max_related_entities: int = Field(gt=0)


class Node(_Part):
    id: str = Field(pattern=r"^[A-Za-z_][A-Za-z0-9_]*$")
    op: str
    inputs: tuple[str, ...] = ()
    params: dict[str, Any] = Field(default_factory=dict)


class Program(_Part):
    schema_version: str = SCHEMA_VERSION
    name: str
    description: str = ""
    sources: tuple[Source, ...] = ()
    nodes: tuple[Node, ...]
    outputs: tuple[str, ...] = Field(min_length=1)
    entity_graphs: tuple[EntityGraph, ...] = ()
    calendars: dict[str, tuple[str, ...]] = Field(default_factory=dict)

    def source(self, source_id: str, feature: str) -> Source | None:
        return next((s for s in self.sources if (s.source_id, s.feature_name) == (source_id, feature)), None)


def program_hash(program: Program) -> str:
    return hashlib.sha256(json.dumps(program.model_dump(mode="json"), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_program(document: Mapping[str, Any]) -> Program:
    """Raises ``pydantic.ValidationError`` for a document of the wrong shape."""
    return Program.model_validate(dict(document))


__all__ = ["EntityGraph", "Node", "Program", "Source", "ValidationError", "duration_text", "duration_us", "program_hash", "read_program"]
