"""Candidate features for a search: every operator over every readable stream, then differences and ratios of pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import ceil
from typing import Any

from tidemark.plans.catalog import OPERATORS, READABLE
from tidemark.plans.program import Program


@dataclass(frozen=True)
class Grid:
    windows: tuple[str, ...] = ("1h", "3h", "6h", "24h")
    lags: tuple[str, ...] = ("1h", "3h", "24h")
    staleness: tuple[str, ...] = ("3h", "24h")
    intervals: tuple[str, ...] = ("1h",)
    leads: tuple[str, ...] = ("1h", "3h", "24h")
    timezone: str = "UTC"
    arithmetic: tuple[str, ...] = ("subtract", "divide")
    pairs: int = 24


def candidates(program: Program, grid: Grid = Grid(), label_sources: Sequence[str] = ()) -> list[dict[str, Any]]:
    """Nodes for every candidate, in a fixed order; labels aren't offered as features."""
    nodes: list[dict[str, Any]] = []

    def add(name: str, op: str, **params: Any) -> None:
        nodes.append({"id": name, "op": op, "params": params})

    for s in program.sources:
        if s.kind == "label" or s.source_id in label_sources:
            continue
        stem, base = f"{s.source_id}_{s.feature_name}".replace(":", "_").replace("-", "_").replace(".", "_"), {"source": s.source_id, "feature": s.feature_name}
        if s.kind == "forecast":
            for lead in grid.leads:
                add(f"{stem}__forecast_{lead}", "forecast", **base, lead=lead)
            continue
        number = s.value_type == "number"
        if number:
            add(f"{stem}__last", "last", **base)
            for x in grid.staleness:
                add(f"{stem}__last_{x}", "last", **base, max_staleness=x)
        add(f"{stem}__staleness", "staleness", **base)
        if s.kind not in READABLE or s.max_input_rate_per_hour is None:
            continue
        for lag in grid.lags if number else ():
            add(f"{stem}__lag_{lag}", "lag", **base, lag=lag)
        for w in grid.windows:
            for i in grid.intervals:
                add(f"{stem}__missing_{w}_{i}", "missing_count", **base, window=w, expected_interval=i)
            for op in OPERATORS.values():
                if op.family == "window" and (number or not op.numeric) and (number or op.output == "number"):
                    add(f"{stem}__{op.name}_{w}", op.name, **base, window=w)
        if not number:
            for i, c in enumerate(s.categories or ()):
                add(f"{stem}__cat", "last", **base) if i == 0 else None
                nodes.append({"id": f"{stem}__is_{i}", "op": "equals", "inputs": [f"{stem}__cat"], "params": {"value": c}})
        for g in program.entity_graphs if number else ():
            add(f"{stem}__{g.name}_mean", "cross_entity_mean", **base, entity_ref=g.name)
    for op in OPERATORS.values():
        if op.family == "calendar" and op.required == ("timezone",):
            add(f"t__{op.name}", op.name, timezone=grid.timezone)
    return nodes + _pairs(nodes, grid)


def _pairs(nodes: list[dict[str, Any]], grid: Grid) -> list[dict[str, Any]]:
    """At most ``grid.pairs`` pairs of ``last`` features, taken in turn from each operation, so that none crowds out another."""
    lasts = [n["id"] for n in nodes if n["op"] == "last" and n["id"].endswith("__last")]
    queues = [[{"id": f"{op}__{a}__{b}", "op": op, "inputs": [a, b]} for a, b in combinations(lasts, 2)] for op in grid.arithmetic]
    out: list[dict[str, Any]] = []
    while any(queues) and len(out) < grid.pairs:
        for q in queues:
            if q and len(out) < grid.pairs:
                out.append(q.pop(0))
    return out


def budget(n_candidates: int, max_features: int, step: int = 500) -> int:
    """Evaluations granted to a search, in whole steps."""
    return ceil(n_candidates * max_features / step) * step
