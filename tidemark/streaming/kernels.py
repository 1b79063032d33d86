"""The operators over plain Python records: what the stateful streaming processor evaluates, one request at a time.

Written apart from the DataFrame lowering, so that each checks the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any
from zoneinfo import ZoneInfo

from tidemark.boundaries import fresh_enough_py, in_window_py, visible_py
from tidemark.plans.compiler import ExecutionPlan, NodePlan

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Value:
    value: float | str | None
    lineage: tuple[str, ...] = ()
    available_us: int | None = None


NONE = Value(None)


def _order(r: Mapping[str, Any]) -> tuple:
    return (r["event_us"], r["available_us"], r["record_id"])


def _issue(r: Mapping[str, Any]) -> tuple:
    return (r["issued_us"], r["available_us"], r["revision_id"] or "", r["record_id"])


def payload(r: Mapping[str, Any]) -> float | str | None:
    return r["value_cat"] if r["value_num"] is None else r["value_num"]


def _made(value: float | str | None, rows: Iterable[Mapping[str, Any]]) -> Value:
    rows = list(rows)
    if value is None or not rows:
        return Value(value) if value is not None else NONE
    return Value(value, tuple(sorted(r["record_id"] for r in rows)), max(r["available_us"] for r in rows))


def quantile(values: Sequence[float], q: float) -> float | None:
    v = sorted(values)
    if not v:
        return None
    h = (len(v) - 1) * q
    low = math.floor(h)
    return v[low] if h == low else v[low] + (h - low) * (v[low + 1] - v[low])


def _aggregate(op: str, rows: list[Mapping[str, Any]], t: int) -> float | str | None:
    rows = sorted(rows, key=_order)
    v = [payload(r) for r in rows]
    n = len(v)
    if op == "count":
        return float(n)
    if op == "distinct_count":
        return float(len(set(v)))
    if not n:
        return None
    if op == "sum":
        return math.fsum(v)
    if op == "mean":
        return math.fsum(v) / n
    if op in ("variance", "stddev"):
        if n < 2:
            return None
        m = math.fsum(v) / n
        var = math.fsum((x - m) ** 2 for x in v) / (n - 1)
        return var if op == "variance" else math.sqrt(var)
    if op in ("min", "max"):
        return min(v) if op == "min" else max(v)
    if op in ("median", "p25", "p75"):
        return quantile(v, {"median": 0.5, "p25": 0.25, "p75": 0.75}[op])
    if op == "iqr":
        return quantile(v, 0.75) - quantile(v, 0.25)
    if op == "mad":
        m = quantile(v, 0.5)
        return quantile([abs(x - m) for x in v], 0.5)
    if op == "slope":
        x = [(r["event_us"] - rows[0]["event_us"]) / 1e6 for r in rows]
        mx, my = math.fsum(x) / n, math.fsum(v) / n
        xx = math.fsum((a - mx) ** 2 for a in x)
        return math.fsum((a - mx) * (b - my) for a, b in zip(x, v)) / xx if n > 1 and xx > 0 else None
    if op in ("time_since_max", "time_since_min"):
        top = max(v) if op == "time_since_max" else min(v)
        return (t - max(r["event_us"] for r, x in zip(rows, v) if x == top)) / 1e6
    if op == "mode":
        return max(set(v), key=lambda x: (v.count(x), max(r["event_us"] for r, y in zip(rows, v) if y == x), str(x)))
    raise ValueError(op)


def calendar_field(n: NodePlan, t: int) -> float:
    local = (_EPOCH + timedelta(microseconds=t)).astimezone(ZoneInfo(n.params["timezone"]))
    day, days = local.date(), set(n.params.get("days", []))
    return float(
        {
            "hour_of_day": local.hour,
            "day_of_week": local.weekday(),
            "day_of_month": local.day,
            "day_of_year": local.timetuple().tm_yday,
            "month_of_year": local.month,
            "is_weekend": local.weekday() >= 5,
            "is_holiday": day in days,
            "day_before_holiday": day + timedelta(days=1) in days,
            "day_after_holiday": day - timedelta(days=1) in days,
        }[n.operator.name]
    )


def leaf(n: NodePlan, records: Sequence[Mapping[str, Any]], entity: str, t: int, related: Sequence[str] = ()) -> Value:
    """One leaf over records already deduplicated (of any entity, any stream)."""
    name = n.operator.name

    def seen(who: str) -> list[Mapping[str, Any]]:
        return [r for r in records if r["entity_id"] == who and (r["source_id"], r["feature_name"]) == n.stream and visible_py(r["available_us"], t) and (r["kind"] == "forecast") == (name == "forecast")]

    if name == "cross_entity_mean":
        tops = [max(x, key=_order) for x in ([r for r in seen(who) if payload(r) is not None] for who in set(related)) if x]
        return _made(math.fsum(payload(r) for r in tops) / len(tops) if tops else None, tops)
    mine = seen(entity)
    full = [r for r in mine if payload(r) is not None]
    if name in ("last", "staleness"):
        if not full:
            return NONE
        top = max(full, key=_order)
        if name == "staleness":
            return _made((t - top["event_us"]) / 1e6, [top])
        if "staleness_us" in n.params and not fresh_enough_py(top["event_us"], t, n.params["staleness_us"]):
            return NONE
        return _made(payload(top), [top])
    if name == "lag":
        hits = [r for r in full if r["event_us"] == t - n.params["lag_us"]]
        return _made(payload(max(hits, key=_order)), [max(hits, key=_order)]) if hits else NONE
    if name == "forecast":
        hits = [r for r in full if r["valid_us"] == t + n.params["lead_us"]]
        return _made(payload(max(hits, key=_issue)), [max(hits, key=_issue)]) if hits else NONE
    w = n.params["window_us"]
    if name == "missing_count":
        inside = [r for r in mine if in_window_py(r["event_us"], t, w)]
        return _made(float(max(0, w // n.params["interval_us"] - sum(payload(r) is not None for r in inside))), inside)
    inside = [r for r in full if in_window_py(r["event_us"], t, w)]
    return _made(_aggregate(name, inside, t), inside)


def fold(plan: ExecutionPlan, leaves: Mapping[str, Value], t: int) -> dict[str, Value]:
    """All nodes of the plan, given its leaves."""
    done: dict[str, Value] = dict(leaves)
    for name in plan.needed:
        n = plan.nodes[name]
        if n.operator.family == "calendar":
            done[name] = Value(calendar_field(n, t))
        elif n.operator.family == "scalar":
            ins = [done[i] for i in n.inputs]
            done[name] = _scalar(n, ins)
    return done


def _scalar(n: NodePlan, ins: list[Value]) -> Value:
    op = n.operator.name
    if op == "coalesce":
        return ins[0] if ins[0].value is not None else ins[1]
    if any(i.value is None for i in ins):
        return NONE
    if op in ("equals", "is_in"):
        hit = ins[0].value in (n.params["values"] if op == "is_in" else [n.params["value"]])
        return Value(float(hit), ins[0].lineage, ins[0].available_us)
    a, b = ins[0].value, ins[1].value
    if op == "divide" and b == 0:
        return NONE
    value = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: a / b}[op]()
    times = [i.available_us for i in ins if i.available_us is not None]
    return Value(value, tuple(sorted({*ins[0].lineage, *ins[1].lineage})), max(times) if times else None)


def evaluate(plan: ExecutionPlan, records: Sequence[Mapping[str, Any]], entity: str, t: int, graphs: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> dict[str, Value]:
    leaves = {}
    for name in plan.needed:
        n = plan.nodes[name]
        if n.operator.reads:
            related = (graphs or {}).get(n.params.get("entity_ref", ""), {}).get(entity, ())
            leaves[name] = leaf(n, records, entity, t, related)
    return fold(plan, leaves, t)
