"""One query per operator of the program language over the ``events`` log, with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.compiler import ExecutionPlan, compile_program
from tidemark.plans.engine import execute
from tidemark.sources import events

HOUR = 3_600_000_000
OFF_TIE = 1.3e-7
DAYS = ["2024-01-01", "2024-01-02", "2024-01-15"]
ZONE = "Europe/Ljubljana"
NUMBER, CATEGORY = {"source": "app", "feature": "value"}, {"source": "app", "feature": "type"}


def plan_of(nodes: Sequence[dict[str, Any]], outputs: Sequence[str]) -> ExecutionPlan:
    done = compile_program({"name": "query", "sources": events.SOURCES, "nodes": list(nodes), "outputs": list(outputs), "calendars": {"si": DAYS}, "entity_graphs": [{"name": "next", "max_related_entities": 2}]})
    if done.plan is None:
        raise ValueError(done.diagnostics)
    return done.plan


def run(spark: SparkSession, sf_dir: str, nodes: Sequence[dict[str, Any]], outputs: Sequence[str] = ("v",), **more: Any) -> DataFrame:
    plan = plan_of(nodes, outputs)
    return execute(plan, events.log(spark, sf_dir), events.requests(spark, sf_dir), events.graph(spark, sf_dir), **more)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles at 6 decimals, moved off the ties of rounding (as in the SQL)."""
    return df.select("request_ix", *[((F.round(F.col(c) + OFF_TIE, 6) + F.lit(0.0)) if k == "double" else F.col(c)).alias(c) for c, k in df.dtypes if c not in ("request_ix", "entity_id", "prediction_us")])


NODES: dict[str, list[dict[str, Any]]] = {
    "last": [{"id": "v", "op": "last", "params": NUMBER | {"max_staleness": "36h"}}],
    "lag": [{"id": "v", "op": "lag", "params": NUMBER | {"lag": "15m"}}],
    "staleness": [{"id": "v", "op": "staleness", "params": NUMBER}],
    "missing_count": [{"id": "v", "op": "missing_count", "params": NUMBER | {"window": "24h", "expected_interval": "6h"}}],
    "forecast": [{"id": "v", "op": "forecast", "params": {"source": "model", "feature": "value_fc", "lead": "1h"}}],
    "mode": [{"id": "v", "op": "mode", "params": CATEGORY | {"window": "96h"}}],
    "distinct_count": [{"id": "v", "op": "distinct_count", "params": CATEGORY | {"window": "96h"}}],
    "cross_entity_mean": [{"id": "v", "op": "cross_entity_mean", "params": NUMBER | {"entity_ref": "next"}}],
    "equals": [{"id": "c", "op": "last", "params": CATEGORY}, {"id": "v", "op": "equals", "inputs": ["c"], "params": {"value": "click"}}],
    "is_in": [{"id": "c", "op": "last", "params": CATEGORY}, {"id": "v", "op": "is_in", "inputs": ["c"], "params": {"values": ["click", "view"]}}],
}
WINDOWED = ("count", "sum", "mean", "variance", "stddev", "min", "max", "median", "p25", "p75", "iqr", "mad", "slope", "time_since_max", "time_since_min")
for _op in WINDOWED:
    NODES[_op] = [{"id": "v", "op": _op, "params": NUMBER | {"window": "72h"}}]
for _op in ("hour_of_day", "day_of_week", "day_of_month", "day_of_year", "month_of_year", "is_weekend"):
    NODES[_op] = [{"id": "v", "op": _op, "params": {"timezone": ZONE}}]
for _op in ("is_holiday", "day_before_holiday", "day_after_holiday"):
    NODES[_op] = [{"id": "v", "op": _op, "params": {"timezone": ZONE, "calendar": "si"}}]
_PAIR = [{"id": "a", "op": "last", "params": NUMBER}, {"id": "b", "op": "count", "params": NUMBER | {"window": "72h"}}]
for _op in ("add", "subtract", "multiply", "divide"):
    NODES[_op] = [*_PAIR, {"id": "v", "op": _op, "inputs": ["a", "b"]}]
NODES["coalesce"] = [{"id": "a", "op": "mean", "params": NUMBER | {"window": "24h"}}, {"id": "b", "op": "last", "params": NUMBER}, {"id": "v", "op": "coalesce", "inputs": ["a", "b"]}]

_EMPTY = "SELECT request_ix, CAST(NULL AS DOUBLE) AS v FROM req"
_IN = "SELECT request_ix, {agg} AS v FROM req r LEFT JOIN ev l ON l.e = r.e AND l.av <= r.t AND l.ev > r.t - {w} * {hour} AND l.ev <= r.t GROUP BY request_ix"


def _as_of_rows(asked: str = "req", what: str = "v") -> str:
    """request_ix, e, t of ``asked`` with value and event time of the greatest (ev, av, id) that had arrived by t: a running
    maximum over records and requests in order of arrival."""
    return f"""SELECT request_ix, e, t, (best).v AS v0, (best).ev AS ev0 FROM (
  SELECT request_ix, e, t, rank, max(x) OVER (PARTITION BY e ORDER BY t, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM (
    SELECT request_ix, e, t, 1 AS rank, NULL AS x FROM {asked}
    UNION ALL SELECT NULL, e, av, 0, {{'ev': ev, 'av': av, 'id': id, 'v': {what}}} FROM ev WHERE {what} IS NOT NULL)) WHERE rank = 1"""


def _as_of(pick: str, what: str = "v") -> str:
    return f"SELECT request_ix, {pick} AS v FROM ({_as_of_rows(what=what)})"


def _in(agg: str, w: int = 72) -> str:
    return _IN.format(agg=agg, w=w, hour=HOUR)


def _local(expr: str) -> str:
    return f"SELECT request_ix, CAST({expr} AS DOUBLE) AS v FROM (SELECT request_ix, make_timestamptz(t) AT TIME ZONE '{ZONE}' AS l FROM req)"


_HOLIDAYS = ", ".join(f"DATE '{d}'" for d in DAYS)
_BOTH = "SELECT request_ix, {expr} AS v FROM (SELECT request_ix, v AS a FROM ({a})) JOIN (SELECT request_ix, v AS b FROM ({b})) USING (request_ix)"
_LAST, _COUNT = _as_of("v0"), _in("CAST(count(v) AS DOUBLE)")
_MOST = f"""SELECT request_ix, arg_max(c, (n, newest, c)) AS v FROM req LEFT JOIN (
  SELECT request_ix, c, count(*) AS n, max(ev) AS newest FROM req r JOIN ev l ON l.e = r.e AND l.av <= r.t AND l.ev > r.t - 96 * {HOUR} AND l.ev <= r.t WHERE c IS NOT NULL GROUP BY request_ix, c) USING (request_ix) GROUP BY request_ix"""

BODIES: dict[str, str] = {
    "last": _as_of(f"CASE WHEN t - ev0 <= 36 * {HOUR} THEN v0 END"),
    "lag": "SELECT request_ix, arg_max(v, (ev, av, id)) AS v FROM req r LEFT JOIN ev l ON l.e = r.e AND l.ev = r.t - 900000000 AND l.av <= r.t AND l.v IS NOT NULL GROUP BY request_ix",
    "staleness": _as_of("(t - ev0) / 1e6"),
    "missing_count": _in("CAST(greatest(0, 4 - count(v)) AS DOUBLE)", 24),
    "forecast": f"SELECT request_ix, arg_max(v, (issued, av, id)) AS v FROM req r LEFT JOIN fc l ON l.e = r.e AND l.valid = r.t + {HOUR} AND l.av <= r.t AND l.v IS NOT NULL GROUP BY request_ix",
    "count": _COUNT,
    "sum": _in("sum(v)"),
    "mean": _in("avg(v)"),
    "variance": _in("CASE WHEN count(v) > 1 THEN var_samp(v) END"),
    "stddev": _in("CASE WHEN count(v) > 1 THEN stddev_samp(v) END"),
    "min": _in("min(v)"),
    "max": _in("max(v)"),
    "median": _in("quantile_cont(v, 0.5)"),
    "p25": _in("quantile_cont(v, 0.25)"),
    "p75": _in("quantile_cont(v, 0.75)"),
    "iqr": _in("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"),
    "mad": _in("mad(v)"),
    "slope": _in("CASE WHEN count(DISTINCT CASE WHEN v IS NOT NULL THEN ev END) > 1 THEN regr_slope(v, (ev - t) / 1e6) END"),
    "time_since_max": _in("(max(t) - arg_max(ev, (v, ev)) FILTER (v IS NOT NULL)) / 1e6"),
    "time_since_min": _in("(max(t) - arg_max(ev, (-v, ev)) FILTER (v IS NOT NULL)) / 1e6"),
    "mode": _MOST,
    "distinct_count": _in("CAST(count(DISTINCT c) AS DOUBLE)", 96),
    "cross_entity_mean": f"SELECT request_ix, avg(v0) AS v FROM req LEFT JOIN (SELECT q.request_ix, v0 FROM req q JOIN edges g ON g.e = q.e JOIN ({_as_of_rows('(SELECT DISTINCT 0 AS request_ix, g.other AS e, t FROM req JOIN edges g USING (e))')}) p ON p.e = g.other AND p.t = q.t) USING (request_ix) GROUP BY request_ix",
    "hour_of_day": _local("hour(l)"),
    "day_of_week": _local("isodow(l) - 1"),
    "day_of_month": _local("day(l)"),
    "day_of_year": _local("dayofyear(l)"),
    "month_of_year": _local("month(l)"),
    "is_weekend": _local("isodow(l) >= 6"),
    "is_holiday": _local(f"CAST(l AS DATE) IN ({_HOLIDAYS})"),
    "day_before_holiday": _local(f"CAST(l AS DATE) + 1 IN ({_HOLIDAYS})"),
    "day_after_holiday": _local(f"CAST(l AS DATE) - 1 IN ({_HOLIDAYS})"),
    "equals": _as_of("CAST(v0 = 'click' AS DOUBLE)", "c"),
    "is_in": _as_of("CAST(v0 IN ('click', 'view') AS DOUBLE)", "c"),
    "coalesce": _BOTH.format(expr="coalesce(a, b)", a=_in("avg(v)", 24), b=_LAST),
}
for _op, _expr in {"add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "a / nullif(b, 0)"}.items():
    BODIES[_op] = _BOTH.format(expr=_expr, a=_LAST, b=_COUNT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"op_{name}": (lambda spark, sf_dir, nodes=nodes: _rounded(run(spark, sf_dir, nodes))) for name, nodes in NODES.items()}


def oracle_sql() -> dict[str, str]:
    text = {"mode"}
    return {f"op_{name}": f"{events.SQL} SELECT request_ix, {'v' if name in text else f'round(v + {OFF_TIE}, 6) + 0.0'} AS v FROM ({body})" for name, body in BODIES.items()}
