"""The 39 operators: what each reads, takes and gives. Everything else dispatches on these rows."""

from __future__ import annotations

from dataclasses import dataclass

#: Kinds of a stream that operators other than ``forecast`` read.
READABLE = ("measurement", "static", "label")


@dataclass(frozen=True)
class Operator:
    name: str
    family: str  # point, window, cross, calendar, scalar
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()  # types of node inputs
    output: str = "number"  # number, category, or source: that of the stream
    unit: str = "same"  # same, none, seconds, square, per_second, product, quotient
    numeric: bool = False  # refuses categories
    kinds: tuple[str, ...] = READABLE
    tolerance_ulps: int = 0

    @property
    def reads(self) -> bool:
        return self.family in ("point", "window", "cross")


_STREAM = ("source", "feature")


def _window(name: str, unit: str = "same", tolerance: int = 0, numeric: bool = True, output: str = "number") -> Operator:
    return Operator(name, "window", (*_STREAM, "window"), unit=unit, tolerance_ulps=tolerance, numeric=numeric, output=output)


def _calendar(name: str, holiday: bool = False) -> Operator:
    return Operator(name, "calendar", ("timezone", "calendar") if holiday else ("timezone",), unit="none")


OPERATORS: dict[str, Operator] = {
    o.name: o
    for o in (
        Operator("last", "point", _STREAM, ("max_staleness",), output="source"),
        Operator("lag", "point", (*_STREAM, "lag"), output="source"),
        Operator("staleness", "point", _STREAM, unit="seconds"),
        Operator("missing_count", "point", (*_STREAM, "window", "expected_interval"), unit="none"),
        Operator("forecast", "point", (*_STREAM, "lead"), output="source", kinds=("forecast",)),
        _window("count", unit="none"),
        _window("sum", tolerance=4),
        _window("mean", tolerance=4),
        _window("variance", unit="square", tolerance=16),
        _window("stddev", tolerance=16),
        _window("min"),
        _window("max"),
        _window("median"),
        _window("p25"),
        _window("p75"),
        _window("iqr"),
        _window("mad"),
        _window("slope", unit="per_second", tolerance=32),
        _window("time_since_max", unit="seconds"),
        _window("time_since_min", unit="seconds"),
        _window("mode", numeric=False, output="source"),
        _window("distinct_count", unit="none", numeric=False),
        Operator("cross_entity_mean", "cross", (*_STREAM, "entity_ref"), numeric=True, tolerance_ulps=4),
        _calendar("hour_of_day"),
        _calendar("day_of_week"),
        _calendar("day_of_month"),
        _calendar("day_of_year"),
        _calendar("month_of_year"),
        _calendar("is_weekend"),
        _calendar("is_holiday", holiday=True),
        _calendar("day_before_holiday", holiday=True),
        _calendar("day_after_holiday", holiday=True),
        Operator("add", "scalar", inputs=("number", "number")),
        Operator("subtract", "scalar", inputs=("number", "number")),
        Operator("multiply", "scalar", inputs=("number", "number"), unit="product"),
        Operator("divide", "scalar", inputs=("number", "number"), unit="quotient"),
        Operator("equals", "scalar", ("value",), inputs=("category",), unit="none"),
        Operator("is_in", "scalar", ("values",), inputs=("category",), unit="none"),
        Operator("coalesce", "scalar", inputs=("number", "number")),
    )
}
