"""The only place where event time, availability and prediction time are compared.

All times are µs since 1970 (BIGINT). Availability and event time are separate clocks: a record is *visible* by its
availability, and belongs to a *window* by its event time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(available_us: Column, t_us: Column) -> Column:
    """A record can be used at t if it was available at t or before."""
    return available_us <= t_us


def in_window(event_us: Column, t_us: Column, window_us: Column) -> Column:
    """The trailing window (t - window, t]: open on the left, so that windows tile time."""
    return (event_us > t_us - window_us) & (event_us <= t_us)


def fresh_enough(event_us: Column, t_us: Column, bound_us: Column) -> Column:
    return t_us - event_us <= bound_us


def revealed(reveal_us: Column, now_us: Column) -> Column:
    """A label can be used from its reveal on."""
    return reveal_us <= now_us


def in_fold(t_us: Column, start_us: Column, end_us: Column) -> Column:
    """Half-open period [start, end)."""
    return (t_us >= start_us) & (t_us < end_us)


def window_buckets(t_us: Column, window_us: Column) -> Column:
    """The buckets of width ``window`` that (t - window, t] touches (two at most)."""
    return F.sequence(bucket_of(t_us - window_us + 1, window_us), bucket_of(t_us, window_us))


def bucket_of(us: Column, width_us: Column) -> Column:
    return F.call_function("div", us - F.pmod(us, width_us), width_us)


def visible_py(available_us: int, t_us: int) -> bool:
    """The same decisions for the streaming processor, which sees one record at a time."""
    return available_us <= t_us


def in_window_py(event_us: int, t_us: int, window_us: int) -> bool:
    return t_us - window_us < event_us <= t_us


def fresh_enough_py(event_us: int, t_us: int, bound_us: int) -> bool:
    return t_us - event_us <= bound_us
