"""Late and out-of-order events (problem 5): per-period aggregates by event time, published once and then corrected.

Every source has a low watermark: the greatest event time among what it has delivered so far (never ahead of the arrival
itself), less ``lateness``. A source passes a period's end when its watermark reaches it, when a punctuation of the source
says so, or when it has delivered nothing for ``idle`` and the end lies ``lateness`` or more behind the clock (a source that hasn't delivered yet
is silent from the first delivery of all on). When every source has passed, the period is closed.

A period is published for the first time at its punctuation (``publish_after`` its end) with what has arrived by then, and
corrected by each further record until it is closed. Records that arrive after the close are diverted, and so are those
that come later than ``cutoff`` after their own event: they enter no aggregate. With ``lateness`` >= ``cutoff`` (the default: equal)
a close loses no record within the cut-off, however short ``idle`` is; with less, the close decides.

A record that comes again counts at its first delivery. Results for odd input: a null or NaN value, a null event or
arrival time isn't counted; stream keys and sources may be null (null is a key of its own); an empty log gives an empty
table; an event far off in time opens its own period and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import US_DAY, US_HOUR, cut, floordiv, fresh, sized_join

_NEVER = 1 << 62


def first_deliveries(log: DataFrame, record: str, available_us: str, keep: Sequence[str]) -> DataFrame:
    """One row per record id: the delivery that came first (ties: the least content)."""
    rest = [c for c in keep if c not in (record, available_us)]
    return log.groupBy(record).agg(F.min(F.struct(F.col(available_us), *rest)).alias("_d")).select(record, F.col(f"_d.{available_us}").alias(available_us), *[F.col(f"_d.{c}").alias(c) for c in rest])


def _group(within: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in within]) if within else F.lit(0)


def closes(log: DataFrame, source: str, event_us: str, available_us: str, period_us: int, lateness_us: int, idle_us: int, within: Sequence[str] = (), punctuations: DataFrame | None = None) -> DataFrame:
    """group, period -> ``closed_us``: when every source (of the group: the columns ``within``) had passed the period's end.

    The log is reduced, before any shuffle, to one row per source, hour of arrival and period; what follows is as long as
    sources x periods. ``punctuations`` (``within``, ``source``, ``at_us``, ``upto_us``): from ``at_us`` on, the source delivers nothing
    that happened before ``upto_us``.
    """
    step_us = max(1, min(US_HOUR, idle_us))  # no silence of more than ``idle`` lies within a step
    mark = F.least(F.col(event_us), F.col(available_us)) - lateness_us
    seen = log.filter(F.col(event_us).isNotNull() & F.col(available_us).isNotNull())
    seen = seen.groupBy(_group(within).alias("group"), F.col(source).alias("source"), floordiv(F.col(available_us), step_us).alias("step"), floordiv(F.col(event_us), period_us).alias("period"), floordiv(mark, period_us).alias("upto"))
    seen = cut(seen.agg(F.min(available_us).alias("first"), F.max(available_us).alias("last")))
    passed = seen.groupBy("group", "source", "upto").agg(F.min("first").alias("at"))
    if punctuations is not None:
        said = punctuations.select(_group(within).alias("group"), F.col(source).alias("source"), floordiv(F.col("upto_us"), period_us).alias("upto"), F.col("at_us").alias("at"))
        passed = passed.unionByName(said)
    own = Window.partitionBy("group", "source").orderBy("step")
    steps = seen.groupBy("group", "source", "step").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("next", F.coalesce(F.lead("first").over(own), F.lit(_NEVER)))
    births = steps.groupBy("group", "source").agg(F.min("first").alias("next")).withColumn("last", F.min("next").over(Window.partitionBy("group")))
    gaps = steps.select("group", "source", "last", "next").unionByName(births.select("group", "source", "last", "next")).filter(F.col("next") - F.col("last") > idle_us)

    end = (F.col("period") + 1) * period_us
    periods = seen.groupBy("group").agg(F.collect_set("period").alias("period"))
    probes = births.select("group", "source").join(periods, "group").select("group", "source", F.explode("period").alias("period"))
    rows = probes.withColumns({"by_mark": F.col("period"), "by_clock": end + lateness_us})
    rows = rows.unionByName(passed.select("group", "source", (F.col("upto") - 1).alias("by_mark"), "at"), allowMissingColumns=True)
    rows = rows.unionByName(gaps.select("group", "source", F.col("next").alias("by_clock"), F.struct("next", "last").alias("gap")), allowMissingColumns=True)
    later = lambda c: Window.partitionBy("group", "source").orderBy(F.col(c).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.min("at").over(later("by_mark"))).withColumn("gap", F.min("gap").over(later("by_clock"))).filter(F.col("period").isNotNull())
    silent = F.greatest(F.col("gap.last") + idle_us, end + lateness_us)
    return rows.groupBy("group", "period").agg(F.max(F.least("at", silent)).alias("closed_us"))


def placed(
    log: DataFrame,
    stream: Sequence[str],
    *,
    record: str = "record_id",
    source: str = "source_id",
    event_us: str = "event_us",
    available_us: str = "available_us",
    value: str = "value",
    present: str = "present",
    period_us: int = US_DAY,
    publish_after_us: int = 6 * US_HOUR,
    cutoff_us: int = 72 * US_HOUR,
    lateness_us: int | None = None,
    idle_us: int = 48 * US_HOUR,
    within: Sequence[str] = (),
    punctuations: DataFrame | None = None,
) -> DataFrame:
    """Every first delivery with a value: its ``period``, when that closed (``closed_us``) and where it goes: ``place`` is first
    (edition), correction, closed (diverted: the period is) or cut_off (diverted: its lag is beyond the cut-off)."""
    lateness_us = cutoff_us if lateness_us is None else lateness_us
    done = closes(log, source, event_us, available_us, period_us, lateness_us, idle_us, within, punctuations)
    once = first_deliveries(log, record, available_us, [*dict.fromkeys([*stream, *within, source]), event_us, value, present])
    known = once.filter(F.col(event_us).isNotNull() & F.col(available_us).isNotNull() & F.col(present)).withColumn("period", floordiv(F.col(event_us), period_us))
    group = fresh(known, "_group")
    known = sized_join(known.withColumn(group, _group(within)), done.withColumnRenamed("group", group), [group, "period"]).drop(group)
    end = (F.col("period") + 1) * period_us
    place = F.when(F.col(available_us) > F.col("closed_us"), "closed").when(F.col(available_us) - F.col(event_us) > cutoff_us, "cut_off")
    return known.withColumn("place", place.when(F.col(available_us) <= end + publish_after_us, "first").otherwise("correction"))


def editions(log: DataFrame, stream: Sequence[str], *, available_us: str = "available_us", value: str = "value", **more) -> DataFrame:
    """Per stream and period: period, first edition (``first_n``, ``first_sum``), ``corrections`` since and ``corrected_us``
    (the last), final edition (``n``, ``sum``, ``min``, ``max``), ``diverted`` and ``closed_us``. Options: see ``placed``.

    ``present`` is a boolean column: the record has a value. ``value`` is its number, null for a category.
    """
    known = placed(log, stream, available_us=available_us, value=value, **more)
    first, late = F.col("place") == "first", F.col("place") == "correction"
    counted = first | late
    v = F.col(value)
    return known.groupBy(*stream, "period").agg(
        F.count(F.when(first, True)).alias("first_n"),
        F.sum(F.when(first, v)).alias("first_sum"),
        F.count(F.when(late, True)).alias("corrections"),
        F.max(F.when(late, F.col(available_us))).alias("corrected_us"),
        F.count(F.when(counted, True)).alias("n"),
        F.sum(F.when(counted, v)).alias("sum"),
        F.min(F.when(counted, v)).alias("min"),
        F.max(F.when(counted, v)).alias("max"),
        F.count(F.when(~counted, True)).alias("diverted"),
        F.max("closed_us").alias("closed_us"),
    )
