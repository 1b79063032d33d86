"""Implausible readings (problem 2): each source against its own normal behaviour.

1. Quantile sketches per source, field and hour of day (merged across partitions) give the source's daily course, which
   is taken off its readings.
2. In tiles of hours (each with a halo, so that a source of any size is computed in bounded pieces) every reading gets
   its departure: how far a run of one to three hours that holds it lies beyond the readings on both of its sides, on
   the same side of both; hours inside the run may be missing. A change that lasts departs from one side only and scores
   nothing. Where one side has no reading within ``FAR`` hours (a file's ends, long gaps), the other decides alone by a
   stricter bound: the run must lie beyond all its readings of ``FAR`` hours, more than ``LONGEST`` of them, by ``ALONE``
   times as much.
   Readings of the tile that stand out by ``STRONG`` interquartile ranges of the tile's residuals (a tile is ``TILE_HOURS`` of one
   source) are no yardstick for their neighbours: a second round takes the sides without them. A tile of fewer than
   ``LEAST_READINGS`` readings has no ranges of its own to go by and keeps the first round.
3. Sketches of the residuals, per source, field and part of the day, give interquartile ranges; a departure beyond
   ``fence`` ranges is a spike. Physical limits and runs of zero variance (``stuck_hours`` equal hourly values, all but the
   first) are flagged beside it.

Results for odd input: null, NaN and placeholder values are never flagged and end runs; several readings of one source
and hour count as one (the least key's) for the neighbourhood and are each compared with it; rows with a null source,
hour or key are left out; an empty table gives an empty table; a source without spread (interquartile range 0) has its
fence at the field's ``least_range``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import cut, sized_join


@dataclass(frozen=True)
class Field:
    """A measured field: what is physically possible, whether it varies by ratio, and the least range that is normal."""

    name: str
    low: float
    high: float
    ratio: bool = False
    least_range: float = 0.05


FENCE = 4.8
STRONG = 6.0
LEAST_READINGS = 100
STUCK_HOURS = 6
LONGEST = 3
REACH = 2
FAR = 6
ALONE = 2
TILE_HOURS = 24 * 60
HALO = 16
PART_HOURS = 6


def _sides(x: np.ndarray, step: int) -> np.ndarray:
    """Median of the ``REACH`` nearest readings on one side (step -1 before, +1 after): within REACH hours if there is
    one, else the nearest within FAR hours."""
    pad = np.full(FAR, np.nan)
    y = np.concatenate([pad, x, pad])
    at = np.arange(len(x)) + FAR
    with np.errstate(all="ignore"):
        near = np.stack([y[at + step * k] for k in range(1, REACH + 1)])
        n = (~np.isnan(near)).sum(axis=0)
        side = np.where(n > 0, np.nansum(near, axis=0) / np.maximum(n, 1), np.nan)
    for k in range(REACH + 1, FAR + 1):
        side = np.where(np.isnan(side), y[at + step * k], side)
    return side


def _one_side(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest reading within ``FAR`` hours on one side; NaN if it has ``LONGEST`` readings or fewer."""
    pad = np.full(FAR, np.nan)
    y = np.concatenate([pad, x, pad])
    at = np.arange(len(x)) + FAR
    near = np.stack([y[at + step * k] for k in range(1, FAR + 1)])
    enough = (~np.isnan(near)).sum(axis=0) > LONGEST
    return np.where(enough, np.fmin.reduce(near), np.nan), np.where(enough, np.fmax.reduce(near), np.nan)


def _beyond(x: np.ndarray, around: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Departure of each hour of ``x`` from its sides in ``around`` (``alone``: also where only one side has readings), and
    its residual."""
    before, after = _sides(around, -1), _sides(around, 1)
    low_before, high_before = _one_side(around, -1)
    low_after, high_after = _one_side(around, 1)
    n = len(x)
    best = np.zeros(n)
    for length in range(1, LONGEST + 1):
        m = n - length + 1
        if m <= 0:
            break
        runs = np.stack([x[j : j + m] for j in range(length)])
        low, high = np.fmin.reduce(runs), np.fmax.reduce(runs)
        b, a = before[:m], after[length - 1 :]
        out = np.maximum(low - np.maximum(b, a), np.minimum(b, a) - high)
        if alone:
            only_after, only_before = np.isnan(b) & ~np.isnan(a), np.isnan(a) & ~np.isnan(b)
            out = np.where(only_after, np.maximum(low - high_after[length - 1 :], low_after[length - 1 :] - high) / ALONE, out)
            out = np.where(only_before, np.maximum(low - high_before[:m], low_before[:m] - high) / ALONE, out)
        ends = ~np.isnan(runs[0]) & ~np.isnan(runs[-1])
        out = np.where(np.isnan(out) | ~ends, 0, np.maximum(out, 0))
        for j in range(length):
            best[j : j + m] = np.maximum(best[j : j + m], np.where(np.isnan(runs[j]), 0, out))
    return best, x - (before + after) / 2


def _yardstick(x: np.ndarray) -> np.ndarray:
    """The series without the readings that stand out from both sides by ``STRONG`` interquartile ranges."""
    best, rest = _beyond(x, x, False)
    there = ~np.isnan(rest)
    if there.sum() < LEAST_READINGS:
        return x
    low, high = np.quantile(rest[there], [0.25, 0.75])
    return np.where(best > STRONG * (high - low), np.nan, x) if high > low else x


def departures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Departure and residual of each hour of one source's dense series (NaN: no reading).

    Readings that stand out by ``STRONG`` interquartile ranges of the series are no yardstick for their neighbours: a second
    round takes the sides without them (and gives them no residual).
    """
    clean = _yardstick(x)
    best, rest = _beyond(x, clean, True)
    return best, np.where(np.isnan(clean), np.nan, rest)


def stuck(x: np.ndarray, hours: int = STUCK_HOURS) -> np.ndarray:
    """All but the first of a run of at least ``hours`` equal values; NaN ends a run."""
    same = np.concatenate([[False], x[1:] == x[:-1]])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
    length = np.zeros(len(x), int)
    np.maximum.at(length, start, np.arange(len(x)) - start + 1)
    return same & (length[start] >= hours)


def implausible(df: DataFrame, key: str, source: str, hour: str, fields: Sequence[Field], placeholders: Sequence[float] = (), fence: float = FENCE) -> DataFrame:
    """One row per reading and field that is flagged: key, source, field, value, reason (impossible, spike, stuck),
    departure and fence. ``hour`` is a number of hours (BIGINT, UTC or local)."""
    value = lambda f: F.when(~F.isnan(F.col(f.name)) & ~F.col(f.name).isin(list(placeholders) or [None]), F.col(f.name).cast("double"))
    base = df.filter(F.col(key).isNotNull() & F.col(source).isNotNull() & F.col(hour).isNotNull())
    base = base.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(hour).cast("long").alias("hour"), *[value(f).alias(f"v{i}") for i, f in enumerate(fields)])

    def scaled(i: int, f: Field):
        v = F.when(F.col(f"v{i}").between(f.low, f.high), F.col(f"v{i}"))
        return F.log1p(v) if f.ratio else v

    part = F.pmod(F.col("hour"), F.lit(24)).cast("int")
    course = base.groupBy("source", part.alias("hod")).agg(*[F.percentile_approx(scaled(i, f), 0.5, 1000).alias(f"c{i}") for i, f in enumerate(fields)])
    tile = lambda h: F.floor(h / TILE_HOURS)
    joined = sized_join(base.withColumn("hod", part), course, ["source", "hod"]).drop("hod")
    tiles = joined.withColumn("tile", F.explode(F.array_distinct(F.array(tile(F.col("hour")), tile(F.col("hour") - HALO), tile(F.col("hour") + HALO)))))
    kinds = dict(base.dtypes)
    limits = [(f.low, f.high, f.ratio) for f in fields]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["tile"].iloc[0]) * TILE_HOURS - HALO
        pdf = pdf.drop_duplicates("key").sort_values("key", kind="stable")
        at = pdf["hour"].to_numpy() - start
        lead = ~pd.Series(at).duplicated().to_numpy()
        own = (at >= HALO) & (at < HALO + TILE_HOURS)
        parts = []
        for i, (low, high, ratio) in enumerate(limits):
            v = pdf[f"v{i}"].to_numpy(float)
            dense = np.full(TILE_HOURS + 2 * HALO, np.nan)
            dense[at[lead]] = v[lead]
            fixed = stuck(dense)[at] & (dense[at] == v)
            possible = (v >= low) & (v <= high)
            with np.errstate(all="ignore"):
                s = np.where(possible, np.log1p(v) if ratio else v, np.nan) - np.nan_to_num(pdf[f"c{i}"].to_numpy(float))
            x = np.full(len(dense), np.nan)
            x[at[lead]] = s[lead]
            gone, rest = departures(x)
            out = np.where(lead, gone[at], 0)
            further = np.nonzero(~lead & own & ~np.isnan(s))[0]
            clean = _yardstick(x) if len(further) else x
            for p in further:  # further readings of an hour, in place of its first
                part = slice(max(0, at[p] - HALO), at[p] + HALO + 1)
                y = x[part].copy()
                c = at[p] - part.start
                y[c] = s[p]
                out[p] = _beyond(y, clean[part], True)[0][c]
            keep = own & ~np.isnan(v)
            parts.append(pd.DataFrame({"key": pdf["key"].to_numpy()[keep], "source": pdf["source"].to_numpy()[keep], "field": i, "part": (pdf["hour"].to_numpy()[keep] % 24) // PART_HOURS, "value": v[keep], "departure": np.where(possible, out, 0)[keep], "residual": np.where(lead, rest[at], np.nan)[keep], "stuck": fixed[keep], "impossible": ~possible[keep]}))
        return pd.concat(parts)

    schema = f"key {kinds['key']}, source {kinds['source']}, field int, part int, value double, departure double, residual double, stuck boolean, impossible boolean"
    scored = cut(tiles.groupBy("source", "tile").applyInPandas(score, schema))
    usual = scored.filter(~F.isnan("residual")).groupBy("source", "field", "part").agg(F.percentile_approx("residual", [0.25, 0.75], 1000).alias("q"))
    least = F.lit(None).cast("double")
    names = F.lit(None).cast("string")
    for i, f in enumerate(fields):
        least = F.when(F.col("field") == i, F.lit(f.least_range)).otherwise(least)
        names = F.when(F.col("field") == i, F.lit(f.name)).otherwise(names)
    usual = usual.select("source", "field", "part", (fence * F.greatest(F.col("q")[1] - F.col("q")[0], least)).alias("fence"))
    flagged = sized_join(scored.filter("impossible OR stuck OR departure > 0"), usual, ["source", "field", "part"])
    spike = F.coalesce(F.col("departure") > F.col("fence"), F.lit(False))
    return flagged.filter(F.col("impossible") | F.col("stuck") | spike).select(
        F.col("key").alias(key), "source", names.alias("field"), "value", F.when(F.col("impossible"), "impossible").when(spike, "spike").otherwise("stuck").alias("reason"), "departure", "fence"
    )
