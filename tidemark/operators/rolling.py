"""Rolling totals over trailing periods (problem 1).

Entities are packed by days into dense numpy blocks (entities x days) and multiplied by banded window operators. Time is
cut into tiles; a tile's block also holds the days of the longest window before it (the halo), so every block is
computed alone. A block holds at most ``block_entities`` entities and ``tile_days`` + halo days whatever the skew, since
rows are first summed to one per entity and day (combined before the shuffle).

Results for odd input: null values add nothing but their day counts as a day of the entity; rows with a null entity or
day are left out; an empty table gives an empty table; NaN values count as null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import BROADCAST_BYTES, cut, row_bytes, small_join

TILE_DAYS = 120
BLOCK_ENTITIES = 256


def band(days: int, halo: int, window: int) -> np.ndarray:
    """(halo + days) x days operator whose column j sums the ``window`` rows that end at halo + j."""
    row, col = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((row <= col) & (row > col - window)).astype(float)


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: str,
    value: str,
    windows: Sequence[int] = (7, 30),
    tile_days: int = TILE_DAYS,
    block_entities: int = BLOCK_ENTITIES,
) -> DataFrame:
    """For each entity and each day from its first to its last: entity, day (int), first_day, value of the day, and per
    window w ``sum_w`` and ``avg_w`` = sum / w over the w days ending with it."""
    halo = max(windows) - 1
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    daily = df.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).cast("int").alias("day")).agg(F.sum(v).alias("value"))
    daily = cut(daily)
    spans = cut(daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")))
    number, size = spans.agg(F.count(F.lit(1)), F.sum(row_bytes(spans))).first()
    blocks = max(1, -(-number // block_entities))
    tile_of = lambda d: F.floor(d / tile_days).cast("int")
    # every tile of an entity's span is there, with or without rows
    frame = spans.select("entity", "first_day", "last_day", F.explode(F.sequence(tile_of(F.col("first_day")), tile_of(F.col("last_day")))).alias("tile"))
    frame = frame.select("tile", "entity", "first_day", "last_day", F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("value"))
    placed = daily.withColumn("tile", F.explode(F.sequence(tile_of(F.col("day")), tile_of(F.col("day") + halo))))
    placed = small_join(placed, spans.select("entity", F.col("last_day").alias("_last")), ["entity"], (size or 0) <= BROADCAST_BYTES)
    placed = placed.filter(F.col("tile") <= tile_of(F.col("_last"))).select("tile", "entity", F.lit(None).cast("int").alias("first_day"), F.lit(None).cast("int").alias("last_day"), "day", "value")
    packed = frame.unionByName(placed).withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
    bands = {w: band(tile_days, halo, w) for w in windows}
    kind = dict(daily.dtypes)["entity"]

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = pdf[pdf["day"].isna()]
        start = int(pdf["tile"].iloc[0]) * tile_days
        names = spans["entity"].to_numpy()
        row = pd.Index(names)
        data = pdf[pdf["day"].notna()]
        block = np.zeros((len(names), halo + tile_days))
        at = data["day"].to_numpy(int) - start + halo
        block[row.get_indexer(data["entity"]), at] = np.nan_to_num(data["value"].to_numpy(float))
        days = start + np.arange(tile_days)
        first, last = spans["first_day"].to_numpy(int), spans["last_day"].to_numpy(int)
        keep = (days[None, :] >= first[:, None]) & (days[None, :] <= last[:, None])
        i, j = np.nonzero(keep)
        out = {"entity": names[i], "day": days[j], "first_day": first[i], "value": block[:, halo:][i, j]}
        for w, op in bands.items():
            total = (block @ op)[i, j]
            out |= {f"sum_{w}": total, f"avg_{w}": total / w}
        return pd.DataFrame(out)

    schema = f"entity {kind}, day int, first_day int, value double, " + ", ".join(f"sum_{w} double, avg_{w} double" for w in windows)
    return packed.groupBy("tile", "block").applyInPandas(dense, schema)
