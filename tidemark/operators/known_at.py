"""Attributes as known at event time (problem 3): as-of merges that hot entities can't stall.

Events and versions of an entity are sharded by time. A shard also gets, as carry-in, the greatest version that
preceded it, so it is merged alone: a running maximum over the shard in time order. A shard with more than its share of
events is split further by salt, each part with its own copy of the shard's versions; splitting changes no result.

Results for odd input: an event with a null entity key or time keeps null attributes; versions with a null key or clock
are never known; of versions with equal order the payload with the greatest value counts; repeated events stay repeated;
empty sides give null attributes or an empty table; columns of versions never clash (they come as one struct).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import cut, floordiv, fresh, sized_join, spread_over

#: A shard counts as hot from this many events, or from a 2,000th of all events if that is more (so at most 2,000 are hot).
HOT_EVENTS = 200_000


def as_known(
    events: DataFrame,
    versions: DataFrame,
    keys: Mapping[str, str],
    at: str,
    clocks: Mapping[str, Column],
    order: Sequence[str],
    payload: Sequence[str] = (),
    width: int = 64,
    hot_events: int = HOT_EVENTS,
) -> DataFrame:
    """Add to each event, per clock, a struct of the greatest version (by ``order``) whose clock is <= the event's ``at``.

    keys: event column -> version column. clocks: result column -> integer Column of versions (when it starts to hold).
    ``width``: units of ``at`` per shard.
    """
    names = list(clocks)
    n = len(keys)
    k = [fresh(events, f"_ka_k{i}") for i in range(n)]
    shard, salt, rank, t, best = (fresh(events, f"_ka_{x}") for x in ("shard", "salt", "rank", "t", "best"))
    ev = events.withColumns({k[i]: F.col(c) for i, c in enumerate(keys)} | {t: F.col(at).cast("long")})
    ev = ev.withColumn(shard, floordiv(F.col(t), width))
    sizes = ev.groupBy(*k, shard).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cut(sizes)
    total, most = (x or 0 for x in sizes.agg(F.sum("_n"), F.max("_n")).first())
    least = max(hot_events, total // 2000)
    # at most 2,000 shards are hot
    hot = sizes.filter(F.col("_n") > least).select(*k, shard, F.ceil(F.col("_n") / least).cast("int").alias("_parts"))
    shards = sizes.drop("_n").join(hot, [*k, shard], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    if most <= least:
        ev = ev.withColumn(salt, F.lit(0))
    else:
        ev = sized_join(ev, hot, [*k, shard]).withColumn(salt, spread_over(events, F.coalesce(F.col("_parts"), F.lit(1)))).drop("_parts")

    version = F.struct(*[F.col(c) for c in (*order, *payload)])
    known = None
    for i, (name, clock) in enumerate(clocks.items()):
        one = versions.select(*[F.col(c).alias(k[j]) for j, c in enumerate(keys.values())], clock.cast("long").alias(t), F.lit(i).alias(rank), version.alias(best))
        known = one if known is None else known.unionByName(one)
    known = known.filter(F.col(t).isNotNull() & ~F.greatest(*[F.col(c).isNull() for c in k], F.lit(False)))
    known = known.withColumn(shard, floordiv(F.col(t), width)).groupBy(*k, shard, rank, t).agg(F.max(best).alias(best))
    known = cut(known)

    # carry-in: the greatest version before each shard; one row a shard, however many events or versions it has
    closes = known.groupBy(*k, rank, shard).agg(F.max(best).alias(best)).withColumn("_need", F.lit(False))
    needs = shards.select(*k, shard).withColumn(rank, F.explode(F.array(*[F.lit(i) for i in range(len(names))]))).withColumn(best, F.lit(None).cast(closes.schema[best].dataType)).withColumn("_need", F.lit(True))
    before = Window.partitionBy(*k, rank).orderBy(shard).rangeBetween(Window.unboundedPreceding, -1)
    carry = closes.unionByName(needs).withColumn(best, F.max(best).over(before)).filter(F.col("_need") & F.col(best).isNotNull()).drop("_need")
    carry = carry.withColumn(t, F.col(shard) * width)  # holds from the start of the shard on
    local = known.unionByName(carry.select(*known.columns))
    local = local.join(shards, [*k, shard]).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    both = ev.withColumn(rank, F.lit(len(names))).withColumn(best, F.lit(None).cast(local.schema[best].dataType)).unionByName(local, allowMissingColumns=True)
    so_far = Window.partitionBy(*k, shard, salt).orderBy(t, rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({name: F.max(F.when(F.col(rank) == i, F.col(best))).over(so_far) for i, name in enumerate(names)})
    return both.filter(F.col(rank) == len(names)).select(*[c for c in events.columns if c not in names], *names)
