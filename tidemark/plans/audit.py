"""Per-request audit: which records a value used, how many could have been used, and which were withheld as not yet there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.boundaries import bucket_of, visible
from tidemark.plans.compiler import ExecutionPlan
from tidemark.plans.engine import SHUFFLED, US_DAY
from tidemark.records import deduplicate

WITHHELD = 3


def used_records(vectors: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """request_ix, output, record_id of every record behind a value (``vectors``: executed with lineage)."""
    rows = F.array(*[F.struct(F.lit(o).alias("output"), F.col(f"{o}__lineage").alias("ids")) for o in outputs])
    return vectors.select("request_ix", F.explode(rows).alias("x")).select("request_ix", "x.output", F.explode("x.ids").alias("record_id"))


def _numbered(plan: ExecutionPlan, log: DataFrame, requests: DataFrame, width_us: int) -> tuple[DataFrame, DataFrame]:
    """Records of the plan's streams with their number in order of arrival, and requests x streams with the number of those released.

    Streams are cut into shards of ``width_us``: a running count goes over the shards' totals, another within each shard.
    """
    key = ["entity_id", "source_id", "feature_name"]
    keep = F.lit(False)
    for s, f in plan.streams:
        keep = keep | ((F.col("source_id") == s) & (F.col("feature_name") == f))
    log = deduplicate(log.filter(keep), key).select(*key, "record_id", "available_us", F.col("available_us").alias("t"), F.lit(0).alias("rank"))
    streams = F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(f).alias("feature_name")) for s, f in sorted(plan.streams)])
    asked = requests.select("request_ix", "entity_id", F.col("prediction_us").alias("t"), F.explode(streams).alias("s")).select("request_ix", "entity_id", "t", "s.*", F.lit(1).alias("rank"))
    rows = log.unionByName(asked, allowMissingColumns=True).withColumn("shard", bucket_of(F.col("t"), F.lit(width_us)))
    sizes = rows.groupBy(*key, "shard").agg(F.count("record_id").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy(*key, "shard").orderBy("t", "rank", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.hint(SHUFFLED).join(sizes, [*key, "shard"]).withColumn("n", F.col("_before") + F.count("record_id").over(so_far))
    return rows.filter("rank = 0").select(*key, "record_id", "available_us", "n"), rows.filter("rank = 1").select("request_ix", *key, "n")


def released_records(plan: ExecutionPlan, log: DataFrame, requests: DataFrame, width_us: int = 7 * US_DAY) -> DataFrame:
    """request_ix and stream of the request's entity -> ``released``: the records that could have been used by then."""
    _, asked = _numbered(plan, log, requests, width_us)
    return asked.select("request_ix", "source_id", "feature_name", F.col("n").alias("released"))


def withheld_records(plan: ExecutionPlan, log: DataFrame, requests: DataFrame, most: int = WITHHELD, width_us: int = 7 * US_DAY) -> DataFrame:
    """request_ix, stream and the next ``most`` records of the request's entity to arrive after it, however late.

    An equi-join on the number of the record: each request meets ``most`` records of a stream.
    """
    records, asked = _numbered(plan, log, requests, width_us)
    asked = asked.select("request_ix", "entity_id", "source_id", "feature_name", "n", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("rank")).withColumn("n", F.col("n") + F.col("rank"))
    return asked.hint(SHUFFLED).join(records, ["entity_id", "source_id", "feature_name", "n"]).select("request_ix", "source_id", "feature_name", "record_id", "available_us", "rank")


def window_occupancy(plan: ExecutionPlan, log: DataFrame, requests: DataFrame) -> DataFrame:
    """Per stream the most records any request finds within the plan's reach, beside the compiled bound."""
    rows = []
    for s, f in plan.streams:
        nodes = [plan.nodes[n] for n in plan.needed if plan.nodes[n].stream == (s, f) and plan.nodes[n].lookback_us]
        if nodes:
            top = max(nodes, key=lambda n: n.lookback_us)
            rows.append((s, f, top.lookback_us, max(n.state_records for n in nodes)))
    if not rows:
        return requests.sparkSession.createDataFrame([], "source_id string, feature_name string, peak bigint, bound bigint")
    reach = F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(f).alias("feature_name"), F.lit(w).cast("long").alias("w"), F.lit(b).cast("long").alias("bound")) for s, f, w, b in rows])
    asked = requests.select("request_ix", "entity_id", F.col("prediction_us").alias("t"), F.explode(reach).alias("r")).select("request_ix", "entity_id", "t", "r.*")
    asked = asked.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("t") - F.col("w"), F.col("w")), bucket_of(F.col("t"), F.col("w")))))
    width = F.lit(None).cast("long")
    for s, f, w, _ in rows:
        width = F.when((F.col("source_id") == s) & (F.col("feature_name") == f), F.lit(w).cast("long")).otherwise(width)
    log = deduplicate(log.filter(width.isNotNull()), ("entity_id", "source_id", "feature_name", "event_us")).withColumn("bucket", bucket_of(F.col("event_us"), width)).select("entity_id", "source_id", "feature_name", "bucket", "event_us", "available_us")
    hit = asked.hint(SHUFFLED).join(log, ["entity_id", "source_id", "feature_name", "bucket"]).filter(visible(F.col("available_us"), F.col("t")) & (F.col("event_us") >= F.col("t") - F.col("w")) & (F.col("event_us") <= F.col("t")))
    return hit.groupBy("request_ix", "source_id", "feature_name", "bound").count().groupBy("source_id", "feature_name", "bound").agg(F.max("count").alias("peak")).select("source_id", "feature_name", "peak", "bound")
