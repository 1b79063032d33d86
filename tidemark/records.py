"""The record log: schema, invariants and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("measurement", "static", "forecast", "label")
LOG_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("feature_name", T.StringType(), False),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_cat", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("event_us", T.LongType(), False),
        T.StructField("available_us", T.LongType(), False),
        T.StructField("valid_us", T.LongType()),
        T.StructField("issued_us", T.LongType()),
        T.StructField("revision_id", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    ]
)
STREAM = ("entity_id", "source_id", "feature_name")
#: What makes two deliveries of a record id the same record: everything but when and how it arrived.
SIGNATURE = ("kind", *STREAM, "value_num", "value_cat", "unit", "event_us", "valid_us", "issued_us", "revision_id", "quality")


def from_timestamps(df: DataFrame) -> DataFrame:
    """A log with TIMESTAMP columns (event_time, ...) to one with µs (event_us, ...)."""
    pairs = {"event_time": "event_us", "available_time": "available_us", "valid_time": "valid_us", "issued_time": "issued_us"}
    for old, new in pairs.items():
        if old in df.columns:
            df = df.withColumn(new, F.unix_micros(F.col(old).cast("timestamp"))).drop(old)
    return canonical(df)


def canonical(df: DataFrame) -> DataFrame:
    """Exactly the columns of ``LOG_SCHEMA``; columns that are missing are null, further ones are dropped."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in LOG_SCHEMA])


def violations() -> dict[str, Column]:
    """Name -> condition that holds for records that break the invariants."""
    kind, event, available = F.col("kind"), F.col("event_us"), F.col("available_us")
    forecast = kind == "forecast"
    missing = F.lit(False)
    for c in ("record_id", "kind", *STREAM, "event_us", "available_us"):
        missing = missing | F.col(c).isNull()
    return {
        "a required field is null": missing,
        "unknown kind": ~kind.isin(*KINDS),
        "a forecast needs issued_time and valid_time": forecast & (F.col("issued_us").isNull() | F.col("valid_us").isNull()),
        "a forecast can't be available before it is issued": forecast & (available < F.col("issued_us")),
        "only forecasts carry issued_time or valid_time": ~forecast & (F.col("issued_us").isNotNull() | F.col("valid_us").isNotNull()),
        "available before its event": kind.isin("measurement", "label") & (available < event),
        "a number that isn't finite": F.isnan("value_num") | (F.abs(F.col("value_num")) == float("inf")),
        "both a number and a category": F.col("value_num").isNotNull() & F.col("value_cat").isNotNull(),
    }


def validated(df: DataFrame) -> DataFrame:
    """The log, with a query that fails at the first record that breaks an invariant."""
    why = F.lit(None).cast("string")
    for text, broken in violations().items():
        why = F.when(F.coalesce(broken, F.lit(False)), F.lit(text)).otherwise(why)
    checked = F.when(why.isNull(), F.col("available_us")).otherwise(F.raise_error(F.concat(F.lit("record "), F.coalesce("record_id", F.lit("null")), F.lit(": "), why)).cast("long"))
    return df.withColumn("available_us", checked)


def deduplicate(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per record id: its earliest delivery. A query over ids that come with differing content fails.

    Deliveries are combined before the shuffle; the content is compared by a hash, not collected. ``keep``: the columns
    that are needed further on; the others neither travel nor come out (all of them still count as content).
    """
    content = F.xxhash64(*SIGNATURE)
    if keep is not None:
        rest = [c for c in keep if c not in ("record_id", "available_us")]
        one = df.groupBy("record_id").agg(F.min(F.struct("available_us", *rest)).alias("d"), F.min(content).alias("lo"), F.max(content).alias("hi"))
        return one.select("record_id", _agreed().alias("available_us"), *[F.col(f"d.{c}").alias(c) for c in rest])
    rest = [f.name for f in LOG_SCHEMA if f.name not in ("record_id", "available_us", "provenance")]
    # a map can't be ordered: it travels as its sorted entries
    entries = F.array_sort(F.map_entries("provenance"))
    first = F.min(F.struct("available_us", entries.alias("provenance"), *rest)).alias("d")
    one = df.groupBy("record_id").agg(first, F.min(content).alias("lo"), F.max(content).alias("hi"))
    one = one.withColumn("available_us", _agreed())
    return one.select(*[F.map_from_entries("d.provenance").alias("provenance") if f.name == "provenance" else F.col(f.name) if f.name in ("record_id", "available_us") else F.col(f"d.{f.name}").alias(f.name) for f in LOG_SCHEMA])


def _agreed() -> Column:
    conflict = F.raise_error(F.concat(F.lit("record id with differing contents: "), "record_id")).cast("long")
    return F.when(F.col("lo") == F.col("hi"), F.col("d.available_us")).otherwise(conflict)


def late_records(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Records of the later reading that the earlier one didn't have."""
    return later.join(earlier.select("record_id").distinct(), "record_id", "left_anti")


def available_by(log: DataFrame, cutoff_us: int) -> DataFrame:
    from tidemark.boundaries import visible

    return log.filter(visible(F.col("available_us"), F.lit(cutoff_us)))


def lag_summary(log: DataFrame) -> DataFrame:
    """Per kind and stream: rows, nulls, distinct ids, ranges and the greatest delivery lag, in one pass."""
    null = F.col("value_num").isNull() & F.col("value_cat").isNull()
    return log.groupBy("kind", "source_id", "feature_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(null, True)).alias("n_missing"),
        F.count_distinct("entity_id").alias("n_entities"),
        F.min("event_us").alias("first_event_us"),
        F.max("event_us").alias("last_event_us"),
        F.max(F.col("available_us") - F.col("event_us")).alias("max_lag_us"),
    )


def duplicates(log: DataFrame) -> DataFrame:
    """Per record id that comes more than once: deliveries, and whether their contents conflict."""
    content = F.xxhash64(*SIGNATURE)
    n = log.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_deliveries"), (F.min(content) != F.max(content)).alias("conflict"))
    return n.filter("n_deliveries > 1")


def join_cardinality(log: DataFrame) -> DataFrame:
    """Distinct records per (entity, source, feature, event, valid): more than one makes equi-joins multiply."""
    keys = [*STREAM, "event_us", "valid_us"]
    n = log.groupBy(*keys).agg(F.count_distinct("record_id").alias("n_records"))
    return n.groupBy("source_id", "feature_name").agg(F.max("n_records").alias("max_per_key"), F.count(F.lit(1)).alias("n_keys"))
