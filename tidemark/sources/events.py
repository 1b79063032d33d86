"""The ``events`` test table as a record log, requests and entity graph (deterministic integer arithmetic only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.boundaries import bucket_of
from tidemark.functions.common import table
from tidemark.records import canonical

GRID_US = 900_000_000
HOUR_US = 3_600_000_000
#: Requests: every 6 h from 2024-01-02 00:00 UTC on, for 29 days.
FIRST_US, EVERY_US, TIMES = 1_704_153_600_000_000, 6 * HOUR_US, 116

SOURCES = [
    {"source_id": "app", "feature_name": "value", "kind": "measurement", "value_type": "number", "max_input_rate_per_hour": 60},
    {"source_id": "app", "feature_name": "type", "kind": "measurement", "value_type": "category", "max_input_rate_per_hour": 60},
    {"source_id": "model", "feature_name": "value_fc", "kind": "forecast", "value_type": "number", "max_input_rate_per_hour": 60, "max_forecast_horizon": "12h"},
    {"source_id": "shop", "feature_name": "purchase", "kind": "label", "value_type": "number", "max_input_rate_per_hour": 60},
    {"source_id": "crm", "feature_name": "balance", "kind": "static", "value_type": "number"},
]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL")
    # events.ts has no zone: its wall clock is read as UTC
    us = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")) if dict(e.dtypes)["ts"] == "timestamp" else F.unix_date(F.col("ts").cast("date")).cast("long") * 24 * HOUR_US + (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1_000_000
    at = bucket_of(us, F.lit(GRID_US)) * GRID_US
    return e.select("event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("user_id").cast("string").alias("entity_id"), "event_type", "value", at.alias("event_us"), (at + (F.col("event_id") * 7919) % 5 * GRID_US).alias("available_us"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements (with redeliveries), a category, forecasts, labels and static facts."""
    b = _base(spark, sf_dir)
    value = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    number = b.select(F.col("id").alias("record_id"), F.lit("measurement").alias("kind"), "entity_id", F.lit("app").alias("source_id"), F.lit("value").alias("feature_name"), value.alias("value_num"), "event_us", "available_us", "event_id")
    again = number.filter("event_id % 50 = 0").withColumn("available_us", F.col("available_us") + 3 * HOUR_US)
    kind = b.select(F.concat(F.lit("c"), "id").alias("record_id"), F.lit("measurement").alias("kind"), "entity_id", F.lit("app").alias("source_id"), F.lit("type").alias("feature_name"), F.col("event_type").alias("value_cat"), "event_us", "available_us")
    valid = (bucket_of(F.col("event_us"), F.lit(HOUR_US)) + 1 + F.col("event_id") % 6) * HOUR_US
    forecast = b.filter("event_type = 'view'").select(F.concat(F.lit("f"), "id").alias("record_id"), F.lit("forecast").alias("kind"), "entity_id", F.lit("model").alias("source_id"), F.lit("value_fc").alias("feature_name"), F.col("value").alias("value_num"), "event_us", "available_us", valid.alias("valid_us"), F.col("event_us").alias("issued_us"))
    label = b.filter("event_type = 'purchase'").select(F.concat(F.lit("l"), "id").alias("record_id"), F.lit("label").alias("kind"), "entity_id", F.lit("shop").alias("source_id"), F.lit("purchase").alias("feature_name"), F.col("value").alias("value_num"), "event_us", (F.col("event_us") + 6 * HOUR_US).alias("available_us"))
    c = table(spark, sf_dir, "customer")
    static = c.select(F.concat(F.lit("s"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("record_id"), F.lit("static").alias("kind"), F.col("c_custkey").cast("string").alias("entity_id"), F.lit("crm").alias("source_id"), F.lit("balance").alias("feature_name"), F.col("c_acctbal").cast("double").alias("value_num"), F.lit(FIRST_US + 48 * HOUR_US).alias("event_us"), F.lit(FIRST_US - 24 * HOUR_US).alias("available_us"))
    out = canonical(number)
    for part in (again, kind, forecast, label, static):
        out = out.unionByName(canonical(part))
    return out


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id").distinct()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(TIMES - 1))).alias("k")
    return u.select("user_id", k).select((F.col("user_id") * 1000 + F.col("k")).cast("long").alias("request_ix"), F.col("user_id").cast("string").alias("entity_id"), (F.lit(FIRST_US) + F.col("k").cast("long") * EVERY_US).alias("prediction_us"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is related to the users one and two numbers on."""
    on = F.explode(F.array(F.lit(1), F.lit(2))).alias("d")
    return users(spark, sf_dir).select("user_id", on).select(F.lit("next").alias("graph"), F.col("user_id").cast("string").alias("entity_id"), (F.col("user_id") + F.col("d")).cast("string").alias("related_id"))


#: The same, for DuckDB.
SQL = f"""
WITH ev AS (
  SELECT event_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CAST(user_id AS VARCHAR) AS e, event_type AS c, value AS raw,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v,
         epoch_us(ts) // {GRID_US} * {GRID_US} AS ev, epoch_us(ts) // {GRID_US} * {GRID_US} + (event_id * 7919) % 5 * {GRID_US} AS av
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL),
users AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL),
req AS (SELECT CAST(user_id * 1000 + k AS BIGINT) AS request_ix, CAST(user_id AS VARCHAR) AS e, {FIRST_US} + k * {EVERY_US} AS t
        FROM users, range(0, {TIMES}) AS r(k)),
fc AS (SELECT 'f' || id AS id, e, raw AS v, ev AS issued, av, (ev // {HOUR_US} + 1 + event_id % 6) * {HOUR_US} AS valid FROM ev WHERE c = 'view'),
lab AS (SELECT 'l' || id AS id, e, raw AS v, ev, ev + 6 * {HOUR_US} AS av FROM ev WHERE c = 'purchase'),
edges AS (SELECT CAST(user_id AS VARCHAR) AS e, CAST(user_id + d AS VARCHAR) AS other FROM users, (VALUES (1), (2)) AS x(d))
"""
