"""Labels, examples, splits, metrics and paired differences, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.boundaries import in_fold, revealed, visible


def us_of(text: str) -> int:
    """µs of an ISO text with a zone; texts without one are refused."""
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if t.tzinfo is None:
        raise ValueError(f"{text!r} names no time zone")
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


@dataclass(frozen=True)
class Fold:
    name: str
    start_us: int
    end_us: int


@dataclass(frozen=True)
class Split:
    """Half-open folds in time order with a gap between them; held-out entities appear in the last fold only."""

    folds: tuple[Fold, ...]
    gap_us: int = 0
    held_out: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for f in self.folds:
            if f.start_us >= f.end_us:
                raise ValueError(f"fold {f.name!r} is empty")
        for a, b in zip(self.folds, self.folds[1:]):
            if b.start_us - a.end_us < self.gap_us:
                raise ValueError(f"folds {a.name!r} and {b.name!r} are closer than the gap")

    def fold(self, name: str) -> Fold:
        return next(f for f in self.folds if f.name == name)

    def times(self, entities: DataFrame, name: str, every_us: int) -> DataFrame:
        """Requests every ``every_us`` from the start of a fold on: request_ix, entity_id, prediction_us."""
        f = self.fold(name)
        steps = (f.end_us - f.start_us - 1) // every_us
        if name != self.folds[-1].name and self.held_out:
            entities = entities.filter(~F.col("entity_id").isin(*self.held_out))
        grid = entities.select("entity_id", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
        at = F.lit(f.start_us) + F.col("k").cast("long") * every_us
        return grid.select(F.xxhash64("entity_id", "k").alias("request_ix"), "entity_id", at.alias("prediction_us"))

    def of(self, df: DataFrame, name: str, t: str = "prediction_us") -> DataFrame:
        f = self.fold(name)
        df = df.filter(in_fold(F.col(t), F.lit(f.start_us), F.lit(f.end_us)))
        if name != self.folds[-1].name and self.held_out:
            df = df.filter(~F.col("entity_id").isin(*self.held_out))
        return df


def label_index(log: DataFrame, source: str, feature: str) -> DataFrame:
    """entity_id, label_us -> target, label_available_us: per entity and event the label that arrived last; categories are null."""
    labels = log.filter((F.col("kind") == "label") & (F.col("source_id") == source) & (F.col("feature_name") == feature))
    best = labels.groupBy("entity_id", F.col("event_us").alias("label_us")).agg(F.max(F.struct("available_us", "record_id", "value_num")).alias("b"))
    return best.select("entity_id", "label_us", F.col("b.value_num").alias("target"), F.col("b.available_us").alias("label_available_us"))


def examples(features: DataFrame, labels: DataFrame, horizon_us: int) -> DataFrame:
    """Features at t with the label of t + horizon of the same entity; rows without a label are left out."""
    at = features.withColumn("label_us", F.col("prediction_us") + horizon_us)
    return at.join(labels, ["entity_id", "label_us"])


def revealed_by(rows: DataFrame, now_us: int) -> DataFrame:
    """Examples whose label was known by then."""
    return rows.filter(revealed(F.col("label_available_us"), F.lit(now_us)))


def usable_labels(log: DataFrame, requests: DataFrame, width_us: int = 86_400_000_000) -> DataFrame:
    """request_ix -> the number of labels (of all entities) revealed by its time.

    Labels are counted per time bucket first; a request adds the buckets before its own, as a running sum, and the labels
    of its own bucket that were revealed in time.
    """
    bucket = lambda c: F.call_function("div", F.col(c), F.lit(width_us))
    labels = log.filter("kind = 'label'").select("available_us", bucket("available_us").alias("bucket"))
    full = labels.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    asked = requests.select("request_ix", "prediction_us", bucket("prediction_us").alias("bucket"))
    spans = full.select("bucket", "_n").unionByName(asked.select("bucket", F.lit(0).cast("long").alias("_n")).distinct()).groupBy("bucket").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket: days
    spans = spans.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    per_time = asked.select("prediction_us", "bucket").distinct().join(labels, "bucket", "left")
    own = per_time.groupBy("prediction_us", "bucket").agg(F.count(F.when(visible(F.col("available_us"), F.col("prediction_us")), True)).alias("_own"))
    total = own.join(spans, "bucket").select("prediction_us", (F.col("_own") + F.col("_before")).alias("usable_labels"))
    return asked.join(total, "prediction_us").select("request_ix", "usable_labels")


def naive_scales(labels: DataFrame, season: int) -> DataFrame:
    """Per entity the mean absolute change of the target over ``season`` labels (the unit of MASE)."""
    order = Window.partitionBy("entity_id").orderBy("label_us")
    d = labels.filter(F.col("target").isNotNull()).withColumn("_d", F.abs(F.col("target") - F.lag("target", season).over(order)))
    return d.groupBy("entity_id").agg(F.avg("_d").alias("scale")).filter(F.col("scale") > 0)


def scores(rows: DataFrame, scales: DataFrame | None = None, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """One row: n, mae, rmse, r2 (null for a constant target), bias, and mase with per-entity scales.

    A missing prediction fails the query instead of being skipped. One pass: r2 comes from sums.
    """
    p = F.when(F.col(prediction).isNotNull() & ~F.isnan(prediction), F.col(prediction)).otherwise(F.raise_error(F.lit("a prediction is missing")).cast("double"))
    rows = rows.withColumns({"_e": p - F.col(target), "_y": F.col(target)})
    mase = F.lit(None).cast("double")
    if scales is not None:
        rows = rows.join(scales.select("entity_id", "scale"), "entity_id", "left")
        mase = F.avg(F.abs("_e") / F.col("scale"))
    out = rows.agg(F.count("_e").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.sum(F.col("_e") * F.col("_e")).alias("_ee"), (F.var_pop("_y") * F.count("_y")).alias("_yy"), F.avg("_e").alias("bias"), mase.alias("mase"))
    return out.select("n", "mae", "rmse", F.when(F.col("_yy") > 0, 1 - F.col("_ee") / F.col("_yy")).alias("r2"), "bias", "mase")


def paired_differences(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("entity_id", "prediction_us")) -> DataFrame:
    """Absolute error of the first less that of the second, per common example (both: keys, prediction, target)."""
    error = lambda: F.abs(F.col("prediction") - F.col("target"))
    a = left.select(*keys, error().alias("_a"))
    b = right.select(*keys, error().alias("_b"))
    return a.join(b, list(keys)).select(*keys, (F.col("_a") - F.col("_b")).alias("difference"))

