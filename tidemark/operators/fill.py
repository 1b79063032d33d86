"""Filling missing values from similar records (problem 6), by K-prototypes clusters.

Rows are clustered on their observed numeric and categorical features: a numeric feature costs its squared distance in
robust units, a categorical one ``GAMMA`` where it differs, a missing one nothing. Every round is one pass over all rows (written
once, categories as hashes) that sends only sums and counts per cluster to the driver; rounds end when the cost of the assignment
no longer falls by ``TOLERANCE`` of itself (each round's cost is logged, and a fit that ``ROUNDS`` cut short is warned of). A missing
value is filled with the median (a number) or mode (a category) of its group and cluster, else of its group, of its
cluster, of all rows. Every filled value carries the method that filled it.

Results for odd input: null, NaN, blank and placeholder values are missing; a row with no feature at all goes to
cluster 0; a field without any value stays null, method ``none``; a null group is no group; an empty table gives an empty table;
rows with a null key are left out; repeated rows of one key are filled alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import attach_row, cut, fits, fresh, small_join

#: Texts and numbers that say "no value".
NO_TEXT = ("", "-", "--", "?", ".", "na", "n/a", "n.a.", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "#n/a")
NO_NUMBER = (-9999.0, -999.0, -99999.0, -9999.9, -999.9, 9999.0, 99999.0, 9999.9, 99999.9)
CLUSTERS = 12
ROUNDS = 60
TOLERANCE = 1e-3
GAMMA = 0.5
LEVELS = {"group_cluster": ["_g", "_cluster"], "group": ["_g"], "cluster": ["_cluster"], "all": []}
log = logging.getLogger(__name__)


def text_or_null(c: Column) -> Column:
    """The trimmed text, null where it is blank or a placeholder."""
    t = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    return F.when(~F.lower(t).isin(*NO_TEXT), t)


def number_or_null(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v) & ~v.isin(*NO_NUMBER), v)


class Prototypes:
    """Fitted clusters: scales of the numeric features, centres and modes (hashes), and the cost of each round's assignment."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, centres: np.ndarray, modes: np.ndarray, costs: tuple[float, ...] = ()):
        self.middle, self.spread, self.centres, self.modes, self.costs = middle, spread, centres, modes, costs

    def features(self, columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """rows x numeric (robust units, NaN missing) and rows x categorical (hashes, 0 missing)."""
        n = len(self.middle)
        rows = len(columns[0]) if columns else 0
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns[:n]], axis=1) if n else np.zeros((rows, 0))
        cats = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns[n:]], axis=1) if len(columns) > n else np.zeros((rows, 0), np.int64)
        return np.clip((x - self.middle) / self.spread, -4, 4), cats

    def assign(self, x: np.ndarray, cats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cluster of each row, and the cost."""
        if not len(self.centres):
            return np.zeros(len(x), int), np.zeros(len(x))
        there = ~np.isnan(x)
        x0 = np.where(there, x, 0.0)
        cost = (x0 * x0).sum(axis=1, keepdims=True) - 2 * x0 @ self.centres.T + there @ (self.centres * self.centres).T
        for j in range(cats.shape[1]):
            seen = cats[:, j] != 0
            cost += GAMMA * (seen[:, None] & (cats[:, j][:, None] != self.modes[:, j][None, :]))
        to = cost.argmin(axis=1)
        return to, cost[np.arange(len(x)), to]


def fit_prototypes(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], clusters: int = CLUSTERS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Prototypes:
    """``df`` should be written already (every round reads it); ``categorical`` are columns of hashes. Seeds are the rows of the
    least key hashes; every round uses all rows."""
    q = df.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in numeric]).first() if numeric else None
    quart = np.array([[np.nan] * 3 if q is None or q[c] is None else list(q[c]) for c in numeric], float).reshape(len(numeric), 3)
    spread = np.nan_to_num(quart[:, 2] - quart[:, 0]) / 1.349
    spread[spread <= 0] = 1.0
    model = Prototypes(np.nan_to_num(quart[:, 1]), spread, np.zeros((0, len(numeric))), np.zeros((0, len(categorical)), np.int64))
    features = df.select(*numeric, *categorical)
    seeds = df.orderBy(F.xxhash64(key), key).limit(clusters).select(*features.columns).toArrow().combine_chunks()
    if not seeds.num_rows or not seeds.num_columns:
        return model
    x, model.modes = model.features([seeds.column(i).combine_chunks() if isinstance(seeds.column(i), pa.ChunkedArray) else seeds.column(i) for i in range(seeds.num_columns)])
    model.centres = np.nan_to_num(x)
    k, n = len(x), len(numeric)
    for _ in range(rounds):
        now = model

        def sums(batches: Iterator[pa.RecordBatch], now: Prototypes = now) -> Iterator[pa.RecordBatch]:
            total, count, cost = np.zeros((k, n)), np.zeros((k, n)), 0.0
            cats: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, c = now.features(batch.columns)
                to, own = now.assign(x, c)
                cost += float(own.sum())
                there = ~np.isnan(x)
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), to] = 1
                total += one.T @ np.where(there, x, 0)
                count += one.T @ there
                for j in range(c.shape[1]):
                    codes, at = np.unique(c[:, j], return_inverse=True)
                    table = np.bincount(to * len(codes) + at, minlength=k * len(codes)).reshape(k, len(codes))
                    for cluster, code in zip(*np.nonzero(table)):
                        if codes[code]:
                            name = (int(cluster), j, int(codes[code]))
                            cats[name] = cats.get(name, 0) + int(table[cluster, code])
            i, j = np.nonzero(count)
            rows = [(-1, -1, 0, cost, 1.0), *zip(i.tolist(), j.tolist(), [0] * len(i), total[i, j].tolist(), count[i, j].tolist()), *((a, n + b, c, 0.0, float(m)) for (a, b, c), m in cats.items())]
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["cluster", "feature", "code", "s", "n"])

        parts = features.mapInArrow(sums, "cluster int, feature int, code bigint, s double, n double")
        # at most clusters x features rows come to the driver: of a category only the mode
        one = parts.groupBy("cluster", "feature", "code").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).groupBy("cluster", "feature").agg(F.max(F.struct("n", "code", "s")).alias("top"))
        centres, modes, cost = model.centres.copy(), model.modes.copy(), 0.0
        for r in one.collect():
            if r["cluster"] < 0:
                cost = r["top"]["s"]
            elif r["feature"] < n:
                centres[r["cluster"], r["feature"]] = r["top"]["s"] / r["top"]["n"]
            else:
                modes[r["cluster"], r["feature"] - n] = r["top"]["code"]
        log.info("round %d: cost %.6g", len(model.costs) + 1, cost)
        if model.costs and cost >= model.costs[-1] * (1 - tolerance):
            model.costs += (cost,)
            return model
        model = Prototypes(model.middle, model.spread, centres, modes, (*model.costs, cost))
    if len(model.costs) > 1 and rounds == ROUNDS:
        log.warning("clusters still moved after %d rounds: cost %.6g, before %.6g", rounds, model.costs[-1], model.costs[-2])
    return model


def fill_similar(
    df: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    fill_numbers: Sequence[str],
    fill_categories: Sequence[str],
    group: str,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per missing value: key, group, cluster, field, filled_num, filled_cat, method.

    The features of ``df`` must already be clean (``number_or_null``, ``text_or_null``): null is missing.
    """
    kept = list(dict.fromkeys([key, group, *fill_numbers, *fill_categories]))
    nums, cats = [f"_n{i}" for i in range(len(numeric))], [f"_c{i}" for i in range(len(categorical))]
    hashed = [F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))).alias(n) for c, n in zip(categorical, cats)]
    clean = cut(df.filter(F.col(key).isNotNull()).select(*kept, *[F.col(c).cast("double").alias(n) for c, n in zip(numeric, nums)], *hashed))
    model = fit_prototypes(clean, key, nums, cats, clusters, rounds)
    m = len(kept)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, _ = model.assign(*model.features(batch.columns[m:])) if batch.num_columns > m else (np.zeros(batch.num_rows, int), None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:m], pa.array(to, pa.int32())], names=[*kept, "_cluster"])

    kinds = dict(clean.dtypes)
    labelled = cut(clean.mapInArrow(label, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", _cluster int"))
    outs = []
    for f, is_number in [*((f, True) for f in fill_numbers), *((f, False) for f in fill_categories)]:
        known = labelled.filter(F.col(f).isNotNull()).select(F.col(group).alias("_g"), "_cluster", F.col(f).alias("_v"))
        sets = list(LEVELS.values())
        if is_number:
            levels = known.groupingSets(sets, "_g", "_cluster").agg(F.percentile_approx(F.col("_v").cast("double"), 0.5, 1000).alias("_m"), F.grouping_id().alias("_level"))
        else:
            counts = known.groupBy("_g", "_cluster", "_v").agg(F.count(F.lit(1)).alias("_n")).groupingSets([[*by, "_v"] for by in sets], "_g", "_cluster", "_v").agg(F.sum("_n").alias("_n"), F.call_function("div", F.grouping_id(), F.lit(2).cast("long")).alias("_level"))
            levels = counts.groupBy("_g", "_cluster", "_level").agg(F.max(F.struct("_n", "_v"))["_v"].alias("_m"))
        levels = cut(levels)
        fit = fits(levels)
        gaps = labelled.filter(F.col(f).isNull()).select(key, F.col(group).alias("_g"), "_cluster")
        for number, (name, by) in enumerate(LEVELS.items()):
            some = levels.filter(F.col("_level") == number).select(*by, F.col("_m").alias(f"_m_{name}"))
            gaps = small_join(gaps, some, by, fit) if by else attach_row(gaps, some)
        method = F.coalesce(*[F.when(F.col(f"_m_{n}").isNotNull(), F.lit(n)) for n in LEVELS], F.lit("none"))
        filled = F.coalesce(*[F.col(f"_m_{n}") for n in LEVELS])
        num, cat = (filled, F.lit(None).cast("string")) if is_number else (F.lit(None).cast("double"), filled)
        outs.append(gaps.select(key, F.col("_g").alias(group), "_cluster", F.lit(f).alias("field"), num.alias("filled_num"), cat.alias("filled_cat"), method.alias("method")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.withColumnRenamed("_cluster", "cluster")


def fill_runs(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Add ``out``: ``name``, or where it is null the name whose rows enclose the row by ``key`` (files that lie one behind the
    other, each named at both ends); null where none does. Rows with a null key keep their name."""
    from tidemark.operators.known_at import as_known

    df = cut(df)  # read four times below
    one = fresh(df, "_fr_one")
    spans = df.filter(F.col(name).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).withColumn(one, F.lit(0))
    gaps = df.filter(F.col(name).isNull()).withColumn(one, F.lit(0))
    found = as_known(gaps, cut(spans), {one: one}, key, {"_fr": F.col("lo")}, ["lo"], ["hi", "name"], width=1 << 20)
    found = found.withColumn(out, F.when(F.col(key) <= F.col("_fr.hi"), F.col("_fr.name"))).drop("_fr", one)
    return df.filter(F.col(name).isNotNull()).withColumn(out, F.col(name)).unionByName(found)
