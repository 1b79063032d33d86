import math
import random

import numpy as np
import pytest

from tidemark.operators import models
from tidemark.plans.evaluation import Fold, Split, examples, label_index, naive_scales, paired_differences, revealed_by, scores, us_of, usable_labels
from tidemark.records import LOG_SCHEMA

H = 3_600_000_000


def labels(spark, rows):
    return spark.createDataFrame([(i, "label", e, "y", "t", v, None, None, t, a, None, None, None, None, {}) for i, e, t, a, v in rows], LOG_SCHEMA)


def test_label_index_and_examples(spark):
    log = labels(spark, [("a", "e", 5, 9, 1.0), ("b", "e", 5, 12, 2.0), ("c", "x", 7, 8, None)])
    ix = label_index(log, "y", "t")
    assert sorted(tuple(r) for r in ix.collect() if r["entity_id"] == "e") == [("e", 5, 2.0, 12)]
    feats = spark.createDataFrame([(1, "e", 3, 0.5), (2, "e", 4, 0.6)], "request_ix bigint, entity_id string, prediction_us bigint, f double")
    ex = examples(feats, ix, 2)
    assert [(r["f"], r["target"]) for r in ex.collect()] == [(0.5, 2.0)]
    assert revealed_by(ex, 11).count() == 0 and revealed_by(ex, 12).count() == 1


def test_usable_labels(spark):
    rng = random.Random(1)
    rows = [(f"l{i}", "e", t, t + rng.randrange(50), 1.0) for i, t in enumerate(rng.choices(range(100), k=60))]
    asked = [(i, "e", t) for i, t in enumerate(rng.choices(range(160), k=30))]
    req = spark.createDataFrame(asked, "request_ix bigint, entity_id string, prediction_us bigint")
    got = {r["request_ix"]: r["usable_labels"] for r in usable_labels(labels(spark, rows), req, width_us=7).collect()}
    assert got == {i: sum(r[3] <= t for r in rows) for i, _, t in asked}
    assert {r["usable_labels"] for r in usable_labels(labels(spark, []), req).collect()} == {0}


def test_split(spark):
    s = Split((Fold("train", 0, 10 * H), Fold("test", 12 * H, 20 * H)), gap_us=2 * H, held_out=("q",))
    who = spark.createDataFrame([("e",), ("q",)], "entity_id string")
    assert s.times(who, "train", 3 * H).count() == 4 and s.times(who, "test", 4 * H).count() == 4
    assert max(r["prediction_us"] for r in s.times(who, "train", 3 * H).collect()) == 9 * H
    df = spark.createDataFrame([("e", 0), ("e", 10 * H), ("q", 5), ("q", 13 * H)], "entity_id string, prediction_us bigint")
    assert s.of(df, "train").count() == 1 and s.of(df, "test").count() == 1
    for bad in ((Fold("a", 5, 5),), (Fold("a", 0, 5), Fold("b", 4, 9))):
        with pytest.raises(ValueError):
            Split(bad)
    assert us_of("1970-01-01T01:00:00+01:00") == 0
    with pytest.raises(ValueError):
        us_of("1970-01-01T00:00:00")


def test_scores(spark):
    rows = [("e", 1.0, 2.0), ("e", 3.0, 2.0), ("x", 5.0, 8.0)]
    df = spark.createDataFrame(rows, "entity_id string, target double, prediction double")
    scale = spark.createDataFrame([("e", 0.5), ("x", 3.0)], "entity_id string, scale double")
    r = scores(df, scale).collect()[0]
    e, y = np.array([1, -1, 3.0]), np.array([1, 3, 5.0])
    assert r["n"] == 3 and math.isclose(r["mae"], 5 / 3) and math.isclose(r["rmse"], math.sqrt((e**2).mean())) and math.isclose(r["r2"], 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert math.isclose(r["bias"], 1.0) and math.isclose(r["mase"], (2 + 2 + 1) / 3)
    assert scores(spark.createDataFrame([("e", 1.0, 2.0)] * 2, df.schema)).collect()[0]["r2"] is None
    with pytest.raises(Exception, match="prediction is missing"):
        scores(spark.createDataFrame([("e", 1.0, None)], df.schema)).collect()


def test_naive_scale_and_pairs(spark):
    ix = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate([1, 4, 2, 2])] + [("k", 0, 3.0), ("k", 1, 3.0)], "entity_id string, label_us bigint, target double")
    assert [tuple(r) for r in naive_scales(ix, 1).collect()] == [("e", 5 / 3)]
    a = spark.createDataFrame([("e", 1, 5.0, 4.0)], "entity_id string, prediction_us bigint, prediction double, target double")
    b = spark.createDataFrame([("e", 1, 4.5, 4.0), ("e", 2, 1.0, 1.0)], a.schema)
    assert [r["difference"] for r in paired_differences(a, b).collect()] == [0.5]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 1] + 5 + rng.normal(0, 0.1, 300)
    rows = [(i, float(a) if i % 9 else None, float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, target double"), rows


def test_ridge_matches_numpy(spark, data):
    df, rows = data
    m = models.moments(df, ["a", "b", "c"])
    raw = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    mean = np.nanmean(raw, axis=0)
    z = np.where(np.isnan(raw), mean, raw)
    scale = z.std(axis=0)
    z = (z - mean) / scale
    y = np.array([r[4] for r in rows])
    for penalty in models.PENALTIES:
        want = np.linalg.solve(z.T @ z + penalty * np.eye(3), z.T @ (y - y.mean()))
        assert np.allclose(models.ridge_weights(m, penalty), want)
    p = [r["prediction"] for r in models.ridge_predict(df, m, models.ridge_weights(m, 1.0)).orderBy("i").collect()]
    assert np.allclose(p, y.mean() + z @ models.ridge_weights(m, 1.0))
    _, best, losses = models.tune_ridge(df, df, ["a", "b", "c"])
    assert losses[best] == min(losses.values())
    with pytest.raises(ValueError):
        models.moments(df.selectExpr("cast(null as double) a", "target"), ["a"])
    with pytest.raises(ValueError):
        models.moments(df.filter("false"), ["a"])


def test_search_and_trees(spark, data):
    df, _ = data
    train, valid = df.filter("i < 200"), df.filter("i >= 200")
    assert set(models.greedy_selection(train, valid, ["a", "b", "c"], 2)) == {"a", "b"}
    assert {"a", "b"} <= set(models.random_selection(train, valid, ["a", "b", "c"], 3, 12))
    got = models.boosted_trees(train, valid, ["a", "b"], rounds=5).selectExpr("avg(abs(prediction - target)) e").collect()[0]["e"]
    assert got < 1.5
    assert models.identity(df, "a").selectExpr("max(abs(prediction - a)) d").collect()[0]["d"] == 0
