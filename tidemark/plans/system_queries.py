"""Queries of what surrounds the operators: the log, lineage, late data, labels, scores, audits; with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import records
from tidemark.functions.common import cut
from tidemark.operators import models
from tidemark.plans import audit, evaluation
from tidemark.plans.engine import execute
from tidemark.plans.feature_queries import BODIES, CATEGORY, HOUR, NUMBER, OFF_TIE, plan_of, run
from tidemark.sources import events
from tidemark.streaming import late
from tidemark.streaming.replay import replay_batch

SQL = events.SQL
_MEAN = [{"id": "v", "op": "mean", "params": NUMBER | {"window": "24h"}}]
_LAST = [{"id": "v", "op": "last", "params": NUMBER}]


def _r(c: str):
    return (F.round(F.col(c) + OFF_TIE, 6) + F.lit(0.0)).alias(c)


def log_dedup(spark: SparkSession, d: str) -> DataFrame:
    one = records.deduplicate(events.log(spark, d))
    return one.groupBy("source_id", "feature_name", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("available_us") % 1_000_000_007).alias("arrivals"))


def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.lag_summary(records.validated(events.log(spark, d)))


def log_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return records.duplicates(events.log(spark, d))


def log_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return records.join_cardinality(events.log(spark, d))


def lineage(spark: SparkSession, d: str) -> DataFrame:
    df = run(spark, d, _MEAN, lineage=True)
    return df.select("request_ix", F.array_join("v__lineage", ",").alias("ids"), F.col("v__available_us").alias("available_us"))


def _early_late(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = records.deduplicate(events.log(spark, d).filter("source_id = 'app' AND feature_name = 'value'"))
    late_one = (F.substring("record_id", 7, 6).cast("int") % 11 == 0) & (F.col("available_us") >= events.FIRST_US + 10 * 24 * HOUR)
    return log.filter(~late_one), log.filter(late_one)


#: A program that reads a related entity's values too.
_NEAR = [*_MEAN, {"id": "near", "op": "cross_entity_mean", "params": NUMBER | {"entity_ref": "next"}}]


def _late(policy: str, precise: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        early, later = _early_late(spark, d)
        plan = plan_of(_NEAR, ["v", "near"]) if precise else plan_of(_MEAN, ["v"])
        out = late.execute_with_late(plan, early, later, events.requests(spark, d), policy, events.graph(spark, d), precise)
        return out.select("request_ix", _r("v"), F.col("revised").cast("int").alias("revised"), F.col("retracted").cast("int").alias("retracted"))

    return query


def _examples(spark: SparkSession, d: str) -> DataFrame:
    labels = evaluation.label_index(records.deduplicate(events.log(spark, d).filter("kind = 'label'")), "shop", "purchase")
    nodes = [*_LAST, {"id": "w", "op": "mean", "params": NUMBER | {"window": "72h"}}, {"id": "h", "op": "hour_of_day", "params": {"timezone": "UTC"}}]
    plan = plan_of(nodes, ["v", "w", "h"])
    # an hourly grid, so that labels meet requests: each label's own time less the horizon
    asked = labels.select(F.xxhash64("entity_id", "label_us").alias("request_ix"), "entity_id", (F.col("label_us") - HOUR).alias("prediction_us"))
    return evaluation.examples(execute(plan, events.log(spark, d), asked), labels, HOUR)


def examples(spark: SparkSession, d: str) -> DataFrame:
    ex = evaluation.revealed_by(_examples(spark, d), events.FIRST_US + 20 * 24 * HOUR)
    return ex.select("entity_id", "prediction_us", _r("v"), _r("w"), _r("target"), "label_available_us")


def usable_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.usable_labels(records.deduplicate(events.log(spark, d)), events.requests(spark, d))


def naive_scales(spark: SparkSession, d: str) -> DataFrame:
    labels = evaluation.label_index(records.deduplicate(events.log(spark, d)), "shop", "purchase")
    return evaluation.naive_scales(labels, 1).select("entity_id", _r("scale"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    ex = cut(_examples(spark, d).filter("v IS NOT NULL"))
    labels = evaluation.label_index(records.deduplicate(events.log(spark, d)), "shop", "purchase")
    got = evaluation.scores(models.identity(ex, "v"), evaluation.naive_scales(labels, 1))
    return got.select("n", *[_r(c) for c in ("mae", "rmse", "r2", "bias", "mase")])


def paired(spark: SparkSession, d: str) -> DataFrame:
    ex = cut(_examples(spark, d).filter("v IS NOT NULL AND w IS NOT NULL"))
    return evaluation.paired_differences(models.identity(ex, "v"), models.identity(ex, "w")).select("entity_id", "prediction_us", _r("difference"))


def ridge(spark: SparkSession, d: str) -> DataFrame:
    ex = cut(_examples(spark, d).filter("v IS NOT NULL AND w IS NOT NULL"))
    m = models.moments(ex, ["v", "w"])
    weights = models.ridge_weights(m, 1.0)
    rows = [(c, float(w)) for c, w in zip(m.features, weights)] + [("intercept", m.target_mean)]
    return spark.createDataFrame(rows, "feature string, weight double").select("feature", _r("weight"))


def selection(spark: SparkSession, d: str) -> DataFrame:
    ex = cut(_examples(spark, d))
    cutoff = events.FIRST_US + 15 * 24 * HOUR
    train, valid = ex.filter(F.col("prediction_us") < cutoff), ex.filter(F.col("prediction_us") >= cutoff)
    chosen = models.greedy_selection(train, valid, ["v", "w", "h"], 2)
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "rank int, feature string")


def audit_used(spark: SparkSession, d: str) -> DataFrame:
    return audit.used_records(run(spark, d, _LAST, lineage=True), ["v"]).select("request_ix", "record_id")


def audit_withheld(spark: SparkSession, d: str) -> DataFrame:
    got = audit.withheld_records(plan_of(_LAST, ["v"]), events.log(spark, d), events.requests(spark, d))
    return got.select("request_ix", "record_id", "available_us", "rank")


def audit_released(spark: SparkSession, d: str) -> DataFrame:
    """Per request and stream how many records could have been used."""
    plan = plan_of([*_LAST, {"id": "c", "op": "last", "params": CATEGORY}], ["v", "c"])
    return audit.released_records(plan, events.log(spark, d), events.requests(spark, d))


def occupancy(spark: SparkSession, d: str) -> DataFrame:
    plan = plan_of([*_MEAN, {"id": "m", "op": "mode", "params": CATEGORY | {"window": "96h"}}], ["v", "m"])
    return audit.window_occupancy(plan, events.log(spark, d), events.requests(spark, d)).select("source_id", "feature_name", "peak")


def replay(spark: SparkSession, d: str) -> DataFrame:
    """The streaming processor over the bounded log (the same answers as in batch)."""
    return replay_batch(plan_of(_MEAN, ["v"]), events.log(spark, d), events.requests(spark, d)).select("request_ix", _r("v"))


#: A program of the size that forecasters write: 16 outputs over five streams.
EXPERT = [
    {"id": "last", "op": "last", "params": NUMBER},
    {"id": "age", "op": "staleness", "params": NUMBER},
    {"id": "lag", "op": "lag", "params": NUMBER | {"lag": "15m"}},
    {"id": "mean_24", "op": "mean", "params": NUMBER | {"window": "24h"}},
    {"id": "mean_72", "op": "mean", "params": NUMBER | {"window": "72h"}},
    {"id": "sd_72", "op": "stddev", "params": NUMBER | {"window": "72h"}},
    {"id": "max_72", "op": "max", "params": NUMBER | {"window": "72h"}},
    {"id": "median_72", "op": "median", "params": NUMBER | {"window": "72h"}},
    {"id": "slope_72", "op": "slope", "params": NUMBER | {"window": "72h"}},
    {"id": "count_72", "op": "count", "params": NUMBER | {"window": "72h"}},
    {"id": "missing_24", "op": "missing_count", "params": NUMBER | {"window": "24h", "expected_interval": "6h"}},
    {"id": "mode_96", "op": "mode", "params": CATEGORY | {"window": "96h"}},
    {"id": "kind", "op": "last", "params": CATEGORY},
    {"id": "clicked", "op": "equals", "inputs": ["kind"], "params": {"value": "click"}},
    {"id": "forecast", "op": "forecast", "params": {"source": "model", "feature": "value_fc", "lead": "1h"}},
    {"id": "near", "op": "cross_entity_mean", "params": NUMBER | {"entity_ref": "next"}},
    {"id": "hour", "op": "hour_of_day", "params": {"timezone": "Europe/Ljubljana"}},
    {"id": "trend", "op": "subtract", "inputs": ["mean_24", "mean_72"]},
    {"id": "level", "op": "coalesce", "inputs": ["mean_24", "last"]},
]
EXPERT_OUT = ["last", "age", "lag", "mean_24", "mean_72", "sd_72", "max_72", "median_72", "slope_72", "count_72", "missing_24", "mode_96", "clicked", "forecast", "near", "hour", "trend", "level"]


def expert(spark: SparkSession, d: str) -> DataFrame:
    df = run(spark, d, EXPERT, EXPERT_OUT)
    return df.select("request_ix", *[F.col(c) if c == "mode_96" else _r(c) for c in EXPERT_OUT])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (log_dedup, log_summary, log_duplicates, log_cardinality, lineage, examples, usable_labels, naive_scales, scores, paired, ridge, selection, audit_used, audit_withheld, audit_released, occupancy, replay)
    return {f"sys_{f.__name__}": f for f in plain} | {f"sys_late_{p}": _late(p) for p in late.POLICIES} | {"sys_late_retract_precise": _late("retract", True)} | {"program_expert": expert}


_W24 = f"l.e = r.e AND l.av <= r.t AND l.ev > r.t - 24 * {HOUR} AND l.ev <= r.t"
_ALL = f"""all_log AS (
  SELECT 'app' AS source_id, 'value' AS feature_name, 'measurement' AS kind, id, e, v AS num, NULL AS cat, ev, av, CAST(NULL AS BIGINT) AS valid FROM ev
  UNION ALL SELECT 'app', 'value', 'measurement', id, e, v, NULL, ev, av + 3 * {HOUR}, NULL FROM ev WHERE event_id % 50 = 0
  UNION ALL SELECT 'app', 'type', 'measurement', 'c' || id, e, NULL, c, ev, av, NULL FROM ev
  UNION ALL SELECT 'model', 'value_fc', 'forecast', id, e, v, NULL, issued, av, valid FROM fc
  UNION ALL SELECT 'shop', 'purchase', 'label', id, e, v, NULL, ev, av, NULL FROM lab
  UNION ALL SELECT 'crm', 'balance', 'static', 's' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), CAST(c_custkey AS VARCHAR), CAST(c_acctbal AS DOUBLE), NULL, {events.FIRST_US + 48 * HOUR}, {events.FIRST_US - 24 * HOUR}, NULL FROM customer)"""
_TIMED = f"""labels AS (SELECT e, ev AS label_us, arg_max(v, (av, id)) AS target, max(av) AS label_av FROM lab GROUP BY e, ev),
ex0 AS (SELECT e, label_us - {HOUR} AS t, target, label_av FROM labels),
ex AS (SELECT r.e, r.t, any_value(r.target) AS target, any_value(r.label_av) AS label_av, arg_max(l.v, (l.ev, l.av, l.id)) FILTER (l.v IS NOT NULL) AS v, avg(l.v) FILTER (l.ev > r.t - 72 * {HOUR} AND l.ev <= r.t) AS w FROM ex0 r LEFT JOIN ev l ON l.e = r.e AND l.av <= r.t GROUP BY r.e, r.t),
scale AS (SELECT e, avg(d) AS scale FROM (SELECT e, abs(target - lag(target) OVER (PARTITION BY e ORDER BY label_us)) AS d FROM labels WHERE target IS NOT NULL) GROUP BY e HAVING avg(d) > 0)"""
_EARLY = f"early AS (SELECT * FROM ev WHERE event_id % 11 <> 0 OR av < {events.FIRST_US + 240 * HOUR}), later AS (SELECT * FROM ev WHERE event_id % 11 = 0 AND av >= {events.FIRST_US + 240 * HOUR})"
_BASE = f"SELECT request_ix, any_value(r.t) AS t, avg(v) AS v, coalesce(string_agg(id, ',' ORDER BY id) FILTER (v IS NOT NULL), '') AS ids FROM req r LEFT JOIN {{log}} l ON {_W24} GROUP BY request_ix"


def _rs(*cols: str) -> str:
    return ", ".join(f"round({c} + {OFF_TIE}, 6) + 0.0 AS {c}" for c in cols)


def oracle_sql() -> dict[str, str]:
    sql = SQL.rstrip()
    out = {
        "sys_log_dedup": f"{sql}, {_ALL} SELECT source_id, feature_name, kind, count(*) AS n, CAST(sum(av % 1000000007) AS BIGINT) AS arrivals FROM (SELECT source_id, feature_name, kind, id, min(av) AS av FROM all_log GROUP BY ALL) GROUP BY ALL",
        "sys_log_summary": f"{sql}, {_ALL} SELECT kind, source_id, feature_name, count(*) AS n_rows, count(*) FILTER (num IS NULL AND cat IS NULL) AS n_missing, count(DISTINCT e) AS n_entities, min(ev) AS first_event_us, max(ev) AS last_event_us, max(av - ev) AS max_lag_us FROM all_log GROUP BY ALL",
        "sys_log_duplicates": f"{sql}, {_ALL} SELECT id AS record_id, count(*) AS n_deliveries, count(DISTINCT (num, cat, ev)) > 1 AS conflict FROM all_log GROUP BY id HAVING count(*) > 1",
        "sys_log_cardinality": f"{sql}, {_ALL} SELECT source_id, feature_name, max(n) AS max_per_key, count(*) AS n_keys FROM (SELECT source_id, feature_name, e, ev, valid, count(DISTINCT id) AS n FROM all_log GROUP BY ALL) GROUP BY ALL",
        "sys_lineage": f"{sql} SELECT request_ix, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids, max(av) AS available_us FROM req r LEFT JOIN (SELECT * FROM ev WHERE v IS NOT NULL) l ON {_W24} GROUP BY request_ix",
        "sys_late_ignore": f"{sql}, {_EARLY} SELECT request_ix, {_rs('v')}, 0 AS revised, 0 AS retracted FROM ({_BASE.format(log='early')})",
        "sys_late_retract": f"{sql}, {_EARLY} SELECT request_ix, {_rs('v')}, 0 AS revised, CAST(t >= (SELECT min(av) FROM later) AS INT) AS retracted FROM ({_BASE.format(log='early')})",
        "sys_late_retract_precise": f"""{sql}, {_EARLY}, hit AS (SELECT e, min(av) AS av FROM (SELECT e, av FROM later UNION ALL SELECT g.e, av FROM later l JOIN edges g ON g.other = l.e) GROUP BY e)
SELECT request_ix, {_rs('v')}, 0 AS revised, CAST(coalesce(x.t >= hit.av, false) AS INT) AS retracted FROM ({_BASE.format(log='early')}) x JOIN req USING (request_ix) LEFT JOIN hit USING (e)""",
        "sys_late_revise": f"{sql}, {_EARLY}, both_logs AS (SELECT * FROM early UNION ALL SELECT * FROM later), a AS ({_BASE.format(log='early')}), b AS ({_BASE.format(log='both_logs')}) SELECT request_ix, round(b.v + {OFF_TIE}, 6) + 0.0 AS v, CAST(a.ids <> b.ids AS INT) AS revised, 0 AS retracted FROM a JOIN b USING (request_ix)",
        "sys_examples": f"{sql}, {_TIMED} SELECT e AS entity_id, t AS prediction_us, {_rs('v', 'w', 'target')}, label_av AS label_available_us FROM ex WHERE label_av <= {events.FIRST_US + 480 * HOUR}",
        "sys_usable_labels": f"{sql}, n AS (SELECT t, count(av) AS usable_labels FROM (SELECT DISTINCT t FROM req) q LEFT JOIN lab ON av <= t GROUP BY t) SELECT request_ix, usable_labels FROM req JOIN n USING (t)",
        "sys_naive_scales": f"{sql}, {_TIMED} SELECT e AS entity_id, {_rs('scale')} FROM scale",
        "sys_scores": f"{sql}, {_TIMED}, q AS (SELECT v - target AS err, target, scale FROM ex LEFT JOIN scale USING (e) WHERE v IS NOT NULL AND target IS NOT NULL), s AS (SELECT count(err) AS n, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, 1 - sum(err * err) / (var_pop(target) * count(*)) AS r2, avg(err) AS bias, avg(abs(err) / scale) AS mase FROM q) SELECT n, {_rs('mae', 'rmse', 'r2', 'bias', 'mase')} FROM s",
        "sys_paired": f"{sql}, {_TIMED} SELECT e AS entity_id, t AS prediction_us, {_rs('difference')} FROM (SELECT e, t, abs(v - target) - abs(w - target) AS difference FROM ex WHERE v IS NOT NULL AND w IS NOT NULL)",
        "sys_ridge": f"""{sql}, {_TIMED}, q AS (SELECT v, w, target FROM ex WHERE v IS NOT NULL AND w IS NOT NULL AND target IS NOT NULL),
s AS (SELECT avg(v) AS mv, avg(w) AS mw, stddev_pop(v) AS sv, stddev_pop(w) AS sw, avg(target) AS my FROM q),
g AS (SELECT sum(x * x) + 1 AS a, sum(x * z) AS b, sum(z * z) + 1 AS d, sum(x * y) AS p, sum(z * y) AS r, any_value(my) AS my FROM (SELECT (v - mv) / sv AS x, (w - mw) / sw AS z, target - my AS y, my FROM q, s))
SELECT feature, {_rs('weight')} FROM (SELECT 'v' AS feature, (p * d - b * r) / (a * d - b * b) AS weight FROM g UNION ALL SELECT 'w', (a * r - b * p) / (a * d - b * b) FROM g UNION ALL SELECT 'intercept', my FROM g)""",
        "sys_audit_used": f"{sql} SELECT request_ix, arg_max(id, (ev, av, id)) AS record_id FROM req r JOIN ev l ON l.e = r.e AND l.av <= r.t AND v IS NOT NULL GROUP BY request_ix",
        "sys_audit_withheld": f"{sql} SELECT request_ix, id AS record_id, av AS available_us, row_number() OVER (PARTITION BY request_ix ORDER BY av, id) AS rank FROM req r JOIN ev l ON l.e = r.e AND l.av > r.t QUALIFY rank <= 3",
        "sys_audit_released": f"{sql} SELECT request_ix, 'app' AS source_id, x AS feature_name, count(l.id) AS released FROM req r CROSS JOIN (VALUES ('value'), ('type')) AS s(x) LEFT JOIN ev l ON l.e = r.e AND l.av <= r.t GROUP BY request_ix, x",
        "sys_occupancy": f"{sql}, n AS (SELECT request_ix, count(*) FILTER (l.ev >= r.t - 24 * {HOUR}) AS a, count(*) AS b FROM req r JOIN ev l ON l.e = r.e AND l.av <= r.t AND l.ev >= r.t - 96 * {HOUR} AND l.ev <= r.t GROUP BY request_ix) SELECT 'app' AS source_id, 'value' AS feature_name, max(a) AS peak FROM n UNION ALL SELECT 'app', 'type', max(b) FROM n",
        "sys_replay": f"{sql} SELECT request_ix, {_rs('v')} FROM ({_BASE.format(log='ev')})",
    }
    sub = {"last": BODIES["last"].replace(f"CASE WHEN t - ev0 <= 36 * {HOUR} THEN v0 END", "v0"), "age": BODIES["staleness"], "lag": BODIES["lag"], "mean_24": BODIES["mean"].replace("72 *", "24 *"), "mean_72": BODIES["mean"], "sd_72": BODIES["stddev"], "max_72": BODIES["max"], "median_72": BODIES["median"], "slope_72": BODIES["slope"], "count_72": BODIES["count"], "missing_24": BODIES["missing_count"], "mode_96": BODIES["mode"], "clicked": BODIES["equals"], "forecast": BODIES["forecast"], "near": BODIES["cross_entity_mean"], "hour": BODIES["hour_of_day"]}
    joins = " ".join(f"JOIN (SELECT request_ix, v AS {k} FROM ({b})) USING (request_ix)" for k, b in sub.items())
    picks = ", ".join("mode_96" if c == "mode_96" else f"round({e} + {OFF_TIE}, 6) + 0.0 AS {c}" for c, e in [(c, c) for c in sub] + [("trend", "(mean_24 - mean_72)"), ("level", "coalesce(mean_24, last)")])
    out["program_expert"] = f"{sql} SELECT request_ix, {picks} FROM req {joins}"
    return out
