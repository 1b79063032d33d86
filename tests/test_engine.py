"""Batch execution against the Python kernels on random logs, and hand-made cases for boundaries, ties and lineage."""

import ast
import math
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.plans.compiler import compile_program
from tidemark.plans.engine import execute
from tidemark.records import LOG_SCHEMA, deduplicate, duplicates, late_records, validated
from tidemark.streaming.kernels import evaluate
from tidemark.streaming.late import execute_with_late
from tidemark.streaming.replay import as_events, end_marker, replay_batch, stream_features

H = 3_600_000_000
STEP = 900_000_000
SOURCES = [
    {"source_id": "s", "feature_name": "n", "max_input_rate_per_hour": 1000},
    {"source_id": "s", "feature_name": "c", "value_type": "category", "max_input_rate_per_hour": 1000},
    {"source_id": "m", "feature_name": "f", "kind": "forecast", "max_input_rate_per_hour": 1000, "max_forecast_horizon": "48h"},
]
N, C = {"source": "s", "feature": "n"}, {"source": "s", "feature": "c"}


def everything():
    nodes = [
        {"id": "last", "op": "last", "params": N},
        {"id": "fresh", "op": "last", "params": N | {"max_staleness": "30m"}},
        {"id": "lag", "op": "lag", "params": N | {"lag": "30m"}},
        {"id": "age", "op": "staleness", "params": N},
        {"id": "missing", "op": "missing_count", "params": N | {"window": "1h", "expected_interval": "15m"}},
        {"id": "fc", "op": "forecast", "params": {"source": "m", "feature": "f", "lead": "30m"}},
        {"id": "near", "op": "cross_entity_mean", "params": N | {"entity_ref": "g"}},
        {"id": "lastc", "op": "last", "params": C},
        {"id": "is_a", "op": "equals", "inputs": ["lastc"], "params": {"value": "a"}},
        {"id": "in_ab", "op": "is_in", "inputs": ["lastc"], "params": {"values": ["a", "b"]}},
        {"id": "hour", "op": "hour_of_day", "params": {"timezone": "America/New_York"}},
        {"id": "holiday", "op": "day_before_holiday", "params": {"timezone": "Asia/Shanghai", "calendar": "k"}},
        {"id": "modec", "op": "mode", "params": C | {"window": "2h"}},
        {"id": "modes", "op": "distinct_count", "params": C | {"window": "2h"}},
    ]
    for op in ("count", "sum", "mean", "variance", "stddev", "min", "max", "median", "p25", "p75", "iqr", "mad", "slope", "time_since_max", "time_since_min", "mode", "distinct_count"):
        nodes.append({"id": f"w_{op}", "op": op, "params": N | {"window": "1h"}})
    nodes += [{"id": "add", "op": "add", "inputs": ["last", "w_count"]}, {"id": "sub", "op": "subtract", "inputs": ["add", "w_mean"]}, {"id": "mul", "op": "multiply", "inputs": ["sub", "last"]}, {"id": "div", "op": "divide", "inputs": ["last", "w_sum"]}, {"id": "co", "op": "coalesce", "inputs": ["lag", "last"]}]
    return plan(nodes)


def plan(nodes, outputs=None):
    got = compile_program({"name": "p", "sources": SOURCES, "nodes": nodes, "outputs": outputs or [n["id"] for n in nodes], "calendars": {"k": ["1970-01-02"]}, "entity_graphs": [{"name": "g", "max_related_entities": 2}]})
    assert got.plan, got.diagnostics
    return got.plan


def record(i, entity="e", kind="measurement", source="s", feature="n", num=None, cat=None, event=0, delay=0, valid=None, issued=None, rev=None):
    return (i, kind, entity, source, feature, num, cat, None, event, event + delay, valid, issued, rev, None, {"line": i})


def rows(spark, records):
    return spark.createDataFrame(records, LOG_SCHEMA)


def asked(spark, times):
    return spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(times)], "request_ix bigint, entity_id string, prediction_us bigint")


GRAPH = {"g": {"e": ["x", "y"], "x": ["e"]}}


def graph(spark):
    return spark.createDataFrame([(g, e, r) for g, m in GRAPH.items() for e, rs in m.items() for r in rs], "graph string, entity_id string, related_id string")


def check(spark, p, records, times):
    got = {r["request_ix"]: r for r in execute(p, rows(spark, records), asked(spark, times), graph(spark), lineage=True, shard_us=4 * STEP).collect()}
    assert len(got) == len(times)
    first = {}
    names = [f.name for f in LOG_SCHEMA]
    for r in records:
        d = dict(zip(names, r))
        if d["record_id"] not in first or d["available_us"] < first[d["record_id"]]["available_us"]:
            first[d["record_id"]] = d
    for i, (e, t) in enumerate(times):
        want = evaluate(p, list(first.values()), e, t, GRAPH)
        for o in p.program.outputs:
            a, b = got[i][o], want[o].value
            same = a == b or (a is not None and b is not None and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
            assert same, (o, e, t, a, b)
            assert tuple(got[i][f"{o}__lineage"]) == want[o].lineage, (o, got[i][f"{o}__lineage"], want[o].lineage)
            assert got[i][f"{o}__available_us"] == want[o].available_us


@st.composite
def worlds(draw):
    out = []
    for i in range(draw(st.integers(0, 14))):
        e = draw(st.sampled_from("exy"))
        event, delay = draw(st.integers(0, 12)) * STEP, draw(st.integers(0, 5)) * STEP
        what = draw(st.sampled_from("nnncf"))
        if what == "n":
            out.append(record(f"r{i}", e, num=draw(st.one_of(st.none(), st.sampled_from([0.0, 1.0, -2.5, 7.25]))), event=event, delay=delay))
        elif what == "c":
            out.append(record(f"r{i}", e, feature="c", cat=draw(st.one_of(st.none(), st.sampled_from(["a", "b", "z"]))), event=event, delay=delay))
        else:
            out.append(record(f"r{i}", e, "forecast", "m", "f", num=draw(st.one_of(st.none(), st.sampled_from([1.0, 5.0]))), event=event, delay=delay, issued=event, valid=event + draw(st.integers(0, 6)) * STEP, rev=draw(st.sampled_from([None, "b1", "b2"]))))
        if draw(st.integers(0, 4)) == 0:
            again = list(out[-1])
            again[9] += 2 * STEP
            out.append(tuple(again))
    times = draw(st.lists(st.tuples(st.sampled_from("exyq"), st.integers(0, 18).map(lambda k: k * STEP)), min_size=1, max_size=5))
    return out, times


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(worlds())
def test_batch_equals_kernels(spark, world):
    check(spark, everything(), *world)


def test_dense_world(spark):
    import random

    rng = random.Random(11)
    recs = []
    for i in range(500):
        e, event = rng.choice("eeeexy"), rng.randrange(40) * STEP
        if i % 3 == 0:
            recs.append(record(f"c{i}", e, feature="c", cat=rng.choice(["a", "b", "z", None]), event=event, delay=rng.randrange(6) * STEP))
        elif i % 7 == 0:
            recs.append(record(f"f{i}", e, "forecast", "m", "f", num=rng.choice([1.0, 2.0, None]), event=event, delay=rng.randrange(3) * STEP, issued=event, valid=event + rng.randrange(6) * STEP, rev=rng.choice([None, "b1"])))
        else:
            recs.append(record(f"n{i}", e, num=rng.choice([None, 1.5, 2.5, 2.5, -3.0]), event=event, delay=rng.randrange(6) * STEP))
    check(spark, everything(), recs, [(e, k * STEP) for e in "exyq" for k in range(0, 48, 5)])


def test_window_is_open_left_closed_right_and_availability_is_inclusive(spark):
    p = plan([{"id": "n", "op": "count", "params": N | {"window": "2h"}}, {"id": "s", "op": "sum", "params": N | {"window": "2h"}}])
    recs = [record("m0", num=1.0, event=0), record("m1", num=2.0, event=H), record("m2", num=4.0, event=2 * H), record("late", num=8.0, event=H, delay=H), record("later", num=16.0, event=H, delay=H + 1)]
    got = execute(p, rows(spark, recs), asked(spark, [("e", 2 * H)]), lineage=True).collect()[0]
    assert (got["n"], got["s"], got["n__lineage"]) == (3.0, 14.0, ["late", "m1", "m2"])


def test_empty_log_and_empty_requests(spark):
    p = everything()
    none = rows(spark, [])
    got = execute(p, none, asked(spark, [("e", 0)]), graph(spark), lineage=True).collect()[0]
    assert got["w_count"] == 0.0 and got["missing"] == 4.0 and got["last"] is None and got["last__lineage"] == [] and got["add"] is None
    assert execute(p, none, asked(spark, []), graph(spark)).count() == 0


def test_equal_requests_stay_apart(spark):
    p = plan([{"id": "l", "op": "last", "params": N}])
    assert [r["l"] for r in execute(p, rows(spark, [record("a", num=1.0)]), asked(spark, [("e", 5)] * 3)).collect()] == [1.0] * 3


def test_deduplication(spark):
    a, b = record("a", num=1.0, delay=5), record("a", num=1.0, delay=9)
    assert [r["available_us"] for r in deduplicate(rows(spark, [b, a])).collect()] == [5]
    with pytest.raises(Exception, match="differing contents: a"):
        deduplicate(rows(spark, [a, record("a", num=2.0)])).collect()
    assert [tuple(r) for r in duplicates(rows(spark, [a, b, record("z", num=0.0)])).collect()] == [("a", 2, False)]
    assert [r["record_id"] for r in late_records(rows(spark, [a]), rows(spark, [a, record("n", num=3.0)])).collect()] == ["n"]


@pytest.mark.parametrize("bad,why", [(record("x", num=1.0, event=9, delay=-1), "before its event"), (record("x", kind="forecast", num=1.0), "issued_time and valid_time"), (record("x", num=1.0, valid=3), "only forecasts"), (record("x", num=float("nan")), "finite"), (record("x", kind="guess"), "unknown kind"), (record("x", kind="forecast", num=1.0, event=5, issued=9, valid=9), "before it is issued"), (record("x", num=1.0, cat="a"), "both")])
def test_invariants(spark, bad, why):
    with pytest.raises(Exception, match=why):
        validated(rows(spark, [bad])).collect()
    assert validated(rows(spark, [record("s", kind="static", num=1.0, event=9, delay=-5)])).count() == 1


def test_too_many_related_entities(spark):
    p = plan([{"id": "x", "op": "cross_entity_mean", "params": N | {"entity_ref": "g"}}])
    edges = spark.createDataFrame([("g", "e", str(i)) for i in range(3)], "graph string, entity_id string, related_id string")
    with pytest.raises(ValueError, match="more than declared"):
        execute(p, rows(spark, []), asked(spark, [("e", 0)]), edges)


def test_late_policies(spark):
    p = plan([{"id": "m", "op": "mean", "params": N | {"window": "2h"}}])
    log, late = rows(spark, [record("a", num=1.0, event=H)]), rows(spark, [record("b", num=3.0, event=H, delay=H), record("q", entity="zz", num=3.0, event=0)])
    req = asked(spark, [("e", H), ("e", 2 * H)])

    def run(policy, **more):
        return [(r["m"], r["revised"], r["retracted"]) for r in execute_with_late(p, log, late, req, policy, **more).orderBy("request_ix").collect()]

    assert run("ignore") == [(1.0, False, False), (1.0, False, False)]
    assert run("revise") == [(1.0, False, False), (2.0, True, False)]
    assert run("retract") == [(1.0, False, True), (1.0, False, True)]
    assert run("retract", precise=True) == [(1.0, False, False), (1.0, False, True)]


def test_a_late_record_of_a_related_entity_retracts(spark):
    p = plan([{"id": "m", "op": "mean", "params": N | {"window": "2h"}}, {"id": "x", "op": "cross_entity_mean", "params": N | {"entity_ref": "g"}}])
    log = rows(spark, [record("a", num=1.0, event=H), record("b", "e2", num=1.0, event=H)])
    late = rows(spark, [record("c", "e2", num=9.0, event=H + 1, delay=H), record("d", "far", num=3.0, event=0)])
    req = asked(spark, [("e", H), ("e", 3 * H), ("e2", 3 * H), ("e3", 3 * H)])
    graph = spark.createDataFrame([("g", "e", "e2")], "graph string, entity_id string, related_id string")

    def run(policy, **more):
        return [(r["x"], r["revised"], r["retracted"]) for r in execute_with_late(p, log, late, req, policy, graph, **more).orderBy("request_ix").collect()]

    assert run("revise") == [(1.0, False, False), (9.0, True, False), (None, True, False), (None, False, False)]
    assert run("retract", precise=True) == [(1.0, False, False), (1.0, False, True), (None, False, True), (None, False, False)]


def test_audit_of_released_and_withheld_records(spark):
    from tidemark.plans.audit import released_records, withheld_records

    p = plan([{"id": "v", "op": "last", "params": N}])
    log = rows(spark, [record(f"r{i}", "ef"[i % 2], num=1.0, event=i * H, delay=(i % 5) * H) for i in range(40)])
    req = asked(spark, [("e", k * H) for k in (0, 3, 17, 60)] + [("g", H), ("e", 17 * H)])
    arrivals = sorted(((i + i % 5) * H, f"r{i}") for i in range(0, 40, 2))
    for width in (H, 7 * H, 1000 * H):
        got = {r["request_ix"]: r["released"] for r in released_records(p, log, req, width).collect()}
        want = {r["request_ix"]: sum(a <= r["prediction_us"] for a, _ in arrivals) if r["entity_id"] == "e" else 0 for r in req.collect()}
        assert got == want
        rest = {}
        for r in withheld_records(p, log, req, 3, width).collect():
            rest.setdefault(r["request_ix"], []).append((r["rank"], r["available_us"], r["record_id"]))
        for r in req.collect():
            after = [x for x in arrivals if x[0] > r["prediction_us"]][:3] if r["entity_id"] == "e" else []
            assert sorted(rest.get(r["request_ix"], [])) == [(i + 1, *x) for i, x in enumerate(after)]


def test_replay_equals_batch_and_streams(spark, tmp_path):
    D0 = 24 * H  # the first watermark of a stream is 1970-01-01
    p = plan([n for n in [{"id": "last", "op": "last", "params": N}, {"id": "m", "op": "mean", "params": N | {"window": "1h"}}, {"id": "f", "op": "forecast", "params": {"source": "m", "feature": "f", "lead": "30m"}}, {"id": "c", "op": "mode", "params": C | {"window": "2h"}}]])
    recs = [record(f"r{i}", "exy"[i % 3], num=float(i % 5), event=D0 + (i % 20) * STEP, delay=(i % 4) * STEP) for i in range(60)]
    recs += [record(f"c{i}", "exy"[i % 3], feature="c", cat="ab"[i % 2], event=D0 + (i % 20) * STEP) for i in range(20)]
    recs += [record(f"f{i}", "exy"[i % 3], "forecast", "m", "f", num=float(i), event=D0 + i * STEP, issued=D0 + i * STEP, valid=D0 + (i + 2) * STEP) for i in range(12)]
    recs += [recs[0][:9] + (recs[0][9] + H,) + recs[0][10:]]
    log, req = rows(spark, recs), asked(spark, [(e, D0 + k * STEP) for e in "exy" for k in range(3, 24, 4)])
    key = lambda r: (r["request_ix"], r["last"], r["m"], r["f"], r["c"], tuple(r["m__lineage"]), r["f__available_us"])
    batch = sorted(key(r) for r in execute(p, log, req, lineage=True).collect())
    assert sorted(key(r) for r in replay_batch(p, log, req).collect()) == batch
    events = as_events(log, req)
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    end_marker(events).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream_features(p, source).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(key(r) for r in spark.table("replayed").collect()) == batch


def test_streaming_editions(spark, tmp_path):
    from tidemark.streaming.late import stream_editions

    schema = "record_id string, entity_id string, event_time timestamp, value_num double"
    for name, batch in {"a": [("r1", "e", "2024-01-01 01:00:00", 1.0), ("r1", "e", "2024-01-01 01:00:00", 1.0), ("r2", "e", "2024-01-01 23:00:00", 2.0)], "b": [("r3", "e", "2024-01-02 05:00:00", 8.0), ("late", "e", "2024-01-01 04:00:00", 4.0)], "c": [("far", "e", "2024-01-09 00:00:00", 1.0)], "d": [("far2", "e", "2024-01-09 02:00:00", 1.0)], "e": [("gone", "e", "2024-01-01 05:00:00", 9.0), ("x", "e", "2024-01-09 01:00:00", 1.0)]}.items():
        spark.createDataFrame(batch, "record_id string, entity_id string, t string, value_num double").selectExpr("record_id", "entity_id", "cast(t as timestamp) event_time", "value_num").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream_editions(source, ["entity_id"]).writeStream.format("memory").queryName("editions").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    first_day = [(r["n"], r["sum"]) for r in spark.table("editions").filter("period_start = timestamp'2024-01-01 00:00:00'").collect()]
    assert first_day == [(2, 3.0), (3, 7.0)]  # published, corrected, closed to what comes beyond the cut-off (a watermark counts from the second batch on)


def test_boundaries_are_decided_in_one_place():
    """No other module compares availability, event or prediction time."""
    root = Path(__file__).resolve().parents[1] / "tidemark"
    clocks = {"visible", "in_window", "fresh_enough", "revealed"}
    for path in [root / "plans/engine.py", root / "plans/audit.py", root / "streaming/kernels.py", root / "streaming/late.py", root / "plans/evaluation.py"]:
        tree = ast.parse(path.read_text())
        used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
        assert {c for c in clocks if any(c in u for u in used)}, path
        for n in ast.walk(tree):
            if isinstance(n, ast.Compare) and any(isinstance(o, (ast.Lt, ast.LtE, ast.Gt, ast.GtE)) for o in n.ops):
                text = ast.unparse(n)
                assert not ("available_us" in text and "'t'" in text and "+" not in text), (path, text)


def test_replay_names_only_what_it_has():
    import re

    from tidemark.streaming import replay

    assert all(hasattr(replay, n) for n in re.findall(r"``(fan_\w+)``", replay.__doc__))
