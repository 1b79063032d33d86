"""Rolling totals, as-known merges, editions, spikes and filling against plain Python on small tables."""

import random

import numpy as np
import pytest

from tidemark.functions.common import checkpoint_dir, sized_join
from tidemark.operators.editions import closes, editions
from tidemark.operators.fill import fill_runs, fit_prototypes, fill_similar, number_or_null, text_or_null
from tidemark.operators.known_at import as_known
from tidemark.operators.rolling import band, trailing_totals
from tidemark.operators.spikes import Field, departures, implausible, stuck
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


# rolling totals
@pytest.mark.parametrize("tile,block", [(7, 2), (50, 100), (1, 1)])
def test_totals_match_brute_force(spark, tile, block):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(-20, 90), rng.choice([None, 1.0, 2.5, -4.0])) for _ in range(60)]
    rows += [("solo", 5, 1.0), (None, 5, 1.0), ("a", None, 9.0), ("b", 3, float("nan"))]
    df = spark.createDataFrame(rows, "e string, d int, v double")
    got = {(r["entity"], r["day"]): (r["sum_7"], r["sum_30"]) for r in trailing_totals(df, "e", "d", "v", tile_days=tile, block_entities=block).collect()}
    want = {}
    for e in {r[0] for r in rows if r[0]}:
        own = [(d, v) for x, d, v in rows if x == e and d is not None]
        days = [d for d, _ in own]
        for day in range(min(days), max(days) + 1):
            want[e, day] = tuple(sum(v for d, v in own if v is not None and v == v and day - w < d <= day) for w in (7, 30))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_totals_of_nothing(spark):
    assert trailing_totals(spark.createDataFrame([], "e string, d int, v double"), "e", "d", "v").count() == 0


def test_band():
    assert (np.ones(5) @ band(3, 2, 3)).tolist() == [3, 3, 3]


# attributes as known
@pytest.mark.parametrize("hot,width", [(10**9, 8), (3, 8), (1, 1000), (5, 1)])
def test_as_known_matches_brute_force(spark, hot, width):
    rng = random.Random(hot + width)
    events = [(i, rng.choice(["h"] * 8 + ["x", None]), rng.choice([None, *range(60)])) for i in range(150)]
    versions = [(rng.choice(["h", "x", "y", None]), rng.choice([None, *range(60)]), rng.randrange(5), rng.randrange(100)) for _ in range(60)]
    ev = spark.createDataFrame(events, "id int, k string, t int")
    ve = spark.createDataFrame(versions, "key string, since int, rank int, v int")
    out = as_known(ev, ve, {"k": "key"}, "t", {"a": F.col("since"), "b": F.col("since") + 10}, ["rank", "since"], ["v"], width=width, hot_events=hot)
    got = {r["id"]: (r["a"] and tuple(r["a"]), r["b"] and tuple(r["b"])) for r in out.collect()}

    def best(k, t, shift):
        if k is None or t is None:
            return None
        return max(((r, s, v) for key, s, r, v in versions if key == k and s is not None and s + shift <= t), default=None)

    assert got == {i: (best(k, t, 0), best(k, t, 10)) for i, k, t in events}
    assert out.count() == len(events)


def test_as_known_without_versions_or_events(spark):
    ev = spark.createDataFrame([(1, "a", 5)], "id int, k string, t int")
    ve = spark.createDataFrame([], "k string, since int, v int")
    assert as_known(ev, ve, {"k": "k"}, "t", {"a": F.col("since")}, ["since"], ["v"]).collect()[0]["a"] is None
    assert as_known(ev.filter("false"), ve, {"k": "k"}, "t", {"a": F.col("since")}, ["since"], ["v"]).count() == 0


def test_maps_and_copies_are_spread(spark):
    ev = spark.createDataFrame([({"a": i % 2}, "k", 5) for i in range(40)], "m map<string,int>, k string, t int")
    ve = spark.createDataFrame([("k", 4, 7)], "k string, since int, v int")
    got = as_known(ev, ve, {"k": "k"}, "t", {"a": F.col("since")}, ["since"], ["v"], hot_events=3).collect()
    assert len(got) == 40 and {r["a"]["v"] for r in got} == {7}
    small = spark.createDataFrame([("k", 1), ("z", 2)], "k string, w int")
    for limit in (0, 1 << 20):
        for hot_rows in (3, 1000):
            assert sorted(r["w"] for r in sized_join(ev, small, ["k"], limit=limit, hot_rows=hot_rows).collect()) == [1] * 40


def test_hot_and_null_keys_are_split_and_kept(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [(None, i) for i in range(50, 90)] + [("b", 90), ("z", 91)], "k string, i int")
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, w int")
    want = sorted([("a", i, 1) for i in range(50)] + [("", i, 0) for i in range(50, 90)] + [("b", 90, 2), ("z", 91, 0)])
    for how in ("left", "inner"):
        got = sized_join(big, small, ["k"], how, limit=0, hot_rows=10)
        assert sorted((r["k"] or "", r["i"], r["w"] or 0) for r in got.collect()) == (want if how == "left" else [x for x in want if x[2]])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://somewhere:7077")
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))


def test_as_known_keeps_repeated_rows_and_clashing_names(spark):
    ev = spark.createDataFrame([(1, "a", 5, 9)] * 3, "_ka_t int, k string, t int, since int")
    ve = spark.createDataFrame([("a", 4, 7), ("a", 4, 7)], "k string, since int, v int")
    got = as_known(ev, ve, {"k": "k"}, "t", {"a": F.col("since")}, ["since"], ["v"]).collect()
    assert [(r["_ka_t"], r["since"], r["a"]["v"]) for r in got] == [(1, 9, 7)] * 3


# editions
def log(spark, rows):
    return spark.createDataFrame(rows, "record_id string, entity_id string, source_id string, feature_name string, event_us bigint, available_us bigint, value double, present boolean")


def test_editions_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        ev = rng.randrange(4 * DAY)
        v = rng.choice([None, 1.0, 2.0])
        rows.append((f"r{i}", rng.choice(["a", "b"]), rng.choice(["s1", "s2"]), "f", ev, ev + rng.choice([0, HOUR, 5 * HOUR, 30 * HOUR, 71 * HOUR, 72 * HOUR, 72 * HOUR + 1, 100 * HOUR]), v, v is not None))
    rows += [(r[0], *r[1:5], r[5] + 9 * HOUR, *r[6:]) for r in rows[:40]]  # redeliveries
    rows += [("n1", "a", "s1", "f", None, 5, 1.0, True), ("n2", "a", "s1", "f", 5, None, 1.0, True), ("n3", None, "s1", "f", 5, 6, 1.0, True)]
    got = {(r["entity_id"], r["source_id"], r["period"]): r for r in editions(log(spark, rows), ["entity_id", "source_id", "feature_name"]).collect()}
    first = {}
    for r in rows:
        if r[5] is not None:
            first[r[0]] = min(first.get(r[0], r), r, key=lambda x: x[5])
    want = {}
    for r in first.values():
        if r[4] is None or not r[7]:
            continue
        w = want.setdefault((r[1], r[2], r[4] // DAY), {"first": 0, "late": 0, "out": 0})
        w["out" if r[5] - r[4] > 72 * HOUR else "first" if r[5] <= (r[4] // DAY + 1) * DAY + 6 * HOUR else "late"] += 1
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k]["first_n"], got[k]["corrections"], got[k]["diverted"]) == (w["first"], w["late"], w["out"])
        assert got[k]["n"] == w["first"] + w["late"]


def test_a_period_closes_when_every_source_has_passed(spark):
    rows = [(f"a{i}", "e", "quick", "f", i * HOUR, i * HOUR, 1.0, True) for i in range(0, 24 * 8)]
    rows += [(f"b{i}", "e", "slow", "f", i * HOUR, i * HOUR + 20 * HOUR, 1.0, True) for i in range(0, 24 * 8)]
    got = {r["period"]: r["closed_us"] for r in closes(log(spark, rows), "source_id", "event_us", "available_us", DAY, 72 * HOUR, 48 * HOUR).collect()}
    assert got[0] == (24 + 72) * HOUR + 20 * HOUR  # the slow source's watermark
    quick = [r for r in rows if r[2] == "quick" or r[4] < 2 * DAY]
    idle = {r["period"]: r["closed_us"] for r in closes(log(spark, quick), "source_id", "event_us", "available_us", DAY, 72 * HOUR, 48 * HOUR).collect()}
    assert idle[1] == max((24 * 2 + 72) * HOUR, 2 * DAY - HOUR + 20 * HOUR + 48 * HOUR)  # the slow one fell silent


def test_a_period_closes_only_with_all_sources(spark):
    rows = [(f"a{i}", "e", "quick", "f", i * HOUR, i * HOUR, 1.0, True) for i in range(0, 24 * 20)]
    rows += [(f"b{i}", "e", None, "f", i * HOUR, i * HOUR, 1.0, True) for i in range(150, 24 * 20)]  # starts on the seventh day
    got = {r["period"]: r["closed_us"] for r in closes(log(spark, rows), "source_id", "event_us", "available_us", DAY, 72 * HOUR, 48 * HOUR).collect()}
    assert [got[p] for p in range(3)] == [(24 + 72) * HOUR, (48 + 72) * HOUR, (72 + 72) * HOUR]  # silent until then
    assert [got[p] for p in range(3, 6)] == [(24 * (p + 1) + 72) * HOUR for p in range(3, 6)]  # by then it delivers, and passes
    last = [r for r in rows if r[2] == "quick" and r[4] < 4 * DAY] + [(f"c{i}", "e", "brief", "f", i * HOUR, i * HOUR + 110 * HOUR, 1.0, True) for i in range(24)]
    got = {r["period"]: r["closed_us"] for r in closes(log(spark, last), "source_id", "event_us", "available_us", DAY, 72 * HOUR, 48 * HOUR).collect()}
    assert got[3] == (23 + 110 + 48) * HOUR  # the brief one has no record of that day and falls silent last


def by_clock(rows, lateness, idle, punctuations=()):
    """period -> close, by going through every instant at which anything can change."""
    arrivals = {}
    for r in rows:
        if r[4] is not None and r[5] is not None:
            arrivals.setdefault(r[2], []).append((r[5], r[4]))
    start = min(a for x in arrivals.values() for a, _ in x)
    out = {}
    for p in {r[4] // DAY for r in rows if r[4] is not None and r[5] is not None}:
        end = (p + 1) * DAY
        at = []
        for source, x in arrivals.items():
            passes = [a for a, e in x if min(a, e) - lateness >= end] + [t for s, t, upto in punctuations if s == source and upto >= end]
            times = sorted(a for a, _ in x)
            for lo, hi in zip([start, *times], [*times, 1 << 62]):
                if hi - lo > idle and max(lo + idle, end + lateness) <= hi:
                    passes.append(max(lo + idle, end + lateness))
            at.append(min(passes))
        out[p] = max(at)
    return out


@pytest.mark.parametrize("lateness,idle", [(72 * HOUR, 48 * HOUR), (6 * HOUR, 3 * HOUR), (0, HOUR // 2)])
def test_closes_match_a_walk_through_time(spark, lateness, idle):
    rng = random.Random(lateness + idle)
    rows = []
    for i in range(200):
        ev = rng.choice([rng.randrange(6 * DAY), rng.randrange(DAY)])
        rows.append((f"r{i}", "e", rng.choice(["a", "b", None]), "f", ev, ev + rng.choice([-HOUR, 0, HOUR, 30 * HOUR]), 1.0, True))
    rows += [("far", "e", "a", "f", -3000 * DAY, 5 * DAY, 1.0, True), ("z", "e", "late", "f", 4 * DAY, 5 * DAY, 1.0, True)]
    said = [("late", 2 * DAY, 3 * DAY), ("a", 3 * DAY, 2 * DAY)]
    df = log(spark, rows)
    call = lambda **m: {r["period"]: r["closed_us"] for r in closes(df, "source_id", "event_us", "available_us", DAY, lateness, idle, **m).collect()}
    assert call() == by_clock(rows, lateness, idle)
    assert call(punctuations=spark.createDataFrame(said, "source_id string, at_us bigint, upto_us bigint")) == by_clock(rows, lateness, idle, said)
    per = spark.createDataFrame([(*r[:1], e, *r[2:]) for e, keep in (("x", 150), ("y", 202)) for r in rows[:keep]], df.schema)
    got = {(r["group"]["entity_id"], r["period"]): r["closed_us"] for r in closes(per, "source_id", "event_us", "available_us", DAY, lateness, idle, within=["entity_id"]).collect()}
    assert got == {("x", p): c for p, c in by_clock(rows[:150], lateness, idle).items()} | {("y", p): c for p, c in by_clock(rows, lateness, idle).items()}


def test_the_close_decides_what_is_diverted(spark):
    rows = [(f"a{i}", "e", "s", "f", i * HOUR, i * HOUR, 1.0, True) for i in range(0, 24 * 6)]
    rows += [("in time", "e", "s", "f", 5 * HOUR, 40 * HOUR, 1.0, True), ("too late", "e", "s", "f", 20 * HOUR, 82 * HOUR, 1.0, True), ("far too late", "e", "s", "f", 20 * HOUR, 93 * HOUR, 1.0, True)]
    count = lambda **m: next((r["first_n"], r["corrections"], r["diverted"], r["closed_us"]) for r in editions(log(spark, rows), ["entity_id", "source_id", "feature_name"], **m).collect() if r["period"] == 0)
    assert count() == (24, 2, 1, 96 * HOUR)  # the default loses nothing within the cut-off
    assert count(lateness_us=20 * HOUR) == (24, 1, 2, 44 * HOUR)
    assert count(lateness_us=12 * HOUR) == (24, 0, 3, 36 * HOUR)
    for idle in (1, HOUR // 2, HOUR, 9 * HOUR):
        assert count(idle_us=idle)[:3] == (24, 2, 1)


def test_editions_of_nothing(spark):
    assert editions(log(spark, []), ["entity_id", "source_id", "feature_name"]).count() == 0


# implausible readings
def test_departures_and_runs():
    x = np.array([1, 1, 9, 9, 1, 1, 1, 9, 9, 9, 9, 9], float)
    d, _ = departures(x)
    assert d[2] == d[3] == 8 and d[:2].max() == 0 and d[8:].max() == 0  # a change that lasts isn't a spike
    y = np.array([3.0] * 6 + [4.0] * 5 + [np.nan] + [4.0] * 6)
    assert stuck(y).nonzero()[0].tolist() == [1, 2, 3, 4, 5, 13, 14, 15, 16, 17]


def test_departures_with_missing_hours_and_at_ends():
    x = np.ones(60)
    x[20:23] = [9, np.nan, 9]
    x[:2] = 9
    x[-1] = -7
    x[40:52] = np.nan
    x[39] = 9
    d, _ = departures(x)
    assert d[20] == d[22] == 8 and d[21] == 0
    assert d[0] == d[1] == d[-1] == d[39] == 4 and (np.delete(d, [0, 1, 20, 22, 39, 59]) == 0).all()
    x[36:40] = 9  # four hours may be weather
    assert departures(x)[0][30:55].max() == 0


def test_further_readings_of_an_hour_get_the_second_round(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.3, 600)
    v[298] = v[302] = 40.0
    rows = [(i, "s", i, float(x)) for i, x in enumerate(v)] + [(1000, "s", 300, 20.0)]
    df = spark.createDataFrame(rows, "no bigint, st string, h bigint, v double")
    got = {r["no"] for r in implausible(df, "no", "st", "h", [Field("v", -300, 300)], [-9999.0]).collect()}
    assert got == {298, 302, 1000}


def test_implausible_finds_planted_cases(spark):
    rng = np.random.default_rng(1)
    rows, planted = [], set()
    n = 24 * 150
    for s, (level, noise) in {"calm": (10, 0.3), "wild": (30, 3.0)}.items():
        v = level + 5 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, noise, n).round(3)
        for at, length in ((200, 1), (1439, 2), (1441 + 24, 3), (2880, 1)):
            v[at : at + length] += 40 * noise
            planted |= {(s, h, "spike") for h in range(at, at + length)}
        v[3010:3018] = v[3010]
        planted |= {(s, h, "stuck") for h in range(3011, 3018)}
        v[3100:] += 30 * noise  # lasts
        v[3300] = 500.0
        planted.add((s, 3300, "impossible"))
        rows += [(i + (0 if s == "calm" else n), s, i, float(x)) for i, x in enumerate(v) if i % 501]
    rows += [(10**6, "calm", 50, None), (10**6 + 1, None, 50, 1.0), (10**6 + 2, "calm", None, 1.0), (10**6 + 3, "calm", 60, -9999.0), (10**6 + 4, "calm", 61, float("nan")), rows[5]]
    df = spark.createDataFrame(rows, "no bigint, st string, h bigint, v double")
    got = {(r["source"], r["no"] - (0 if r["source"] == "calm" else n), r["reason"]) for r in implausible(df, "no", "st", "h", [Field("v", -300, 300)], [-9999.0]).collect()}
    assert got == planted
    assert implausible(df.filter("false"), "no", "st", "h", [Field("v", -300, 300)]).count() == 0


# filling
def test_placeholders(spark):
    df = spark.createDataFrame([("", 1.0), (" ", -999.0), ("N/A", float("nan")), (None, None), ("unknown", 2.0), (" Abc ", -9999.0)], "t string, v double")
    got = df.select(text_or_null(F.col("t")).alias("t"), number_or_null(F.col("v")).alias("v")).collect()
    assert [r["t"] for r in got] == [None] * 5 + ["Abc"] and [r["v"] for r in got] == [1.0, None, None, None, 2.0, None]


def test_fill_uses_cluster_then_fallbacks(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        day = i % 2
        rows.append((i, "g1" if i % 4 < 2 else "g2", float(10 if day else 100) + rng.normal(), None if i < 8 else float(5 if day else 50) + rng.normal(), "dayside" if day else "nightside"))
    rows += [(1000, "fresh", 10.0, None, "dayside"), (1001, None, None, None, None), (None, "g1", 1.0, None, "x")]
    df = spark.createDataFrame(rows, "k bigint, g string, a double, b double, c string")
    out = fill_similar(df, "k", ["a", "b"], ["c"], ["b"], ["c"], "g", clusters=4, rounds=3)
    b = {r["k"]: r for r in out.filter("field = 'b'").collect()}
    assert set(b) == {*range(8), 1000, 1001}
    assert all(abs(b[i]["filled_num"] - (5 if i % 2 else 50)) < 3 and b[i]["method"] == "group_cluster" for i in range(8))
    assert b[1000]["method"] == "cluster" and abs(b[1000]["filled_num"] - 5) < 3
    c = out.filter("field = 'c'").collect()
    assert [r["k"] for r in c] == [1001] and c[0]["filled_cat"] in ("dayside", "nightside")
    again = {r["k"]: r["filled_num"] for r in fill_similar(df, "k", ["a", "b"], ["c"], ["b"], ["c"], "g", clusters=4, rounds=3).filter("field = 'b'").collect()}
    assert again == {k: r["filled_num"] for k, r in b.items()}


def test_rounds_end_when_the_cost_no_longer_falls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal() + 20 * (i % 3)), float(rng.normal()) if i % 5 else None, hash(("a", "b", "c")[i % 3]) % 97 + 1) for i in range(600)]
    model = fit_prototypes(spark.createDataFrame(rows, "k bigint, x double, y double, c bigint"), "k", ["x", "y"], ["c"], clusters=6)
    costs = model.costs
    assert 2 <= len(costs) < 60 and all(b <= a * (1 + 1e-9) for a, b in zip(costs, costs[1:])) and costs[-1] >= costs[-2] * (1 - 1e-3)


def test_a_category_takes_its_groups_mode_first(spark):
    rows = [(i, f"g{i % 2}", float(i % 2), f"name{i % 2}" if i % 7 else None) for i in range(70)] + [(99, None, 1.0, None)]
    got = {r["k"]: r for r in fill_similar(spark.createDataFrame(rows, "k bigint, g string, a double, c string"), "k", ["a"], ["c"], ["a"], ["c"], "g", clusters=2).collect()}
    assert set(got) == {*range(0, 70, 7), 99}
    assert all(got[i]["filled_cat"] == f"name{i % 2}" and got[i]["method"] in ("group", "group_cluster") for i in range(0, 70, 7))
    assert got[99]["method"] == "cluster" and got[99]["filled_cat"] == "name1"


def test_fill_of_nothing(spark):
    df = spark.createDataFrame([], "k bigint, g string, a double, c string")
    assert fill_similar(df, "k", ["a"], ["c"], ["a"], ["c"], "g").count() == 0
    df = spark.createDataFrame([(1, "x", None, None)], "k bigint, g string, a double, c string")
    got = {r["field"]: (r["filled_num"], r["filled_cat"], r["method"]) for r in fill_similar(df, "k", ["a"], ["c"], ["a"], ["c"], "g").collect()}
    assert got == {"a": (None, None, "none"), "c": (None, None, "none")}


def test_runs_take_the_name_of_their_file(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "b"), (5, None), (6, None), (7, "b"), (9, None), (0, None)]
    got = {r["k"]: r["f"] for r in fill_runs(spark.createDataFrame(rows, "k bigint, n string"), "k", "n", "f").collect()}
    assert got == {0: None, 1: "a", 2: "a", 3: "a", 4: "b", 5: "b", 6: "b", 7: "b", 9: None}
