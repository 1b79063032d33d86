import pytest

from tidemark.plans import units
from tidemark.plans.catalog import OPERATORS
from tidemark.plans.compiler import CODES, audit_programs, compile_program
from tidemark.plans.program import duration_text, duration_us
from tidemark.plans.search_space import Grid, budget, candidates
from tidemark.plans.program import read_program

SOURCES = [
    {"source_id": "st", "feature_name": "temp", "unit": "kelvin", "max_input_rate_per_hour": 4},
    {"source_id": "st", "feature_name": "load", "unit": "kilowatt", "max_input_rate_per_hour": 4},
    {"source_id": "st", "feature_name": "sky", "value_type": "category", "max_input_rate_per_hour": 4, "categories": ["clear", "rain"]},
    {"source_id": "free", "feature_name": "temp", "unit": "kelvin"},
    {"source_id": "odd", "feature_name": "x", "unit": "smoot", "max_input_rate_per_hour": 1},
    {"source_id": "nwp", "feature_name": "fc", "kind": "forecast", "unit": "kelvin", "max_input_rate_per_hour": 2, "max_forecast_horizon": "48h"},
    {"source_id": "nwp", "feature_name": "free", "kind": "forecast", "unit": "kelvin"},
    {"source_id": "nwp", "feature_name": "back", "kind": "forecast", "unit": "kelvin", "max_input_rate_per_hour": 2, "max_forecast_horizon": "-1h"},
]
T = {"source": "st", "feature": "temp"}


def program(nodes, outputs=None, **more):
    return {"name": "p", "sources": SOURCES, "calendars": {"si": ["2024-01-01"], "bad": ["soon"]}, "entity_graphs": [{"name": "g", "max_related_entities": 3}], "nodes": nodes, "outputs": outputs or [nodes[-1]["id"]]} | more


def node(op, i="v", inputs=(), **params):
    return {"id": i, "op": op, "inputs": list(inputs), "params": params}


REJECTED = {
    "E-SCHEMA-001": program([node("mean", window=5, **T)]),
    "E-SCHEMA-002": program([node("last", **T)], schema_version="9"),
    "E-RESOLVE-001": program([node("ema", **T)]),
    "E-RESOLVE-002": program([node("last", source="sat", feature="temp")]),
    "E-RESOLVE-003": program([node("last", source="st", feature="humidity")]),
    "E-RESOLVE-004": program([node("last", "a", **T), node("add", inputs=["a", "zz"])]),
    "E-RESOLVE-005": program([node("last", **T)], ["w"]),
    "E-RESOLVE-006": program([node("is_holiday", timezone="UTC", calendar="xx")]),
    "E-RESOLVE-007": program([node("hour_of_day", timezone="Middle/Earth")]),
    "E-RESOLVE-008": program([node("cross_entity_mean", entity_ref="h", **T)]),
    "E-GRAPH-001": program([node("add", "a", ["b", "b"]), node("add", "b", ["a", "a"])]),
    "E-GRAPH-002": program([node("last", **T), node("last", **T)]),
    "E-GRAPH-003": program([node("last", "a", **T), node("add", inputs=["a"])]),
    "E-GRAPH-004": program([node("mean", **T)]),
    "E-GRAPH-005": program([node("last", halflife="3h", **T)]),
    "E-TYPE-001": program([node("last", "a", **T), node("last", "b", source="st", feature="sky"), node("add", inputs=["a", "b"])]),
    "E-TYPE-002": program([node("mean", source="st", feature="sky", window="1h")]),
    "E-UNIT-001": program([node("last", "a", **T), node("staleness", "b", **T), node("add", inputs=["a", "b"])]),
    "E-UNIT-002": program([node("last", source="odd", feature="x")]),
    "E-TIME-001": program([node("mean", window="0h", **T)]),
    "E-TIME-002": program([node("lag", lag="-1h", **T)]),
    "E-TIME-003": program([node("last", source="nwp", feature="fc")]),
    "E-RESOURCE-001": program([node("mean", source="free", feature="temp", window="1h")]),
}


@pytest.mark.parametrize("code", sorted(REJECTED))
def test_each_code(code):
    got = compile_program(REJECTED[code])
    assert got.status == "rejected" and got.plan is None and {d.code for d in got.diagnostics} == {code}


def test_all_codes_are_reachable():
    assert {*REJECTED, "E-TIME-004", "E-RESOURCE-002"} == set(CODES) and len(CODES) == 25
    ok = program([node("mean", window="24h", **T)])
    assert compile_program(ok, lowered=frozenset({"point"})).diagnostics[0].code == "E-TIME-004"
    assert compile_program(ok, state_budget=96).diagnostics[0].code == "E-RESOURCE-002"
    assert compile_program(ok, state_budget=97).plan.state_bound == 97


@pytest.mark.parametrize("doc", [program([node("forecast", source="nwp", feature="free", lead="1h")]), program([node("forecast", source="nwp", feature="back", lead="1h")]), program([node("is_holiday", timezone="UTC", calendar="bad")]), program([node("last", max_staleness="-1h", **T)]), program([node("is_in", "v", ["a"], values=[]), node("last", "a", source="st", feature="sky")]), {"name": "x"}, program([node("last", i="1bad", **T)])])
def test_other_rejections(doc):
    assert compile_program(doc).status == "rejected"


def test_a_failed_input_says_nothing_more():
    got = compile_program(program([node("lag", "a", lag="-1h", **T), node("add", "b", ["a", "a"]), node("add", "v", ["b", "a"])]))
    assert [d.code for d in got.diagnostics] == ["E-TIME-002"]


def test_accepted_programs_and_their_plans():
    ops = [node(o.name, f"n_{o.name}", window="6h", **T) for o in OPERATORS.values() if o.family == "window"]
    ops += [node("forecast", "f", source="nwp", feature="fc", lead="-1h"), node("last", "a", max_staleness="30m", **T), node("last", "l", source="st", feature="load"), node("multiply", "m", ["a", "l"]), node("divide", "d", ["l", "l"]), node("cross_entity_mean", "x", entity_ref="g", **T)]
    plan = compile_program(program(ops, [n["id"] for n in ops])).plan
    assert plan.nodes["n_variance"].unit == "kelvin ** 2" and plan.nodes["n_slope"].unit == "kelvin / s" and plan.nodes["d"].unit == "" and plan.nodes["n_time_since_max"].unit == "s"
    assert plan.nodes["f"].state_records == 97 and plan.nodes["x"].state_records == 3
    assert plan.state_bound == 25 + 97 + 1 + 3
    assert plan.nodes["m"].lookback_us == 0 and plan.nodes["n_mean"].lookback_us == 6 * 3_600_000_000
    assert {c["node"] for c in plan.cards()} == {n["id"] for n in ops}
    assert compile_program(program(ops, [n["id"] for n in ops])).plan.hash == plan.hash
    assert len(OPERATORS) == 39


def test_unneeded_nodes_are_checked_but_not_run():
    plan = compile_program(program([node("mean", "a", window="1h", **T), node("last", "v", **T)], ["v"])).plan
    assert plan.order == ("a", "v") and plan.needed == ("v",)


def test_audit_counts():
    corpus = [{"document": REJECTED["E-TIME-002"], "family": "leaking", "expected_code": "E-TIME-002"}, {"document": REJECTED["E-TYPE-001"], "family": "invalid", "expected_code": "E-UNIT-001"}, {"document": program([node("last", **T)]), "family": "valid"}]
    got = audit_programs(corpus)
    assert (got["rejected_leaking"], got["rejected_invalid"], got["accepted_valid"], got["right_code"], got["wrong_code"]) == (1, 1, 1, 1, 1)


@pytest.mark.parametrize("a,b,same", [("kelvin", "degC", True), ("kilowatt", "watt", True), ("kilowatt_hour", "joule", True), ("euro / megawatt_hour", "euro / joule", True), ("microgram / meter ** 3", "kg/m^3", True), ("meter / second", "km / hour", True), ("", "percent", True), ("kelvin", "second", False), ("watt / meter ** 2", "watt", False), ("euro", "", False)])
def test_units(a, b, same):
    assert units.compatible(a, b) is same


@pytest.mark.parametrize("text", ["smoot", "kelvin **", "(meter", "meter//second", "3 ** x"])
def test_unknown_units(text):
    with pytest.raises(units.UnitError):
        units.parse(text)


@pytest.mark.parametrize("text,us", [("90s", 90_000_000), ("15m", 900_000_000), ("1.5h", 5_400_000_000), ("-2d", -172_800_000_000)])
def test_durations(text, us):
    assert duration_us(text) == us and duration_us(duration_text(us)) == us
    for bad in ("2", "h", "2 h", "1w", ""):
        with pytest.raises(ValueError):
            duration_us(bad)


def test_candidates_compile_and_pairs_are_shared_out():
    doc = program([node("last", **T)]) | {"sources": [s for s in SOURCES if s["source_id"] in ("st",)]}
    nodes = candidates(read_program(doc), Grid(pairs=3))
    kept = [n for n in nodes if n["op"] != "subtract"]
    assert compile_program(doc | {"nodes": kept, "outputs": [kept[0]["id"]]}).status == "accepted"
    assert [n["op"] for n in nodes if n["op"] in ("subtract", "divide")] == ["subtract", "divide"]
    assert len({n["id"] for n in nodes}) == len(nodes)
    assert budget(60, 9) == 1000
