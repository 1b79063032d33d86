import json
import math
import random
from datetime import datetime, timedelta

import pytest
import yaml

from tidemark import cli
from tidemark.plans.tasks import TaskError, run_method
from tests.test_sources import AIR

EXAMPLES = __file__.rsplit("/", 2)[0] + "/examples"


@pytest.fixture(scope="module")
def air(tmp_path_factory):
    root = tmp_path_factory.mktemp("air")
    rng = random.Random(2)
    for s, base in (("North", 40), ("South", 70)):
        rows, at, level = [], datetime(2016, 1, 1), base
        for i in range(24 * 24):
            level = 0.9 * level + 0.1 * base + rng.gauss(0, 4)
            pm = "NA" if rng.random() < 0.05 else f"{max(1, level + 10 * math.sin(i / 24 * 6.28)):.1f}"
            rows.append(f"{i + 1},{at.year},{at.month},{at.day},{at.hour},{pm},9,1,2,300,4,{5 + rng.random():.1f},1020,-7,0,{rng.choice(['N', 'S', 'NA'])},{rng.random() * 4:.1f},{s}")
            at += timedelta(hours=1)
        (root / f"PRSA_Data_{s}_20130301-20170228.csv").write_text(AIR + "\n".join(rows) + "\n")
    return root


def task(air, tmp_path):
    t = yaml.safe_load(open(f"{EXAMPLES}/air_task.yaml"))
    t["options"]["root"] = str(air)
    t["horizon"] = "3h"
    t["every"] = "2h"
    t["split"] = {"gap": "1d", "folds": [{"name": "train", "start": "2016-01-02T00:00:00Z", "end": "2016-01-14T00:00:00Z"}, {"name": "validation", "start": "2016-01-15T00:00:00Z", "end": "2016-01-19T00:00:00Z"}, {"name": "test", "start": "2016-01-20T00:00:00Z", "end": "2016-01-23T00:00:00Z"}]}
    t["methods"][1]["search"] = {"strategy": "greedy", "max_features": 2, "grid": None}
    t["methods"] = [t["methods"][0], {"name": "naive", "predictor": "identity", "output": "now", "program_file": "air_program.yaml"}]
    (tmp_path / "air_program.yaml").write_text(open(f"{EXAMPLES}/air_program.yaml").read())
    (tmp_path / "task.yaml").write_text(yaml.safe_dump(t))
    return tmp_path / "task.yaml"


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_compile(capsys):
    assert cli.main(["compile", f"{EXAMPLES}/air_program.yaml"]) == 0
    out = lines(capsys)
    assert out[-1]["status"] == "accepted" and out[-1]["state_bound"] == 49 + 13 + 1 and len(out) == 9
    assert cli.main(["compile", f"{EXAMPLES}/air_program.yaml", "--state-budget", "5"]) == 1
    assert lines(capsys)[0]["code"] == "E-RESOURCE-002"


def test_explain_and_audit(spark, tmp_path, capsys):
    (tmp_path / "log.yaml").write_text('records:\n  - {id: a, source: beijing_air, feature: pm2_5, event_time: "2024-01-01T00:00:00Z", value: 10}\n  - {id: b, source: beijing_air, feature: pm2_5, event_time: "2024-01-01T01:00:00Z", available_time: "2024-01-01T09:00:00Z", value: 99}\nrequests:\n  - {at: "2024-01-01T03:00:00Z"}\n')
    assert cli.main(["explain", f"{EXAMPLES}/air_program.yaml", "--records", str(tmp_path / "log.yaml")]) == 0
    v = lines(capsys)[0]["values"]
    assert v["now"] == {"value": 10.0, "records": ["a"], "available": "2024-01-01T00:00:00+00:00"} and v["hour"]["value"] == 11.0
    (tmp_path / "leaks.yaml").write_text(yaml.safe_dump({"family": "leaking", "sources": [{"source_id": "s", "feature_name": "x", "max_input_rate_per_hour": 1}], "programs": [{"name": "p", "expected_code": "E-TIME-002", "nodes": [{"id": "v", "op": "lag", "params": {"source": "s", "feature": "x", "lag": "-1h"}}], "outputs": ["v"]}]}))
    assert cli.main(["audit", str(tmp_path / "leaks.yaml")]) == 0
    assert lines(capsys)[0]["rejected_leaking"] == 1


def test_card_and_replay(spark, air, capsys):
    assert cli.main(["dataset-card", "beijing", "--option", f"root={air}"]) == 0
    assert "| measurement | beijing_air | pm2_5 | 1152 |" in capsys.readouterr().out
    assert cli.main(["dataset-replay", "beijing", f"{EXAMPLES}/air_program.yaml", "--option", f"root={air}", "--as-of", "2016-01-05T00:30:00Z", "--from", "2016-01-04T00:00:00Z", "--limit", "3", "--late-policy", "retract"]) == 0
    out = lines(capsys)
    assert len(out) == 6 and {r["retracted"] for r in out} == {False} and all(r["values"]["day"] is not None for r in out)


def test_evaluate(spark, air, tmp_path, capsys):
    path = task(air, tmp_path)
    assert cli.main(["evaluate", str(path), "--fold", "test", "--out", str(tmp_path / "out")]) == 0
    ridge, naive = lines(capsys)
    assert ridge["n"] > 50 and ridge["mae"] < naive["mae"] * 1.3 and ridge["mase"] > 0 and ridge["penalty"] in (0.01, 0.1, 1.0, 10.0, 100.0)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["artifacts"][0]["path"] == "scores.json"


def test_search(spark, air):
    from tidemark.plans.evaluation import Fold, Split, us_of
    from tidemark.plans.program import read_program
    from tidemark.plans.search_space import Grid
    from tidemark.records import deduplicate
    from tidemark.sources.archives import air_quality

    b = air_quality(spark, str(air), features=["pm2_5", "wspm"])
    sources = [s for s in b.sources if s["source_id"] == "beijing_air"]
    program = read_program({"name": "s", "sources": sources, "nodes": [{"id": "x", "op": "hour_of_day", "params": {"timezone": "UTC"}}], "outputs": ["x"]})
    split = Split((Fold("train", us_of("2016-01-02T00:00:00Z"), us_of("2016-01-14T00:00:00Z")), Fold("validation", us_of("2016-01-15T00:00:00Z"), us_of("2016-01-19T00:00:00Z"))))
    grid = Grid(windows=("3h",), lags=("1h",), staleness=("3h",), pairs=2)
    method = {"name": "m", "predictor": "ridge", "search": {"program": program, "grid": grid, "max_features": 2}}
    got = run_method(method, deduplicate(b.records), split, ("beijing_target", "pm2_5"), 3 * 3_600_000_000, 4 * 3_600_000_000)
    assert 1 <= len(got["features"]) <= 2 and got["mae"] < 20
    for bad in ({"name": "m", "predictor": "magic", "program": {}}, {"name": "m", "predictor": "ridge"}, {"name": "m", "predictor": "identity", "program": {}}):
        with pytest.raises(TaskError):
            run_method(bad, b.records, split, ("beijing_target", "pm2_5"), 1, 1)


def test_run_configuration(tmp_path, capsys):
    good = {"name": "r", "seed": 3, "output_dir": "out/r", "synthetic": {"series_count": 2, "step_count": 3, "start": "2024-01-01T00:00:00+00:00", "step_seconds": 3600}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(good))
    assert cli.main(["validate-config", str(tmp_path / "c.yaml")]) == 0
    sums = []
    for _ in range(2):
        assert cli.main(["run", str(tmp_path / "c.yaml"), "--root", str(tmp_path)]) == 0
        sums.append(json.loads((tmp_path / "out/r/manifest.json").read_text())["artifacts"][0]["sha256"])
    assert sums[0] == sums[1] and len((tmp_path / "out/r/features.csv").read_text().splitlines()) == 7
    for bad in ({"output_dir": "/tmp/x"}, {"output_dir": "../x"}, {"seed": "3"}, {"extra": 1}, {"synthetic": {}}):
        (tmp_path / "b.yaml").write_text(yaml.safe_dump(good | bad))
        assert cli.main(["validate-config", str(tmp_path / "b.yaml")]) == 1
    capsys.readouterr()
