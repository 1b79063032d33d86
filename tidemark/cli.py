"""Command line: validate-config, run, compile, explain, audit, dataset-card, dataset-replay, evaluate, bench, env."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import yaml

from tidemark import __version__
from tidemark.plans.compiler import audit_programs, compile_program
from tidemark.plans.program import duration_us


def _document(path: str) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def _session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _time(us: int | None) -> str | None:
    return None if us is None else datetime.fromtimestamp(us / 1e6, timezone.utc).isoformat()


def _say(x: Any) -> None:
    print(json.dumps(x, sort_keys=True, ensure_ascii=False, default=str))


def cmd_compile(a: argparse.Namespace) -> int:
    got = compile_program(_document(a.program), a.state_budget)
    if got.plan is None:
        for d in got.diagnostics:
            _say({"code": d.code, "node": d.node, "message": d.message})
        return 1
    for c in got.plan.cards():
        _say(c)
    _say({"hash": got.plan.hash, "state_bound": got.plan.state_bound, "status": got.status})
    return 0


def cmd_explain(a: argparse.Namespace) -> int:
    from tidemark.plans.engine import execute
    from tidemark.records import validated
    from tidemark.sources.archives import yaml_log

    got = compile_program(_document(a.program))
    if got.plan is None:
        return cmd_compile(argparse.Namespace(program=a.program, state_budget=None))
    spark = _session()
    log, asked = yaml_log(spark, a.records)
    graphs = None
    if a.graphs:
        edges = [(g, e, r) for g, m in _document(a.graphs).items() for e, rs in m.items() for r in rs]
        graphs = spark.createDataFrame(edges, "graph string, entity_id string, related_id string")
    for r in execute(got.plan, validated(log), asked, graphs, lineage=True).orderBy("request_ix").toLocalIterator():
        _say({"entity": r["entity_id"], "at": _time(r["prediction_us"]), "values": {o: {"value": r[o], "records": r[f"{o}__lineage"], "available": _time(r[f"{o}__available_us"])} for o in got.plan.program.outputs}})
    return 0


def cmd_audit(a: argparse.Namespace) -> int:
    corpus = []
    for path in a.files:
        d = _document(path)
        shared = {k: d[k] for k in ("sources", "calendars", "entity_graphs") if k in d}
        corpus += [{"family": d["family"], "expected_code": p.get("expected_code"), "document": shared | {k: p[k] for k in ("name", "nodes", "outputs")}} for p in d["programs"]]
    got = audit_programs(corpus)
    _say(got)
    return int(bool(got["rejected_valid"] or got["accepted_leaking"] or got["accepted_invalid"] or got["wrong_code"]))


def cmd_card(a: argparse.Namespace) -> int:
    from tidemark.sources.archives import open_dataset
    from tidemark.sources.bundle import card

    print(card(open_dataset(_session(), a.dataset, a.option)))
    return 0


def cmd_replay(a: argparse.Namespace) -> int:
    """Requests every ``--every`` from the first to the last arrival, with a late-data policy."""
    from pyspark.sql import functions as F

    from tidemark.plans.evaluation import us_of
    from tidemark.records import available_by, deduplicate, late_records
    from tidemark.sources.archives import open_dataset
    from tidemark.streaming.late import execute_with_late

    got = compile_program(_document(a.program))
    if got.plan is None:
        return cmd_compile(argparse.Namespace(program=a.program, state_budget=None))
    spark = _session()
    b = open_dataset(spark, a.dataset, a.option)
    whole = deduplicate(b.records)
    early = available_by(whole, us_of(a.as_of)) if a.as_of else whole
    span = early.agg(F.min("available_us"), F.max("available_us")).first()
    start = us_of(a.start) if a.start else span[0]
    every = duration_us(a.every)
    times = [(i, start + i * every) for i in range(min(a.limit, max(0, (span[1] - start) // every + 1)))]
    who = early.select("entity_id").distinct() if a.entity is None else spark.createDataFrame([(a.entity,)], "entity_id string")
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in times])).alias("x")
    asked = who.select("entity_id", grid).select(F.xxhash64("entity_id", "x.i").alias("request_ix"), "entity_id", F.col("x.t").alias("prediction_us"))
    out = execute_with_late(got.plan, early, late_records(early, whole), asked, a.late_policy, b.graphs, deduplicated=True)
    for r in out.orderBy("entity_id", "prediction_us").toLocalIterator():
        _say({"entity": r["entity_id"], "at": _time(r["prediction_us"]), "revised": r["revised"], "retracted": r["retracted"], "values": {o: r[o] for o in got.plan.program.outputs}})
    return 0


def cmd_evaluate(a: argparse.Namespace) -> int:
    """A task file: dataset and options, label, split, horizon, every, season and methods."""
    from tidemark.plans.evaluation import Fold, Split, us_of
    from tidemark.plans.program import read_program
    from tidemark.plans.tasks import run_method
    from tidemark.records import deduplicate
    from tidemark.sources.archives import open_dataset
    from tidemark.sources.sinks import manifest

    t = _document(a.task)
    b = open_dataset(_session(), t["dataset"], [f"{k}={v}" for k, v in t.get("options", {}).items()])
    split = Split(tuple(Fold(f["name"], us_of(f["start"]), us_of(f["end"])) for f in t["split"]["folds"]), duration_us(t["split"].get("gap", "0s")), tuple(t["split"].get("held_out", ())))
    log = deduplicate(b.records)
    results = []
    for m in t["methods"]:
        if "program_file" in m:
            m = {k: v for k, v in m.items() if k != "program_file"} | {"program": _document(str(Path(a.task).parent / m["program_file"]))}
        if "search" in m:
            m = m | {"search": m["search"] | {"program": read_program({"name": "search", "sources": list(b.sources), "nodes": [{"id": "x", "op": "hour_of_day", "params": {"timezone": "UTC"}}], "outputs": ["x"]})}}
        results.append(run_method(m, log, split, (t["label"]["source"], t["label"]["feature"]), duration_us(t["horizon"]), duration_us(t["every"]), a.fold, t.get("season", 24), b.graphs))
        _say(results[-1])
    if a.out:
        manifest(a.out, {"scores.json": results}, {"task": t, "fold": a.fold, "version": __version__})
    return 0


def _run_config(path: str) -> dict[str, Any]:
    """name, seed, output_dir and synthetic (series_count, step_count, start, step_seconds); paths must be relative."""
    c = _document(path)
    want = {"name": str, "seed": int, "output_dir": str, "synthetic": dict}
    inner = {"series_count": int, "step_count": int, "start": str, "step_seconds": int}
    for part, shape in ((c, want), (c.get("synthetic") if isinstance(c, dict) else None, inner)):
        if not isinstance(part, dict) or set(part) != set(shape) or any(not isinstance(part[k], t) for k, t in shape.items()):
            raise ValueError(f"a run configuration has exactly {sorted(want)}, its synthetic part {sorted(inner)}")
    if Path(c["output_dir"]).is_absolute() or ".." in Path(c["output_dir"]).parts:
        raise ValueError("output_dir must be a relative path: an absolute one ties the run to a machine")
    if c["seed"] < 0 or min(c["synthetic"][k] for k in ("series_count", "step_count", "step_seconds")) < 1:
        raise ValueError("counts must be positive and the seed not negative")
    return c


def cmd_validate_config(a: argparse.Namespace) -> int:
    try:
        _say({"status": "valid", "config": _run_config(a.config)})
        return 0
    except ValueError as e:
        _say({"status": "invalid", "message": str(e)})
        return 1


def cmd_run(a: argparse.Namespace) -> int:
    """Write the synthetic table of a run configuration and its manifest."""
    from tidemark.sources.archives import synthetic_table
    from tidemark.sources.sinks import manifest

    c = _run_config(a.config)
    x = c["synthetic"]
    rows = synthetic_table(x["series_count"], x["step_count"], x["start"], x["step_seconds"], c["seed"], "tidemark")
    text = "\n".join(["series_id,step_index,timestamp,value", *(",".join(map(str, r)) for r in rows)]) + "\n"
    _say(manifest(str(Path(a.root) / c["output_dir"]), {"features.csv": text}, {"config": c, "version": __version__}))
    return 0


def cmd_env(_: argparse.Namespace) -> int:
    import pyspark

    _say({"version": __version__, "python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()})
    return 0


def cmd_bench(_: argparse.Namespace) -> int:
    import bench

    bench.main()
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compile", help="check a program and print its cards")
    c.add_argument("program")
    c.add_argument("--state-budget", type=int)
    c.set_defaults(run=cmd_compile)
    c = sub.add_parser("explain", help="values and lineage per request of a YAML log")
    c.add_argument("program")
    c.add_argument("--records", required=True)
    c.add_argument("--graphs")
    c.set_defaults(run=cmd_explain)
    c = sub.add_parser("audit", help="confusion matrix over labelled program files")
    c.add_argument("files", nargs="+")
    c.set_defaults(run=cmd_audit)
    c = sub.add_parser("dataset-card")
    c.add_argument("dataset")
    c.add_argument("--option", action="append", default=[])
    c.set_defaults(run=cmd_card)
    c = sub.add_parser("dataset-replay")
    c.add_argument("dataset")
    c.add_argument("program")
    c.add_argument("--option", action="append", default=[])
    c.add_argument("--as-of")
    c.add_argument("--late-policy", default="ignore", choices=("ignore", "revise", "retract"))
    c.add_argument("--from", dest="start")
    c.add_argument("--limit", type=int, default=24)
    c.add_argument("--every", default="1h")
    c.add_argument("--entity")
    c.set_defaults(run=cmd_replay)
    c = sub.add_parser("evaluate")
    c.add_argument("task")
    c.add_argument("--fold", default="validation")
    c.add_argument("--out")
    c.set_defaults(run=cmd_evaluate)
    c = sub.add_parser("validate-config")
    c.add_argument("config")
    c.set_defaults(run=cmd_validate_config)
    c = sub.add_parser("run", help="write the synthetic table of a run configuration")
    c.add_argument("config")
    c.add_argument("--root", default=".")
    c.set_defaults(run=cmd_run)
    sub.add_parser("env").set_defaults(run=cmd_env)
    sub.add_parser("bench").set_defaults(run=cmd_bench)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
