"""Task runner: methods (a program, or a search over candidates) with a predictor, fitted, tuned and scored on the folds of a split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import cut
from tidemark.operators import models
from tidemark.plans.compiler import ExecutionPlan, compile_program
from tidemark.plans.engine import execute
from tidemark.plans.evaluation import Split, examples, label_index, naive_scales, revealed_by, scores
from tidemark.plans.program import Program
from tidemark.plans.search_space import Grid, candidates

PREDICTORS = ("identity", "ridge", "trees")


class TaskError(ValueError):
    pass


def compilable(program: Program, nodes: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """The candidates that compile; pairs with incompatible units, for instance, drop out."""
    kept: list[dict[str, Any]] = []
    base = program.model_dump()
    for n in nodes:
        doc = base | {"nodes": [*kept, dict(n)], "outputs": [n["id"]]}
        if compile_program(doc).plan is not None:
            kept.append(dict(n))
    return kept


def searched_program(program: Program, grid: Grid, label_sources: Sequence[str]) -> ExecutionPlan:
    """One plan that computes every candidate at once."""
    nodes = compilable(program, candidates(program, grid, label_sources))
    if not nodes:
        raise TaskError("no candidate compiles")
    types = compile_program(program.model_dump() | {"nodes": nodes, "outputs": [n["id"] for n in nodes]}).plan
    numbers = [n for n in types.order if types.nodes[n].value_type == "number"]
    return compile_program(program.model_dump() | {"nodes": nodes, "outputs": numbers}).plan


def fold_examples(plan: ExecutionPlan, log: DataFrame, labels: DataFrame, split: Split, fold: str, entities: DataFrame, every_us: int, horizon_us: int, graphs: DataFrame | None) -> DataFrame:
    asked = split.times(entities, fold, every_us)
    return examples(execute(plan, log, asked, graphs, deduplicated=True), labels, horizon_us)


def run_method(
    method: Mapping[str, Any],
    log: DataFrame,
    split: Split,
    label: tuple[str, str],
    horizon_us: int,
    every_us: int,
    fold: str = "validation",
    season: int = 24,
    graphs: DataFrame | None = None,
) -> dict[str, Any]:
    """Scores of one method. method: name, predictor, and ``program`` or ``search`` (program, grid, strategy, max_features);
    ``identity`` needs ``output``. ``log`` is deduplicated. Fitting uses the train fold's labels known by its end."""
    kind = method["predictor"]
    if kind not in PREDICTORS:
        raise TaskError(f"predictor must be one of {PREDICTORS}")
    if ("program" in method) == ("search" in method):
        raise TaskError("a method has a program or a search, not both")
    if kind == "identity" and "output" not in method:
        raise TaskError("identity needs an output")
    labels = cut(label_index(log, *label))
    entities = labels.select("entity_id").distinct()
    if "program" in method:
        done = compile_program(method["program"])
        if done.plan is None:
            raise TaskError(str(done.diagnostics))
        plan = done.plan
    else:
        plan = searched_program(method["search"]["program"], method["search"].get("grid", Grid()), [label[0]])
    rows = {f: cut(fold_examples(plan, log, labels, split, f, entities, every_us, horizon_us, graphs)) for f in dict.fromkeys(("train", "validation", fold))}
    train = revealed_by(rows["train"], split.fold("train").end_us)
    features = list(plan.program.outputs)
    chosen, penalty = features, None
    if "search" in method:
        s = method["search"]
        known = train.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in features]).first()
        offered = [c for c in features if known[c]]  # a candidate without any value can't be fitted
        pick = models.greedy_selection if s.get("strategy", "greedy") == "greedy" else models.random_selection
        chosen = pick(train, rows["validation"], offered, s.get("max_features", 8), **({"tries": s.get("tries", 20)} if pick is models.random_selection else {}))
    if kind == "identity":
        predicted = models.identity(rows[fold].filter(F.col(method["output"]).isNotNull()), method["output"])
    elif kind == "ridge":
        m, penalty, _ = models.tune_ridge(train, rows["validation"], chosen)
        predicted = models.ridge_predict(rows[fold], m, models.ridge_weights(m, penalty))
    else:
        predicted = models.boosted_trees(train, rows[fold], chosen)
    got = scores(predicted.filter(F.col("target").isNotNull()), naive_scales(labels.filter(F.col("label_us") < split.fold("train").end_us), season)).first()
    return {"method": method["name"], "predictor": kind, "fold": fold, "features": chosen, "penalty": penalty, **got.asDict()}
