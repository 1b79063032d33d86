"""Late data: what to do with records that arrive after features were computed.

ignore keeps the first answers; revise computes them again with the late records and says which changed; retract keeps
them and marks those that a late record could have changed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.boundaries import visible
from tidemark.functions.common import attach_row
from tidemark.plans.compiler import ExecutionPlan
from tidemark.plans.engine import execute

POLICIES = ("ignore", "revise", "retract")


def affected(requests: DataFrame, late: DataFrame, plan: ExecutionPlan, precise: bool, graphs: DataFrame | None = None) -> DataFrame:
    """request_ix of requests that a late record was visible to. Not ``precise``: a late record of any entity or stream counts.
    ``precise``: one of the request's entity in a stream that the program reads, or of a related entity in a stream that it reads there."""
    if not precise:
        first = late.agg(F.min("available_us").alias("_first"))
        hit = attach_row(requests, first).filter(visible(F.col("_first"), F.col("prediction_us")))
        return hit.select("request_ix")
    read = [plan.nodes[n] for n in plan.needed if plan.nodes[n].source]

    def first(streams: set[tuple[str, str]]) -> DataFrame:
        keep = F.lit(False)
        for source, feature in sorted(streams):
            keep = keep | ((F.col("source_id") == source) & (F.col("feature_name") == feature))
        return late.filter(keep).groupBy("entity_id").agg(F.min("available_us").alias("_first"))

    firsts = first({n.stream for n in read if n.operator.family != "cross"})
    for ref in sorted({n.params["entity_ref"] for n in read if n.operator.family == "cross"}):
        if graphs is None:
            raise ValueError("the program reads related entities: pass their graphs")
        edges = graphs.filter(F.col("graph") == ref).select(F.col("entity_id").alias("_own"), F.col("related_id").alias("entity_id"))
        far = first({n.stream for n in read if n.operator.family == "cross" and n.params["entity_ref"] == ref})
        firsts = firsts.unionByName(edges.join(far, "entity_id").select(F.col("_own").alias("entity_id"), "_first"))
    firsts = firsts.groupBy("entity_id").agg(F.min("_first").alias("_first"))
    return requests.join(firsts, "entity_id").filter(visible(F.col("_first"), F.col("prediction_us"))).select("request_ix")


def execute_with_late(plan: ExecutionPlan, log: DataFrame, late: DataFrame, requests: DataFrame, policy: str, graphs: DataFrame | None = None, precise: bool = False, **more: Any) -> DataFrame:
    """The outputs with ``revised`` (other records stand behind their value than behind the first answer) and ``retracted``.

    Numbers of one lineage are equal up to the order of summation, so it is the lineage that is compared, and that the value is there.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    more = more | {"lineage": True}
    base = execute(plan, log, requests, graphs, **more)
    no = F.lit(False)
    if policy == "ignore":
        return base.withColumns({"revised": no, "retracted": no})
    if policy == "retract":
        hit = affected(requests, late, plan, precise, graphs).distinct().withColumn("_hit", F.lit(True))
        out = base.join(hit, "request_ix", "left").withColumn("retracted", F.coalesce("_hit", no)).drop("_hit")
        return out.withColumn("revised", no)
    again = execute(plan, log.unionByName(late), requests, graphs, **more)
    cols = [c for c in base.columns if c not in ("request_ix", "entity_id", "prediction_us")]
    first = base.select("request_ix", *[F.col(c).alias(f"_first_{c}") for c in cols])
    both = again.join(first, "request_ix")
    same, kinds = F.lit(True), dict(base.dtypes)
    for c in cols:
        now, then = F.col(c), F.col(f"_first_{c}")
        same = same & (now.isNull() == then.isNull() if kinds[c] == "double" else now.eqNullSafe(then))
    return both.withColumn("revised", ~same).withColumn("retracted", no).drop(*[f"_first_{c}" for c in cols])


def stream_editions(events: DataFrame, stream: list[str], lateness: str = "72 hours", period: str = "1 day") -> DataFrame:
    """Daily aggregates of a streaming log (``event_time`` TIMESTAMP, ``record_id``, ``value_num``), corrected in update mode
    as late records come, up to ``lateness`` behind the newest event; repeated deliveries count once within it."""
    once = events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["record_id"])
    out = once.groupBy(*stream, F.window("event_time", period).alias("period")).agg(F.count("value_num").alias("n"), F.sum("value_num").alias("sum"), F.min("value_num").alias("min"), F.max("value_num").alias("max"))
    return out.select(*stream, F.col("period.start").alias("period_start"), "n", "sum", "min", "max")
