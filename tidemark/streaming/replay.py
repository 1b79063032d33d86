"""Structured Streaming execution of a program: a keyed stateful query over records and requests.

Records (clocked by availability) and requests (by prediction time) come as one stream with a watermark on the clock. Per
entity a processor holds what hasn't been passed by the watermark, then goes through it in order of (clock, arrivals
before requests, id), keeps the records that any later request can still need, and answers each request from them.
Records that no window, lag or lead of the program reaches any more are dropped; a state larger than the compiled bound
is an error, as is a record id that comes with other content. Requests aren't fanned out along the edges to related
entities, so programs with ``cross_entity_mean`` are refused here and run in batch only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.compiler import ExecutionPlan
from tidemark.streaming.kernels import evaluate, payload

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ("record_id", "kind", "entity_id", "source_id", "feature_name", "value_num", "value_cat", "unit", "event_us", "available_us", "valid_us", "issued_us", "revision_id", "quality")
_CONTENT = tuple(f for f in _FIELDS if f not in ("record_id", "available_us"))
ARRIVAL, REQUEST, END = 0, 2, 9


def as_events(log: DataFrame, requests: DataFrame) -> DataFrame:
    """One stream of both: entity_id, clock (TIMESTAMP), clock_us, rank, ident and the row itself as JSON."""
    record = F.to_json(F.struct(*[F.col(f) for f in _FIELDS]), {"ignoreNullFields": "false"})
    arrivals = log.select("entity_id", F.col("available_us").alias("clock_us"), F.lit(ARRIVAL).alias("rank"), F.col("record_id").alias("ident"), record.alias("row"))
    asked = requests.select("entity_id", F.col("prediction_us").alias("clock_us"), F.lit(REQUEST).alias("rank"), F.col("request_ix").cast("string").alias("ident"), F.to_json(F.struct("request_ix")).alias("row"))
    return arrivals.unionByName(asked).withColumn("clock", F.timestamp_micros("clock_us"))


def end_marker(events: DataFrame, after: str = "2100-01-01 00:00:00") -> DataFrame:
    """One row far in the future, to be delivered last: it moves the watermark past every request of a finite stream."""
    one = events.sparkSession.range(1).select(F.lit("").alias("entity_id"), F.unix_micros(F.to_timestamp(F.lit(after))).alias("clock_us"), F.lit(END).alias("rank"), F.lit("").alias("ident"), F.lit("{}").alias("row"))
    return one.withColumn("clock", F.timestamp_micros("clock_us")).select(*events.columns)


class ReplayState:
    """What one entity retains; also used without Spark, in tests."""

    def __init__(self, plan: ExecutionPlan, enforce: bool = True):
        self.plan, self.enforce = plan, enforce
        self.kept: dict[str, dict[str, Any]] = {}
        self.seen: dict[str, str] = {}
        self.peak = 0
        nodes = [plan.nodes[n] for n in plan.needed if plan.nodes[n].source]
        self.reach: dict[tuple, int] = {}
        for n in nodes:
            self.reach[n.stream] = max(self.reach.get(n.stream, 0), n.lookback_us)
        leads = {n.stream: n.params["lead_us"] for n in nodes if n.operator.name == "forecast"}
        for n in nodes:
            if n.operator.name == "forecast":
                leads[n.stream] = min(leads[n.stream], n.params["lead_us"])
        self.leads = leads

    def arrive(self, r: dict[str, Any]) -> None:
        if (r["source_id"], r["feature_name"]) not in self.reach:
            return
        mark = hashlib.blake2b(json.dumps([r[f] for f in _CONTENT]).encode(), digest_size=8).hexdigest()
        if r["record_id"] in self.seen:
            if self.seen[r["record_id"]] != mark:
                raise ValueError(f"record id with differing contents: {r['record_id']}")
            return
        self.seen[r["record_id"]] = mark
        self.kept[r["record_id"]] = r

    def prune(self, t: int) -> None:
        """Keep what a request at t or later can reach, and the newest value of each stream."""
        newest: dict[tuple, tuple] = {}
        for r in self.kept.values():
            key = (r["source_id"], r["feature_name"])
            if r["kind"] != "forecast" and payload(r) is not None:
                newest[key] = max(newest.get(key, ()), (r["event_us"], r["available_us"], r["record_id"]))
        tops = {x[2] for x in newest.values()}
        best: dict[tuple, tuple] = {}
        for r in self.kept.values():
            if r["kind"] == "forecast" and payload(r) is not None:
                key = (r["source_id"], r["feature_name"], r["valid_us"])
                best[key] = max(best.get(key, ()), (r["issued_us"], r["available_us"], r["revision_id"] or "", r["record_id"]))
        issues = {x[3] for x in best.values()}

        def needed(r: dict[str, Any]) -> bool:
            key = (r["source_id"], r["feature_name"])
            if r["kind"] == "forecast":
                return r["record_id"] in issues and r["valid_us"] >= t + self.leads.get(key, 0)
            return r["record_id"] in tops or r["event_us"] >= t - self.reach[key]

        self.kept = {k: r for k, r in self.kept.items() if needed(r)}
        self.peak = max(self.peak, len(self.kept))
        bound = self.plan.state_bound + len(self.reach)
        if self.enforce and len(self.kept) > bound:
            raise ValueError(f"state of {len(self.kept)} records exceeds the compiled bound of {bound}: a source is faster than declared")

    def answer(self, entity: str, t: int) -> dict[str, Any]:
        self.prune(t)
        return evaluate(self.plan, list(self.kept.values()), entity, t)


def replay_rows(plan: ExecutionPlan, rows: list[tuple[int, int, str, str]], entity: str, state: ReplayState | None = None) -> Iterator[dict[str, Any]]:
    """Go through (clock_us, rank, ident, JSON) of one entity in order."""
    state = state or ReplayState(plan)
    for clock, rank, _, row in sorted(rows):
        if rank == ARRIVAL:
            state.arrive(json.loads(row))
        elif rank == REQUEST:
            got = state.answer(entity, clock)
            out: dict[str, Any] = {"request_ix": json.loads(row)["request_ix"], "entity_id": entity, "prediction_us": clock}
            for o in plan.program.outputs:
                out |= {o: got[o].value, f"{o}__lineage": list(got[o].lineage), f"{o}__available_us": got[o].available_us}
            yield out


def output_schema(plan: ExecutionPlan) -> str:
    cols = ["request_ix bigint", "entity_id string", "prediction_us bigint"]
    for o in plan.program.outputs:
        cols += [f"{o} {'string' if plan.nodes[o].value_type == 'category' else 'double'}", f"{o}__lineage array<string>", f"{o}__available_us bigint"]
    return ", ".join(cols)


class Replay(StatefulProcessor):
    def __init__(self, plan: ExecutionPlan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "clock_us bigint, rank int, ident string, row string")
        self.memory = handle.getValueState("memory", "kept string, seen string, peak int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new, timers = [], set()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                new.append((int(r.clock_us), int(r.rank), r.ident, r.row))
                timers.add(-(-int(r.clock_us) // 1000))
        if new:
            self.pending.appendList(new)
        for at in timers:
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = list(self.pending.get())
        due = [tuple(r) for r in rows if r[0] <= upto]
        if not due:
            yield pd.DataFrame()
            return
        later = [tuple(r) for r in rows if r[0] > upto]
        state = ReplayState(self.plan)
        if self.memory.exists():
            kept, seen, peak = self.memory.get()
            state.kept, state.seen, state.peak = json.loads(kept), json.loads(seen), peak
        out = list(replay_rows(self.plan, due, key[0], state))
        self.memory.update((json.dumps(state.kept), json.dumps(state.seen), int(state.peak)))
        self.pending.clear()
        if later:
            self.pending.put(later)
        yield pd.DataFrame(out) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def stream_features(plan: ExecutionPlan, events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A streaming DataFrame of answers. ``events``: a streaming frame as of ``as_events``; ``delay``: its watermark.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB. A request is answered once the
    watermark has passed it.
    """
    if any(plan.nodes[n].operator.family == "cross" for n in plan.needed):
        raise ValueError("related entities aren't read in streaming; run the program in batch")
    rows = events.withWatermark("clock", delay).groupBy("entity_id")
    return rows.transformWithStateInPandas(statefulProcessor=Replay(plan), outputStructType=output_schema(plan), outputMode="Append", timeMode="EventTime")


def replay_batch(plan: ExecutionPlan, log: DataFrame, requests: DataFrame) -> DataFrame:
    """The same processor over a bounded log: one group per entity. Its state is bounded by the program; its input isn't,
    so for large logs use ``plans.engine.execute``, which this one serves to check."""
    schema = output_schema(plan)
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def go(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["clock_us"].astype(int), pdf["rank"].astype(int), pdf["ident"], pdf["row"]))
        return pd.DataFrame(list(replay_rows(plan, rows, key[0])), columns=columns)

    return as_events(log, requests).groupBy("entity_id").applyInPandas(go, schema)
