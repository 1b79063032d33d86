"""Batch execution of a compiled plan: one DataFrame plan for all requests and outputs.

Leaves that share work are computed together, each family with one join: all point reads by one as-of merge, all lags and
all forecasts by one equi-join each, all windows by one bucketed interval join (per stream on its widest window). A leaf gives rows (request, leaf, value,
lineage); these are put side by side by a single aggregation per request, and the rest of the program is column
expressions over it. Requests with equal entity and time stay separate rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.boundaries import bucket_of, fresh_enough, in_window, visible, window_buckets
from tidemark.operators.known_at import as_known
from tidemark.plans.compiler import ExecutionPlan, NodePlan
from tidemark.records import deduplicate

US_DAY = 86_400_000_000
#: Requests are multiplied by explode, which size estimates don't see: these joins must not turn into unchecked broadcasts.
SHUFFLED = "merge"
#: The struct that stands for a feature value while a plan is put together.
VALUE = "struct<num:double,cat:string,lineage:array<string>,available_us:bigint>"
_NEEDED = ("kind", "entity_id", "source_id", "feature_name", "value_num", "value_cat", "event_us", "valid_us", "issued_us", "revision_id")
_OBS = ("event_us", "available_us", "record_id")


def _value(num: Column, cat: Column | None = None, lineage: Column | None = None, available: Column | None = None) -> Column:
    """A feature value; null values have neither lineage nor availability."""
    cat = cat if cat is not None else F.lit(None).cast("string")
    there = num.isNotNull() | cat.isNotNull()
    ids = lineage if lineage is not None else F.lit(None).cast("array<string>")
    at = available if available is not None else F.lit(None).cast("bigint")
    return F.struct(num.cast("double").alias("num"), cat.alias("cat"), F.when(there, ids).alias("lineage"), F.when(there, at).alias("available_us"))


class _Engine:
    def __init__(self, plan: ExecutionPlan, log: DataFrame, requests: DataFrame, graphs: DataFrame | None, lineage: bool, shard_us: int, deduplicated: bool):
        self.plan, self.graphs, self.lineage, self.shard_us = plan, graphs, lineage, shard_us
        self.nodes = [plan.nodes[n] for n in plan.needed]
        keep = F.lit(False)
        for s, f in plan.streams:
            keep = keep | ((F.col("source_id") == s) & (F.col("feature_name") == f))
        log = log.filter(keep)
        self.log = log if deduplicated else deduplicate(log, _NEEDED)
        self.requests = requests.select("request_ix", "entity_id", F.col("prediction_us").cast("long").alias("t"))

    def ids(self, c: Column) -> Column | None:
        return c if self.lineage else None

    def of(self, *names: str) -> list[NodePlan]:
        return [n for n in self.nodes if n.operator.name in names]

    def with_leaves(self, leaves: Sequence[tuple[NodePlan, dict[str, Column]]]) -> DataFrame:
        """Requests x leaves (a literal list, as long as the program): leaf, source, feature and the leaf's own columns."""
        rows = [F.struct(F.lit(n.id).alias("leaf"), F.lit(n.stream[0]).alias("source_id"), F.lit(n.stream[1]).alias("feature_name"), *[c.alias(k) for k, c in extra.items()]) for n, extra in leaves]
        return self.requests.select("*", F.explode(F.array(*rows)).alias("l")).select("request_ix", "entity_id", "t", "l.*")

    # as-of reads: last, staleness, and last of related entities
    def points(self) -> DataFrame | None:
        own, cross = self.of("last", "staleness"), self.of("cross_entity_mean")
        if not own and not cross:
            return None
        streams = {n.stream for n in own}
        asked = None
        if own:
            rows = F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(f).alias("feature_name")) for s, f in sorted(streams)])
            asked = self.requests.select("request_ix", F.lit(None).cast("string").alias("leaf"), "entity_id", "t", F.explode(rows).alias("s")).select("request_ix", "leaf", "entity_id", "t", "s.*")
        if cross:
            if self.graphs is None:
                raise ValueError("the program reads related entities: pass their graphs")
            far = self.with_leaves([(n, {"graph": F.lit(n.params["entity_ref"])}) for n in cross])
            edges = self._edges()
            far = far.hint(SHUFFLED).join(edges, ["graph", "entity_id"]).select("request_ix", "leaf", F.col("related_id").alias("entity_id"), "t", "source_id", "feature_name")
            asked = far if asked is None else asked.unionByName(far)
        known = self.log.filter("(value_num IS NOT NULL OR value_cat IS NOT NULL) AND kind <> 'forecast'")
        found = as_known(asked, known, {"entity_id": "entity_id", "source_id": "source_id", "feature_name": "feature_name"}, "t", {"r": F.col("available_us")}, _OBS, ["value_num", "value_cat"], width=self.shard_us)
        r = F.col("r")
        out = None
        if own:
            leaves = []
            for n in own:
                here = (F.col("source_id") == n.stream[0]) & (F.col("feature_name") == n.stream[1]) & F.col("leaf").isNull()
                if n.operator.name == "staleness":
                    num, cat = (F.col("t") - r["event_us"]) / F.lit(1e6), None
                else:
                    ok = F.lit(True)
                    if "staleness_us" in n.params:
                        ok = fresh_enough(r["event_us"], F.col("t"), F.lit(n.params["staleness_us"]))
                    num, cat = F.when(ok, r["value_num"]), F.when(ok, r["value_cat"])
                leaves.append(F.when(here, F.struct(F.lit(n.id).alias("leaf"), _value(num, cat, self.ids(F.array(r["record_id"])), r["available_us"]).alias("v"))))
            out = found.filter(F.col("leaf").isNull()).select("request_ix", F.explode(F.array_compact(F.array(*leaves))).alias("x")).select("request_ix", "x.leaf", "x.v")
        if cross:
            got = found.filter(F.col("leaf").isNotNull() & r["value_num"].isNotNull()).groupBy("request_ix", "leaf").agg(F.avg(r["value_num"]).alias("num"), F.max(r["available_us"]).alias("at"), *([F.array_sort(F.collect_set(r["record_id"])).alias("ids")] if self.lineage else []))
            far = got.select("request_ix", "leaf", _value(F.col("num"), None, F.col("ids") if self.lineage else None, F.col("at")).alias("v"))
            out = far if out is None else out.unionByName(far)
        return out

    def _edges(self) -> DataFrame:
        """Distinct edges; a query over an entity with more related entities than its graph declares fails."""
        bound = F.lit(None).cast("int")
        for g in self.plan.program.entity_graphs:
            bound = F.when(F.col("graph") == g.name, F.lit(g.max_related_entities)).otherwise(bound)
        edges = self.graphs.select("graph", "entity_id", "related_id").distinct()
        sizes = edges.groupBy("graph", "entity_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
        worst = sizes.limit(1).collect()
        if worst:
            raise ValueError(f"entity {worst[0]['entity_id']!r} has {worst[0]['_n']} related entities in {worst[0]['graph']!r}, more than declared")
        return edges

    # equality on a shifted clock: lag and forecast
    def shifted(self, names: Sequence[str], shift: str, sign: int, clock: str, order: Sequence[str], forecast: bool) -> DataFrame | None:
        leaves = self.of(*names)
        if not leaves:
            return None
        asked = self.with_leaves([(n, {"at": F.lit(sign * n.params[shift]).cast("long")}) for n in leaves]).withColumn("at", F.col("t") + F.col("at"))
        log = self.log.filter(("kind = 'forecast'" if forecast else "kind <> 'forecast'") + " AND (value_num IS NOT NULL OR value_cat IS NOT NULL)")
        log = log.select("entity_id", "source_id", "feature_name", F.col(clock).alias("at"), "available_us", F.struct(*[F.coalesce("revision_id", F.lit("")).alias("revision_id") if c == "revision_id" else F.col(c) for c in order], "value_num", "value_cat").alias("r"))
        hit = asked.hint(SHUFFLED).join(log, ["entity_id", "source_id", "feature_name", "at"]).filter(visible(F.col("available_us"), F.col("t")))
        best = hit.groupBy("request_ix", "leaf").agg(F.max("r").alias("r"))
        r = F.col("r")
        return best.select("request_ix", "leaf", _value(r["value_num"], r["value_cat"], self.ids(F.array(r["record_id"])), r["available_us"]).alias("v"))

    # trailing windows
    def windows(self) -> DataFrame | None:
        """One join per stream, on its widest window; narrower ones are conditional aggregates over the same pairs."""
        leaves = [n for n in self.nodes if n.operator.family == "window" or n.operator.name == "missing_count"]
        if not leaves:
            return None
        widest: dict[tuple[str, str], int] = {}
        for n in leaves:
            widest[n.stream] = max(widest.get(n.stream, 0), n.params["window_us"])
        streams = {stream: i for i, stream in enumerate(sorted(widest))}
        rows = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(widest[stream]).cast("long").alias("w")) for stream, i in streams.items()])
        asked = self.requests.select("*", F.explode(rows).alias("x")).select("request_ix", "entity_id", "t", "x.*")
        asked = asked.withColumn("bucket", F.explode(window_buckets(F.col("t"), F.col("w"))))
        g, w = F.lit(None).cast("int"), F.lit(None).cast("long")
        for (source, feature), i in streams.items():
            own = (F.col("source_id") == source) & (F.col("feature_name") == feature)
            g, w = F.when(own, F.lit(i)).otherwise(g), F.when(own, F.lit(widest[source, feature]).cast("long")).otherwise(w)
        log = self.log.filter("kind <> 'forecast'").withColumns({"g": g, "_w": w}).filter("g IS NOT NULL").select("entity_id", "g", bucket_of(F.col("event_us"), F.col("_w")).alias("bucket"), *_OBS, "value_num", "value_cat")
        hit = asked.hint(SHUFFLED).join(log, ["entity_id", "g", "bucket"]).filter(visible(F.col("available_us"), F.col("t")) & in_window(F.col("event_us"), F.col("t"), F.col("w")))
        aggs: dict[str, Column] = {}
        kernels = []
        for n in leaves:
            kernels.append(F.when(F.col("g") == streams[n.stream], F.struct(F.lit(n.id).alias("leaf"), self.kernel(n, streams[n.stream], aggs).alias("v"))))
        stats = hit.groupBy("request_ix", "t", "g").agg(*[c.alias(k) for k, c in aggs.items()])
        return stats.select("request_ix", F.explode(F.array_compact(F.array(*kernels))).alias("x")).select("request_ix", "x.leaf", "x.v")

    def kernel(self, n: NodePlan, g: int, aggs: dict[str, Column]) -> Column:
        """The value of a leaf, over aggregates that are added to ``aggs`` (shared by the leaves of a stream and window)."""
        name, t, window = n.operator.name, F.col("t"), n.params["window_us"]
        inside = (F.col("g") == g) & in_window(F.col("event_us"), F.col("t"), F.lit(window))
        v = F.when(inside, F.col("value_num"))
        there = inside & (F.col("value_num").isNotNull() | F.col("value_cat").isNotNull())
        ways = {
            "n": lambda: F.count(F.when(there, True)),
            "at": lambda: F.max(F.when(there, F.col("available_us"))),
            "at_all": lambda: F.max(F.when(inside, F.col("available_us"))),
            "sum": lambda: F.sum(v),
            "mean": lambda: F.avg(v),
            "variance": lambda: F.var_samp(v),
            "stddev": lambda: F.stddev_samp(v),
            "min": lambda: F.min(v),
            "max": lambda: F.max(v),
            "top_event": lambda: F.max(F.when(there, F.struct("value_num", "event_us"))),
            "low_event": lambda: F.max(F.when(there, F.struct((-F.col("value_num")).alias("value_num"), "event_us"))),
            "nums": lambda: F.sort_array(F.collect_list(v)),
            "path": lambda: F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct("event_us", "available_us", "record_id", "value_num")))),
            "seen": lambda: F.sort_array(F.collect_list(F.when(there, F.struct(F.coalesce(F.col("value_cat"), F.col("value_num").cast("string")).alias("text"), "value_num", "value_cat", "event_us")))),
            "ids": lambda: F.array_sort(F.collect_list(F.when(there, F.col("record_id")))),
            "ids_all": lambda: F.array_sort(F.collect_list(F.when(inside, F.col("record_id")))),
        }

        def of(way: str) -> Column:
            aggs.setdefault(f"{way}_{g}_{window}", ways[way]())
            return F.col(f"{way}_{g}_{window}")

        ids, at, cat = None, None, None
        if name == "missing_count":
            ids, at = (of("ids_all") if self.lineage else None), (of("at_all") if self.lineage else None)
        elif self.lineage:
            ids, at = of("ids"), of("at")
        if name == "count":
            num = of("n").cast("double")
        elif name == "missing_count":
            expected = window // n.params["interval_us"]
            num = F.greatest(F.lit(0), F.lit(expected) - of("n")).cast("double")
        elif name in ("sum", "mean", "variance", "stddev", "min", "max"):
            num = of(name)
        elif name in ("median", "p25", "p75"):
            num = quantile(of("nums"), {"median": 0.5, "p25": 0.25, "p75": 0.75}[name])
        elif name == "iqr":
            num = quantile(of("nums"), 0.75) - quantile(of("nums"), 0.25)
        elif name == "mad":
            num = quantile(F.sort_array(F.transform(of("nums"), lambda x: F.abs(x - quantile(of("nums"), 0.5)))), 0.5)
        elif name == "slope":
            num = slope(of("path"))
        elif name in ("time_since_max", "time_since_min"):
            num = (t - of("top_event" if name.endswith("max") else "low_event")["event_us"]) / F.lit(1e6)
        elif name == "distinct_count":
            num = F.size(F.array_distinct(F.transform(of("seen"), lambda x: F.struct(x["value_num"], x["value_cat"])))).cast("double")
        else:
            best = mode(of("seen"))
            num, cat = best["value_num"], best["value_cat"]
        return _value(num, cat, ids, at)

    # putting the leaves side by side, and the rest of the program over them
    def run(self) -> DataFrame:
        parts = [p for p in (self.points(), self.shifted(("lag",), "lag_us", -1, "event_us", _OBS, False), self.shifted(("forecast",), "lead_us", 1, "valid_us", ("issued_us", "available_us", "revision_id", "record_id"), True), self.windows()) if p is not None]
        leaves = [n for n in self.nodes if n.operator.reads]
        wide = self.requests
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            base = self.requests.withColumn("_base", F.lit(True))
            rows = base.unionByName(rows, allowMissingColumns=True)
            picks = [F.max(F.when(F.col("leaf") == n.id, F.col("v"))).alias(n.id) for n in leaves]
            # one exchange: a request's own row and those of its leaves meet here
            wide = rows.groupBy("request_ix").agg(F.max("entity_id").alias("entity_id"), F.max("t").alias("t"), *picks)
            # an empty window counts nothing rather than being null
            zero = _value(F.lit(0.0), None, self.ids(F.array().cast("array<string>")))
            fills = {}
            for n in leaves:
                if n.operator.name in ("count", "distinct_count"):
                    fills[n.id] = F.coalesce(F.col(n.id), zero)
                elif n.operator.name == "missing_count":
                    fills[n.id] = F.coalesce(F.col(n.id), _value(F.lit(float(n.params["window_us"] // n.params["interval_us"])), None, self.ids(F.array().cast("array<string>"))))
            if fills:
                wide = wide.withColumns(fills)
        for n in self.nodes:
            if n.operator.family == "calendar":
                wide = wide.withColumn(n.id, _value(calendar(n, F.col("t")), None, self.ids(F.array().cast("array<string>"))))
            elif n.operator.family == "scalar":
                wide = wide.withColumn(n.id, self.scalar(n))
        return wide

    def scalar(self, n: NodePlan) -> Column:
        ins = [F.col(i) for i in n.inputs]
        name = n.operator.name
        if name == "coalesce":  # the chosen input as a whole, with its lineage only
            a, b = ins
            none = _value(F.lit(None).cast("double"))
            return F.when(a["num"].isNotNull() | a["cat"].isNotNull(), a).otherwise(F.coalesce(b, none))
        if name == "equals":
            return _value((ins[0]["cat"] == n.params["value"]).cast("double"), None, self.ids(ins[0]["lineage"]), ins[0]["available_us"])
        if name == "is_in":
            return _value(ins[0]["cat"].isin(*n.params["values"]).cast("double"), None, self.ids(ins[0]["lineage"]), ins[0]["available_us"])
        a, b = ins[0]["num"], ins[1]["num"]
        num = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: F.try_divide(a, b)}[name]()
        both = F.array_sort(F.array_union(ins[0]["lineage"], ins[1]["lineage"])) if self.lineage else None
        return _value(num, None, both, F.greatest(ins[0]["available_us"], ins[1]["available_us"]))


def quantile(nums: Column, q: float) -> Column:
    """Linear interpolation at (n - 1) q over a sorted array, null for an empty one."""
    h = (F.size(nums) - 1) * F.lit(q)
    low = F.floor(h).cast("int")
    a = F.get(nums, low)
    return F.when(F.size(nums) > 0, F.when(h == low, a).otherwise(a + (h - low) * (F.get(nums, low + 1) - a)))


def slope(path: Column) -> Column:
    """Least squares of value on event seconds, centred, folded in observation order; null for one instant only."""
    n = F.size(path).cast("double")
    first = F.get(path, F.lit(0))["event_us"]
    x = lambda p: (p["event_us"] - first) / F.lit(1e6)
    total = lambda f: F.aggregate(path, F.lit(0.0), lambda acc, p: acc + f(p))
    mx, my = total(x) / n, total(lambda p: p["value_num"]) / n
    # the means are bound once, as fields of a one-element array
    means = F.array(F.struct(mx.alias("mx"), my.alias("my")))
    sums = F.transform(means, lambda m: F.aggregate(path, F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx")), lambda acc, p: F.struct((acc["xy"] + (x(p) - m["mx"]) * (p["value_num"] - m["my"])).alias("xy"), (acc["xx"] + (x(p) - m["mx"]) * (x(p) - m["mx"])).alias("xx"))))
    s = F.get(sums, F.lit(0))
    return F.when(F.size(path) >= 2, F.when(s["xx"] > 0, s["xy"] / s["xx"]))


def mode(seen: Column) -> Column:
    """The most frequent value; ties by its newest event, then by its text. ``seen`` is sorted by value, then event: one walk
    along its runs of equal values."""
    kind = "struct<n:int,newest:bigint,text:string,value_num:double,value_cat:string>"
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("newest"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_cat")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        run = acc["run"]
        same = (run["n"] > 0) & x["value_num"].eqNullSafe(run["value_num"]) & x["value_cat"].eqNullSafe(run["value_cat"])
        now = F.struct(F.when(same, run["n"] + 1).otherwise(F.lit(1)).alias("n"), x["event_us"].alias("newest"), x["text"].alias("text"), x["value_num"].alias("value_num"), x["value_cat"].alias("value_cat")).cast(kind)
        return F.struct(now.alias("run"), F.when(now > acc["best"], now).otherwise(acc["best"]).alias("best"))

    return F.aggregate(seen, F.struct(none.alias("run"), none.alias("best")), step, lambda acc: acc["best"])


def calendar(n: NodePlan, t: Column) -> Column:
    """A field of the prediction time in the node's zone, as a number."""
    there = F.from_utc_timestamp(F.timestamp_micros(t), n.params["timezone"])
    # the wall clock as a timestamp without zone, whatever the session's
    us = F.unix_micros(there)
    day = F.date_from_unix_date(bucket_of(us, F.lit(US_DAY)).cast("int"))
    name = n.operator.name
    days = [F.lit(d) for d in n.params.get("days", [])]
    on = lambda d: (d.isin(*days) if days else F.lit(False)).cast("double")
    fields = {
        "hour_of_day": lambda: F.floor(F.pmod(us, F.lit(US_DAY)) / F.lit(US_DAY // 24)),
        "day_of_week": lambda: F.weekday(day),
        "day_of_month": lambda: F.dayofmonth(day),
        "day_of_year": lambda: F.dayofyear(day),
        "month_of_year": lambda: F.month(day),
        "is_weekend": lambda: (F.weekday(day) >= 5).cast("int"),
        "is_holiday": lambda: on(day),
        "day_before_holiday": lambda: on(F.date_add(day, 1)),
        "day_after_holiday": lambda: on(F.date_sub(day, 1)),
    }
    return fields[name]().cast("double")


def execute(
    plan: ExecutionPlan,
    log: DataFrame,
    requests: DataFrame,
    graphs: DataFrame | None = None,
    *,
    lineage: bool = False,
    all_nodes: bool = False,
    shard_us: int = 7 * US_DAY,
    deduplicated: bool = False,
) -> DataFrame:
    """Evaluate ``plan``. requests: request_ix (unique), entity_id, prediction_us. graphs: graph, entity_id, related_id.

    Gives request_ix, entity_id, prediction_us and per output its value (DOUBLE or STRING by its type); with ``lineage``
    also ``<output>__lineage`` (sorted record ids) and ``<output>__available_us``.
    """
    wide = _Engine(plan, log, requests, graphs, lineage, shard_us, deduplicated).run()
    cols = [F.col("request_ix"), F.col("entity_id"), F.col("t").alias("prediction_us")]
    for o in plan.needed if all_nodes else plan.program.outputs:
        c = F.col(o)
        cols.append((c["cat"] if plan.nodes[o].value_type == "category" else c["num"]).alias(o))
        if lineage:
            there = c["num"].isNotNull() | c["cat"].isNotNull()
            cols += [F.coalesce(F.when(there, c["lineage"]), F.array().cast("array<string>")).alias(f"{o}__lineage"), c["available_us"].alias(f"{o}__available_us")]
    return wide.select(*cols)
