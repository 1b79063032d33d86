"""What a source adapter gives: a record log with its declarations, checks and a card."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.records import available_by, canonical, duplicates, join_cardinality, lag_summary, late_records


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Bundle:
    dataset: str
    version: str
    records: DataFrame
    sources: tuple[dict[str, Any], ...]
    label_sources: frozenset[str] = frozenset()
    files: tuple[str, ...] = ()
    superseded: DataFrame | None = None  # record_id of deliveries that differ from the first
    graphs: DataFrame | None = None  # graph, entity_id, related_id
    notes: tuple[str, ...] = field(default=())

    def available_by(self, cutoff_us: int) -> DataFrame:
        return available_by(self.records, cutoff_us)

    def late(self, earlier_us: int, later_us: int) -> DataFrame:
        return late_records(self.available_by(earlier_us), self.available_by(later_us))

    def checksums(self) -> dict[str, str]:
        """sha256 per raw file (read by the driver: local files only)."""
        out = {}
        for f in self.files:
            h = hashlib.sha256()
            with open(f, "rb") as stream:
                for block in iter(lambda: stream.read(1 << 20), b""):
                    h.update(block)
            out[Path(f).name] = h.hexdigest()
        return out


def merge(bundles: Sequence[Bundle], dataset: str) -> Bundle:
    """One bundle of several; entity graphs are kept (equal names must not be defined twice)."""
    if not bundles:
        raise SourceError("nothing to merge")
    first = bundles[0]
    records, graphs, superseded = first.records, first.graphs, first.superseded
    for b in bundles[1:]:
        records = records.unionByName(b.records)
        graphs = b.graphs if graphs is None else graphs if b.graphs is None else graphs.unionByName(b.graphs)
        superseded = b.superseded if superseded is None else superseded if b.superseded is None else superseded.unionByName(b.superseded)
    return replace(
        first,
        dataset=dataset,
        version="+".join(f"{b.dataset}@{b.version}" for b in bundles),
        records=records,
        graphs=graphs,
        superseded=superseded,
        sources=tuple({(s["source_id"], s["feature_name"]): s for b in bundles for s in b.sources}.values()),
        label_sources=frozenset().union(*[b.label_sources for b in bundles]),
        files=tuple(dict.fromkeys(f for b in bundles for f in b.files)),
        notes=tuple(n for b in bundles for n in b.notes),
    )


def first_disseminated(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with each record id as first delivered, record ids whose later deliveries have another value)."""
    value = F.struct("value_num", "value_cat")
    first = F.min(F.struct("available_us", *[c for c in canonical(deliveries).columns if c not in ("record_id", "available_us", "provenance")]))
    entries = F.min(F.struct("available_us", F.array_sort(F.map_entries("provenance")).alias("p")))["p"]
    one = canonical(deliveries).groupBy("record_id").agg(first.alias("d"), entries.alias("p"), F.count_distinct(F.xxhash64(value)).alias("n"))
    log = one.select("record_id", "d.*", F.map_from_entries("p").alias("provenance"))
    return canonical(log), one.filter("n > 1").select("record_id")


def recorded(available: Column, event: Column) -> Column:
    """Availability that the data state; absent or before the event fails the query."""
    return F.when(available >= event, available).otherwise(F.raise_error(F.lit("recorded availability is missing or before the event")).cast("long"))


def simulated(event: Column, delay_us: int) -> Column:
    if delay_us < 0:
        raise SourceError("a simulated delay can't be negative")
    return event + F.lit(delay_us)


def bounded(event: Column, close: Column) -> Column:
    """The close of the window that a delivery fell into: an upper bound of its availability."""
    return F.when(close >= event, close).otherwise(F.raise_error(F.lit("the delivery window closes before the event")).cast("long"))


def inferred(*_: Any) -> Column:
    raise NotImplementedError("inferred availability isn't offered: it would be a guess")


def provenance(model: str, rule: Column | str, evidence: Column | str, parameters: str = "") -> Column:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.create_map(F.lit("model"), F.lit(model), F.lit("rule"), c(rule), F.lit("evidence"), c(evidence), F.lit("parameters"), F.lit(parameters))


def validation_report(log: DataFrame) -> dict[str, list[dict[str, Any]]]:
    """Summaries of a log, one row per stream (streams are declared, so their number is small)."""
    return {
        "streams": [r.asDict() for r in lag_summary(log).orderBy("source_id", "feature_name", "kind").collect()],
        "cardinality": [r.asDict() for r in join_cardinality(log).orderBy("source_id", "feature_name").collect()],
        "duplicates": [r.asDict() for r in duplicates(log).groupBy("conflict").count().collect()],
        "availability": [r.asDict() for r in log.groupBy(F.col("provenance")["model"].alias("model"), F.col("provenance")["rule"].alias("rule")).count().orderBy("model", "rule").collect()],
    }


def card(bundle: Bundle) -> str:
    """A dataset card as Markdown."""
    report = validation_report(bundle.records)
    lines = [f"# {bundle.dataset} ({bundle.version})", "", "| kind | source | feature | rows | missing | entities | max lag s |", "|-|-|-|-|-|-|-|"]
    lines += [f"| {r['kind']} | {r['source_id']} | {r['feature_name']} | {r['n_rows']} | {r['n_missing']} | {r['n_entities']} | {(r['max_lag_us'] or 0) / 1e6:g} |" for r in report["streams"]]
    lines += ["", "## Availability", ""] + [f"* {r['model']}: {r['rule']} ({r['count']})" for r in report["availability"]]
    lines += ["", "## Files", ""] + [f"* `{n}` {h}" for n, h in sorted(bundle.checksums().items())]
    return "\n".join([*lines, "", *bundle.notes, ""])
