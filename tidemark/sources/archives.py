"""Adapters of the public archives: block-delivered CSV files, per-station CSV files, whitespace bulletins, a synthetic table,
and small YAML logs. Each gives a ``Bundle``; parsing is done by DataFrame plans."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.evaluation import us_of
from tidemark.records import LOG_SCHEMA, canonical
from tidemark.sources.bundle import Bundle, SourceError, bounded, first_disseminated, provenance, recorded, simulated

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _local(text: Column, zone: str) -> Column:
    """µs of a local time text (a date counts as its midnight); an unreadable text fails the query."""
    us = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(_wall(text)), zone))
    return F.when(text.isNotNull() & us.isNull(), F.raise_error(F.concat(F.lit("unreadable time "), text)).cast("long")).otherwise(us)


def _wall(text: Column) -> Column:
    full = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    ts = full.try_cast("timestamp_ntz")
    return F.unix_date(ts.cast("date")).cast("long") * DAY + (F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60 + F.second(ts).cast("long")) * 1_000_000


def _stamp(us: Column) -> Column:
    """µs as ``YYYYMMDDTHHMM`` in UTC, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(us / DAY).cast("int"))
    minute = F.floor(F.pmod(us, F.lit(DAY)) / 60_000_000).cast("int")
    part = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.concat(F.regexp_replace(day.cast("string"), "-", ""), F.lit("T"), part(F.floor(minute / 60)), part(minute % 60))


def _unpivot(df: DataFrame, keep: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Wide columns to rows (feature, raw): one pass, no shuffle."""
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"`{c}`").cast("string").alias("raw")) for c, name in columns.items()])
    return df.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.feature", "x.raw")


def _pick(key: Column, values: Mapping[str, Any], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast(kind)).otherwise(out)
    return out


# --- per-station air quality files -------------------------------------------------------------------------------
#: Column -> (feature, unit, group). Delays are declared per group.
AIR_COLUMNS = {
    "PM2.5": ("pm2_5", "microgram / meter ** 3", "pollutant"),
    "PM10": ("pm10", "microgram / meter ** 3", "pollutant"),
    "SO2": ("so2", "microgram / meter ** 3", "pollutant"),
    "NO2": ("no2", "microgram / meter ** 3", "pollutant"),
    "CO": ("co", "microgram / meter ** 3", "pollutant"),
    "O3": ("o3", "microgram / meter ** 3", "pollutant"),
    "TEMP": ("temp", "degC", "meteorology"),
    "PRES": ("pres", "hectopascal", "meteorology"),
    "DEWP": ("dewp", "degC", "meteorology"),
    "RAIN": ("rain", "mm", "meteorology"),
    "WSPM": ("wspm", "meter / second", "meteorology"),
    "wd": ("wd", None, "meteorology"),
}
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Simulated arrival delays in minutes (pollutant, meteorology, label).
ARRIVALS = {"prompt": (0, 0, 60), "typical": (60, 30, 120), "staggered": (180, 15, 360)}


def air_quality(spark: SparkSession, root: str, scenario: str = "typical", stations: Sequence[str] | None = None, features: Sequence[str] | None = None, targets: bool = True) -> Bundle:
    """PRSA_Data_<Station>_<from>-<to>.csv files: hourly local time of Asia/Shanghai, NA is missing, arrivals are simulated."""
    if scenario not in ARRIVALS:
        raise SourceError(f"scenario must be one of {sorted(ARRIVALS)}")
    files = sorted(p for p in Path(root).glob("PRSA_Data_*.csv") if stations is None or p.name.split("_")[2] in set(stations))
    if not files:
        raise SourceError(f"no station files under {root} match {stations}")
    header = ", ".join(f"`{c}` string" for c in ("No", "year", "month", "day", "hour", *list(AIR_COLUMNS)[:10], "wd", "WSPM", "station"))
    raw = spark.read.csv([str(f) for f in files], header=True, schema=header, enforceSchema=False)
    pad = lambda c: F.lpad(F.col(c), 2, "0")
    at = _local(F.concat(F.lpad("year", 4, "0"), F.lit("-"), pad("month"), F.lit("-"), pad("day"), F.lit(" "), pad("hour"), F.lit(":00:00")), "Asia/Shanghai")
    pollutant, weather, label = (m * 60_000_000 for m in ARRIVALS[scenario])
    wanted = {c: f for c, (f, _, _) in AIR_COLUMNS.items() if features is None or f in features}
    rows = _unpivot(raw.withColumn("event_us", at), ["station", "event_us"], wanted)
    text = F.when(~F.upper(F.trim("raw")).isin("", "NA", "NAN", "NULL"), F.trim("raw"))
    number = F.when(F.col("feature") != "wd", text.cast("double"))
    delay = F.when(_pick(F.col("feature"), {f: g for f, _, g in AIR_COLUMNS.values()}, "string") == "pollutant", F.lit(pollutant)).otherwise(F.lit(weather))
    log = rows.select(
        F.concat(F.lit("beijing:"), "station", F.lit(":"), "feature", F.lit(":"), _stamp(F.col("event_us"))).alias("record_id"),
        F.lit("measurement").alias("kind"),
        F.col("station").alias("entity_id"),
        F.lit("beijing_air").alias("source_id"),
        F.col("feature").alias("feature_name"),
        number.alias("value_num"),
        F.when(F.col("feature") == "wd", text).alias("value_cat"),
        _pick(F.col("feature"), {f: u for f, u, _ in AIR_COLUMNS.values() if u}, "string").alias("unit"),
        "event_us",
        (F.col("event_us") + delay).alias("available_us"),
        provenance("simulated", "declared delay of the measurement's group", scenario).alias("provenance"),
    )
    records = canonical(log)
    if targets:
        pm = F.when(~F.upper(F.trim(F.col("`PM2.5`"))).isin("", "NA", "NAN", "NULL"), F.col("`PM2.5`").cast("double"))
        t = raw.withColumn("event_us", at)
        records = records.unionByName(canonical(t.select(F.concat(F.lit("beijing:target:"), "station", F.lit(":"), _stamp(F.col("event_us"))).alias("record_id"), F.lit("label").alias("kind"), F.col("station").alias("entity_id"), F.lit("beijing_target").alias("source_id"), F.lit("pm2_5").alias("feature_name"), pm.alias("value_num"), F.lit("microgram / meter ** 3").alias("unit"), "event_us", simulated(F.col("event_us"), label).alias("available_us"), provenance("simulated", "declared delay of labels", scenario).alias("provenance"))))
    declared = [{"source_id": "beijing_air", "feature_name": f, "kind": "measurement", "value_type": "category" if f == "wd" else "number", "unit": u, "max_input_rate_per_hour": 2.0, **({"categories": COMPASS} if f == "wd" else {})} for f, u, _ in AIR_COLUMNS.values() if features is None or f in features]
    declared.append({"source_id": "beijing_target", "feature_name": "pm2_5", "kind": "label", "value_type": "number", "unit": "microgram / meter ** 3", "max_input_rate_per_hour": 2.0})
    return Bundle("beijing_multi_site_air_quality", "uci-501", records, tuple(declared), frozenset({"beijing_target"}), tuple(map(str, files)))


# --- block-delivered energy files --------------------------------------------------------------------------------
@dataclass(frozen=True)
class BlockFile:
    """One delivered file: how its columns become records."""

    name: str
    source: str
    kind: str
    event: str
    features: Mapping[str, str | None]
    valid: str | None = None
    owner: str = "market"  # unit, market, or point: each grid point its own entity
    split: str | None = None  # column whose 1 and 0 make two features of one
    lag_blocks: int = 0
    horizon: str | None = None


#: The six files of the data set.
BLOCK_FILES = (
    BlockFile("train.csv", "enefit_target", "label", "datetime", {"target": "kilowatt_hour"}, owner="unit", split="is_consumption", lag_blocks=2),
    BlockFile("client.csv", "enefit_client", "static", "date", {"eic_count": None, "installed_capacity": "kilowatt"}, owner="unit"),
    BlockFile("electricity_prices.csv", "enefit_electricity", "forecast", "origin_date", {"euros_per_mwh": "euro / megawatt_hour"}, valid="forecast_date", horizon="48h"),
    BlockFile("gas_prices.csv", "enefit_gas", "forecast", "origin_date", {"lowest_price_per_mwh": "euro / megawatt_hour", "highest_price_per_mwh": "euro / megawatt_hour"}, valid="forecast_date", horizon="48h"),
    BlockFile("historical_weather.csv", "enefit_weather_actual", "measurement", "datetime", {"temperature": "degC", "shortwave_radiation": "watt_hour / meter ** 2"}, owner="point"),
    BlockFile("forecast_weather.csv", "enefit_weather_forecast", "forecast", "origin_datetime", {"temperature": "degC", "surface_solar_radiation_downwards": "watt_hour / meter ** 2"}, valid="forecast_datetime", owner="point", horizon="72h"),
)
STATION_GRAPH = "weather_stations"


def _units(spark: SparkSession, root: str) -> DataFrame:
    t = spark.read.csv(f"{root}/train.csv", header=True)
    return t.select("county", "is_business", "product_type", F.col("prediction_unit_id").alias("unit_id")).distinct()


def energy_blocks(spark: SparkSession, root: str, first_block: int, first_release: str, interval_us: int = DAY, units: Sequence[str] | None = None, stations: Sequence[str] | None = None, broadcast: bool = True, files: Sequence[str] | None = None) -> Bundle:
    """Files delivered in daily blocks: a row is available when its block is released (targets two blocks later).

    ``broadcast``: market-wide prices are repeated for every unit (the units are counted: at most 50,000).
    ``stations``: only these grid points are read, pushed into the scan.
    """
    zone, release0 = "Europe/Tallinn", us_of(first_release)
    have = [f for f in BLOCK_FILES if (Path(root) / f.name).exists() and (files is None or f.name in files)]
    if not have:
        raise SourceError(f"no files of the data set under {root}")
    by_key = _units(spark, root)
    if units is not None:
        by_key = by_key.filter(F.col("unit_id").isin(*units))
    names: list[str] = []
    if broadcast and any(f.owner == "market" for f in have):
        names = sorted(r["unit_id"] for r in by_key.select("unit_id").distinct().limit(50_001).collect())
        if len(names) > 50_000:
            raise SourceError("too many units to repeat market-wide streams for: pass units or broadcast=False")
    parts = []
    for f in have:
        raw = spark.read.csv(f"{root}/{f.name}", header=True)
        if f.owner == "point":
            raw = raw.withColumn("entity_id", F.concat(F.lit("station:"), "latitude", F.lit(":"), "longitude"))
            if stations is not None:
                raw = raw.filter(F.col("entity_id").isin(*stations))
        elif f.owner == "unit":
            raw = raw.drop("prediction_unit_id").join(by_key, ["county", "is_business", "product_type"]).withColumnRenamed("unit_id", "entity_id")
        elif broadcast:
            raw = raw.withColumn("entity_id", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
        else:
            raw = raw.withColumn("entity_id", F.lit("market"))
        block = F.col("data_block_id").cast("double").cast("int")
        shown = block + f.lag_blocks
        late = F.when(shown >= first_block, F.lit(release0) + (shown - first_block).cast("long") * interval_us).otherwise(F.raise_error(F.lit("a block before the declared first one")).cast("long"))
        raw = raw.withColumns({"event_us": _local(F.col(f.event), zone), "valid_us": _local(F.col(f.valid), zone) if f.valid else F.lit(None).cast("long"), "available_us": late, "_block": block})
        suffix = F.when(F.col(f.split) == "1", F.lit("_consumption")).when(F.col(f.split) == "0", F.lit("_production")) if f.split else F.lit("")
        rows = _unpivot(raw.withColumn("_suffix", suffix), ["entity_id", "event_us", "valid_us", "available_us", "_block", "_suffix"], {c: c for c in f.features})
        name = F.concat("feature", "_suffix")
        forecast = f.kind == "forecast"
        measured = F.col("available_us") if f.kind in ("static", "forecast") else recorded(F.col("available_us"), F.col("event_us"))
        parts.append(
            canonical(
                rows.select(
                    F.concat(F.lit(f"enefit:{f.source}:"), "entity_id", F.lit(":"), name, F.lit(":"), _stamp(F.col("event_us")), *([F.lit(":v"), _stamp(F.col("valid_us"))] if forecast else []), F.lit(":b"), F.col("_block").cast("string")).alias("record_id"),
                    F.lit(f.kind).alias("kind"),
                    "entity_id",
                    F.lit(f.source).alias("source_id"),
                    name.alias("feature_name"),
                    F.when(F.trim("raw") != "", F.col("raw").cast("double")).alias("value_num"),
                    _pick(F.col("feature"), {c: u for c, u in f.features.items() if u}, "string").alias("unit"),
                    "event_us",
                    measured.alias("available_us"),
                    "valid_us",
                    (F.col("event_us") if forecast else F.lit(None).cast("long")).alias("issued_us"),
                    (F.concat(F.lit("b"), F.col("_block").cast("string")) if forecast else F.lit(None).cast("string")).alias("revision_id"),
                    provenance("recorded", "release of the block, by the declared schedule", F.concat(F.lit(f"{f.name} data_block_id="), F.col("_block").cast("string")), f"first_block={first_block} first_release={first_release}").alias("provenance"),
                )
            )
        )
    records, superseded = first_disseminated(reduce(DataFrame.unionByName, parts))
    declared = tuple({"source_id": f.source, "feature_name": c + s, "kind": f.kind, "value_type": "number", "unit": u, "max_input_rate_per_hour": 4.0, **({"max_forecast_horizon": f.horizon} if f.horizon else {})} for f in have for c, u in f.features.items() for s in (("_consumption", "_production") if f.split else ("",)))
    return Bundle("enefit_prosumers", "kaggle-2023", records, declared, frozenset({"enefit_target"}), tuple(f"{root}/{f.name}" for f in have), superseded, station_graph(spark, root, by_key))


def station_graph(spark: SparkSession, root: str, units: DataFrame | None = None) -> DataFrame | None:
    """Edges from each unit to the grid points of its county; coordinates are matched after rounding to a tenth of a degree."""
    if not (Path(root) / "weather_station_to_county_mapping.csv").exists():
        return None
    tenth = lambda c: F.round(F.col(c).cast("double"), 1)
    points = spark.read.csv(f"{root}/historical_weather.csv", header=True).select(tenth("latitude").alias("la"), tenth("longitude").alias("lo"), F.concat(F.lit("station:"), "latitude", F.lit(":"), "longitude").alias("related_id")).distinct()
    of = spark.read.csv(f"{root}/weather_station_to_county_mapping.csv", header=True).filter(F.trim("county") != "").select("county", tenth("latitude").alias("la"), tenth("longitude").alias("lo"))
    units = units if units is not None else _units(spark, root)
    return units.join(of, "county").join(points, ["la", "lo"]).select(F.lit(STATION_GRAPH).alias("graph"), F.col("unit_id").alias("entity_id"), "related_id").distinct()


# --- whitespace bulletins of a climate network --------------------------------------------------------------------
#: Feature -> (column from 1, unit, flag column); -9999 is missing; 38 columns; windows of one hour.
CLIMATE_FIELDS = {"t_calc": (9, "degC", None), "t_hr_avg": (10, "degC", None), "p_calc": (13, "mm", None), "solarad": (14, "watt / meter ** 2", 15), "sur_temp": (21, "degC", 22), "rh_hr_avg": (27, "percent", 28)}
CLIMATE_WIDTH, CLIMATE_MISSING = 38, -9999.0
_UPDATE = r"CRN60H0203-(\d{12})\.txt$"


def _bulletins(spark: SparkSession, files: Sequence[str], features: Sequence[str] | None, stations: Sequence[str] | None) -> DataFrame:
    """Rows of the files: station, event_us, feature, value, quality, file. Envelope lines carry no data; a row of another
    width fails the query."""
    lines = spark.read.text([str(f) for f in files]).select("value", F.col("_metadata.file_path").alias("file"))
    text = F.trim(F.regexp_replace("value", "\u0003", ""))
    envelope = text.rlike(r"^\*{4}\d+\*{4}$") | text.rlike(r"^\S+ [A-Z]{4} \d{6}$") | text.rlike(r"^CRNH02$")
    rows = lines.filter((text != "") & ~envelope).withColumn("f", F.split(text, r"\s+"))
    width = F.when(F.size("f") == CLIMATE_WIDTH, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a row of another width in "), "file")).cast("array<string>"))
    rows = rows.withColumn("f", width).withColumn("station", F.col("f")[0])
    if stations is not None:
        rows = rows.filter(F.col("station").isin(*stations))
    d, t = F.col("f")[1], F.col("f")[2]
    at = _local(F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":00")), "UTC")
    keep = {k: v for k, v in CLIMATE_FIELDS.items() if features is None or k in features}
    flag = lambda c: F.when(F.col("f")[c - 1] != "0", F.col("f")[c - 1]) if c else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), F.col("f")[c - 1].cast("double").alias("raw"), flag(q).alias("quality")) for k, (c, _, q) in keep.items()])
    out = rows.select("station", at.alias("event_us"), "file", F.explode(cells).alias("x")).select("station", "event_us", "file", "x.*")
    return out.withColumn("value", F.when(F.col("raw") != CLIMATE_MISSING, F.col("raw"))).drop("raw")


def climate_updates(spark: SparkSession, root: str, features: Sequence[str] | None = None, stations: Sequence[str] | None = None, as_of: str | None = None) -> Bundle:
    """Hourly update files: available at the close of the window in the file's name; the first dissemination counts and
    later ones with another value are listed."""
    files = sorted(str(p) for p in Path(root).rglob("CRN*.txt"))
    wrong = [f for f in files if not re.search(_UPDATE, f)]
    if not files or wrong:
        raise SourceError(f"not hourly update files: {wrong[:3]}" if wrong else f"no update files under {root}")
    if as_of is not None:
        cut = datetime.fromisoformat(as_of.replace("Z", "+00:00")).strftime("%Y%m%d%H%M")
        files = [f for f in files if re.search(_UPDATE, f)[1] <= cut]
    if not files:
        raise SourceError("no update file closes by then")
    rows = _bulletins(spark, files, features, stations)
    stamp = F.regexp_extract("file", _UPDATE, 1)
    close = _local(F.concat(F.substring(stamp, 1, 4), F.lit("-"), F.substring(stamp, 5, 2), F.lit("-"), F.substring(stamp, 7, 2), F.lit(" "), F.substring(stamp, 9, 2), F.lit(":"), F.substring(stamp, 11, 2), F.lit(":00")), "UTC")
    log = rows.select(F.concat(F.lit("uscrn:"), "station", F.lit(":"), "feature", F.lit(":"), _stamp(F.col("event_us"))).alias("record_id"), F.lit("measurement").alias("kind"), F.col("station").alias("entity_id"), F.lit("uscrn_update").alias("source_id"), F.col("feature").alias("feature_name"), F.col("value").alias("value_num"), _pick(F.col("feature"), {k: u for k, (_, u, _) in CLIMATE_FIELDS.items()}, "string").alias("unit"), "event_us", bounded(F.col("event_us"), close).alias("available_us"), "quality", provenance("bounded", "close of the dissemination window", F.concat(F.lit("CRN60H0203-"), stamp)).alias("provenance"))
    records, superseded = first_disseminated(log)
    declared = tuple({"source_id": "uscrn_update", "feature_name": k, "kind": "measurement", "value_type": "number", "unit": u, "max_input_rate_per_hour": 2.0} for k, (_, u, _) in CLIMATE_FIELDS.items() if features is None or k in features)
    return Bundle("uscrn_hourly02", "updates", records, declared, frozenset(), tuple(files), superseded)


def climate_final(spark: SparkSession, path: str, feature: str = "t_calc", delay_us: int = 30 * DAY) -> Bundle:
    """The quality-controlled product: labels only, revealed a declared delay after the observation."""
    if feature not in CLIMATE_FIELDS:
        raise SourceError(f"unknown feature {feature!r}")
    rows = _bulletins(spark, [path], [feature], None)
    unit = CLIMATE_FIELDS[feature][1]
    log = rows.select(F.concat(F.lit("uscrn:final:"), "station", F.lit(f":{feature}:"), _stamp(F.col("event_us"))).alias("record_id"), F.lit("label").alias("kind"), F.col("station").alias("entity_id"), F.lit("uscrn_final").alias("source_id"), F.lit(feature).alias("feature_name"), F.col("value").alias("value_num"), F.lit(unit).alias("unit"), "event_us", simulated(F.col("event_us"), delay_us).alias("available_us"), "quality", provenance("simulated", "declared publication delay", "file").alias("provenance"))
    return Bundle("uscrn_hourly02", "final", canonical(log), ({"source_id": "uscrn_final", "feature_name": feature, "kind": "label", "value_type": "number", "unit": unit, "max_input_rate_per_hour": 2.0},), frozenset({"uscrn_final"}), (str(path),))


# --- small YAML logs and the synthetic table ----------------------------------------------------------------------
def yaml_log(spark: SparkSession, path: str, entity: str = "e1") -> tuple[DataFrame, DataFrame]:
    """(records, requests) of a hand-written YAML file; times must be quoted and name a zone."""
    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    us = lambda r, k: None if r.get(k) is None else us_of(_quoted(r[k]))
    rows = []
    for i, r in enumerate(doc.get("records", [])):
        v = r.get("value")
        event = us(r, "event_time")
        rows.append((str(r.get("id", f"r{i:03d}")), r.get("kind", "measurement"), r.get("entity", entity), r["source"], r["feature"], float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None, r.get("unit"), event, us(r, "available_time") if r.get("available_time") else event, us(r, "valid_time"), us(r, "issued_time"), r.get("revision"), r.get("quality"), {}))
    asked = [(i, r.get("entity", entity), us_of(_quoted(r["at"]))) for i, r in enumerate(doc.get("requests", []))]
    return spark.createDataFrame(rows, LOG_SCHEMA), spark.createDataFrame(asked, "request_ix bigint, entity_id string, prediction_us bigint")


def _quoted(text: Any) -> str:
    if not isinstance(text, str):
        raise SourceError(f"time {text!r} must be quoted: YAML would strip its zone")
    return text


def synthetic_table(series: int, steps: int, start: str, step_seconds: int, seed: int, namespace: str) -> list[tuple[str, int, str, str]]:
    """Rows (series_id, step_index, timestamp, value): a slope of 0.25 a step, 10 a series, plus noise in [0, 1) from a generator
    per series, seeded from sha256 of ``namespace:seed:purpose``."""
    out = []
    begin = datetime.fromisoformat(start.replace("Z", "+00:00"))
    for s in range(series):
        digest = hashlib.sha256(f"{namespace}:{seed}:synthetic/series/{s}".encode()).digest()
        rng = random.Random(int.from_bytes(digest[:8], "big"))
        out += [(f"s{s:03d}", k, (begin + timedelta(seconds=step_seconds * k)).isoformat(), f"{10.0 * s + 0.25 * k + rng.random():.6f}") for k in range(steps)]
    return out


# --- registry -----------------------------------------------------------------------------------------------------
#: name -> (reader, required options, optional options)
REGISTRY = {
    "beijing": (air_quality, ("root",), ("scenario", "stations", "features", "targets")),
    "enefit": (energy_blocks, ("root", "first_block", "first_release"), ("interval_us", "units", "stations", "broadcast", "files")),
    "uscrn-updates": (climate_updates, ("root",), ("features", "stations", "as_of")),
    "uscrn-final": (climate_final, ("path",), ("feature", "delay_us")),
}
_LISTS = {"stations", "features", "units", "files"}


def open_dataset(spark: SparkSession, name: str, options: Sequence[str]) -> Bundle:
    """A bundle by name and ``key=value`` options; unknown and missing options are refused."""
    if name not in REGISTRY:
        raise SourceError(f"unknown dataset {name!r}; known: {sorted(REGISTRY)}")
    reader, required, optional = REGISTRY[name]
    given: dict[str, Any] = {}
    for o in options:
        k, eq, v = o.partition("=")
        if not eq or k not in (*required, *optional):
            raise SourceError(f"option {o!r} isn't one of {[*required, *optional]}")
        given[k] = v.split(",") if k in _LISTS else int(v) if k in ("first_block", "interval_us", "delay_us") else v.lower() == "true" if k in ("targets", "broadcast") else v
    missing = [k for k in required if k not in given]
    if missing:
        raise SourceError(f"{name} needs {missing}")
    return reader(spark, **given)
