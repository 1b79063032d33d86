"""Queries p1 to p6 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import US_HOUR, day_text, floordiv, local_day, table
from tidemark.operators import timestamps
from tidemark.operators.editions import editions, placed
from tidemark.operators.fill import NO_NUMBER, fill_runs, fill_similar, number_or_null, text_or_null
from tidemark.operators.known_at import as_known
from tidemark.operators.rolling import trailing_totals
from tidemark.operators.spikes import Field, implausible

OFF_TIE = 1.3e-7
TALLINN, SHANGHAI = "Europe/Tallinn", "Asia/Shanghai"
PRSA_FIELDS = timestamps.Fields("month", "day", "hour")


def train_times(df: DataFrame) -> DataFrame:
    """train with ``ts_us``; a twice-occurring hour is told apart within the unit and side."""
    return timestamps.normalise(df, "datetime", TALLINN, source="train", key="row_id", fold_by=["prediction_unit_id", "is_consumption"])


def price_times(df: DataFrame) -> DataFrame:
    return timestamps.normalise(df, "forecast_date", TALLINN, source="electricity_prices", key="row_id")


def prsa_times(df: DataFrame) -> DataFrame:
    usual = F.col("year").rlike(r"^\d{4}$") & F.col("month").isNotNull() & F.col("day").isNotNull() & F.col("hour").between(0, 23)
    return timestamps.normalise(df, "year", SHANGHAI, source="prsa_data", fields=PRSA_FIELDS, usual=usual)


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the three tables with its UTC instant and status."""
    parts = [
        ("train", train_times(table(spark, sf_dir, "train").select("row_id", "prediction_unit_id", "is_consumption", "datetime")), "row_id"),
        ("electricity_prices", price_times(table(spark, sf_dir, "electricity_prices").select("row_id", "forecast_date")), "row_id"),
        ("prsa_data", prsa_times(table(spark, sf_dir, "prsa_data").select("No", "year", "month", "day", "hour").distinct()), "No"),
    ]
    whole = [df.select(F.lit(tab).alias("tab"), F.col(key).cast("long").alias("rec_key"), F.col("ts_us").alias("utc_us"), F.col("ts_status").alias("status"), F.col("ts_usual").alias("usual")) for tab, df, key in parts]
    return whole[0].unionByName(whole[1]).unionByName(whole[2])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = p4_instants(spark, sf_dir).filter(F.col("utc_us").isNotNull() & (~F.col("usual") | F.col("status").isin("first", "second")))
    return df.select("tab", "rec_key", "utc_us")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted consumption rows of train: prediction_unit_id, day, target.

    One exchange, by unit and local day: both the choice among repeated hours and the daily sums keep to it.
    """
    rows = table(spark, sf_dir, "train").filter("is_consumption = 1 AND prediction_unit_id IS NOT NULL")
    rows = train_times(rows.select("row_id", "prediction_unit_id", "is_consumption", "datetime", "data_block_id", "target"))
    rows = rows.filter(F.col("ts_us").isNotNull()).withColumn("day", local_day(F.col("ts_us"), TALLINN)).repartition("prediction_unit_id", "day")
    return rows.groupBy("prediction_unit_id", "day", "ts_us").agg(F.max(F.struct("data_block_id", "row_id", "target"))["target"].alias("target"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_totals(_counted(spark, sf_dir), "prediction_unit_id", "day", "target", (7, 30)).withColumnRenamed("entity", "prediction_unit_id")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of target over the last 7 and 30 days of every unit and day, at six decimals (moved off the ties)."""
    df = _totals(spark, sf_dir)
    return df.select(*[(F.round(F.col(c) + OFF_TIE, 6) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _totals(spark, sf_dir).filter(F.col("day") >= F.col("first_day") + 29)
    df = df.filter((F.col("avg_7") < 0.5 * F.col("avg_30")) | (F.col("avg_7") > 2 * F.col("avg_30")))
    return df.select("prediction_unit_id", day_text(F.col("day")).alias("day"))


UNIT = ("county", "is_business", "product_type")
#: Day 0 of data_block_id is this local day (2023-10-09) as a day number.
BLOCK_DAY_0 = 19639


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each train row with the client record by date alone (``by_date``) and the one known at 00:00 of its local day (``known``)."""
    train = train_times(table(spark, sf_dir, "train").select("row_id", "prediction_unit_id", "is_consumption", "datetime", *UNIT))
    train = train.select("row_id", *UNIT, local_day(F.col("ts_us"), TALLINN).alias("day"))
    client = table(spark, sf_dir, "client")
    date = F.unix_date(F.col("date").try_cast("date"))
    client = client.select(*UNIT, date.alias("date_day"), "data_block_id", "installed_capacity", "eic_count").filter("date_day IS NOT NULL")
    client = client.groupBy(*UNIT, "date_day", "data_block_id").agg(F.max(F.struct("installed_capacity", "eic_count")).alias("c")).select(*UNIT, "date_day", "data_block_id", "c.*")
    holds = F.col("date_day") + 1
    known = F.when(F.col("data_block_id").isNotNull(), F.greatest(holds, F.col("data_block_id") + BLOCK_DAY_0))
    return as_known(train, client, {c: c for c in UNIT}, "day", {"by_date": holds, "known": known}, ["date_day", "data_block_id"], ["installed_capacity", "eic_count"])


def p3_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each train row with the record that was known (its day, block and capacity), and the one by date alone."""
    by_date, known = F.col("by_date"), F.col("known")
    return _capacity(spark, sf_dir).select("row_id", by_date["date_day"].alias("by_date_day"), by_date["data_block_id"].alias("by_date_block"), known["date_day"].alias("known_day"), known["data_block_id"].alias("known_block"), known["installed_capacity"].alias("known_capacity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda c: F.col(f"by_date.{c}").eqNullSafe(F.col(f"known.{c}"))
    df = _capacity(spark, sf_dir).filter(~(same("date_day") & same("data_block_id")))
    return df.select("row_id", F.coalesce(day_text(F.col("known.date_day")), F.lit("")).alias("client_date"), F.coalesce(F.col("known.data_block_id"), F.lit(-1)).cast("int").alias("client_block"))


STREAM = ("entity_id", "source_id", "feature_name")


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "record_log").filter("kind = 'measurement'")
    number = F.when(~F.isnan("value_num"), F.col("value_num"))
    return log.select("record_id", *STREAM, F.unix_micros("event_time").alias("event_us"), F.unix_micros("available_time").alias("available_us"), number.alias("value"), (number.isNotNull() | F.col("value_cat").isNotNull()).alias("present"))


def p5_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily aggregates of every measurement stream: first edition, corrections until the close, what was diverted."""
    return editions(_measurements(spark, sf_dir), STREAM)


def p5_diverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every diverted record, where closes decide: sources are trusted to be 24 hours late at most, and idle after six."""
    out = placed(_measurements(spark, sf_dir), STREAM, lateness_us=24 * US_HOUR, idle_us=6 * US_HOUR).filter(F.col("place").isin("closed", "cut_off"))
    return out.select("record_id", *STREAM, day_text(F.col("period")).alias("day"), "event_us", "available_us", "closed_us", "place")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_editions(spark, sf_dir).filter("corrections > 0").select(*STREAM, day_text(F.col("period")).alias("day"))


PRSA_NUMBERS = ("PM2.5", "PM10", "SO2", "NO2", "CO", "O3", "TEMP", "PRES", "DEWP", "RAIN", "WSPM")
#: Physical limits: µg/m³, °C, hPa.
PRSA_CHECKED = (Field("PM2.5", 0.0, 5000.0, ratio=True), Field("TEMP", -60.0, 60.0), Field("PRES", 500.0, 1100.0))


def _safe(name: str) -> str:
    return name.replace(".", "_")


def _readings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """prsa_data with ``No``, the station it says (``said``) and its file's (``station``); columns without dots."""
    df = table(spark, sf_dir, "prsa_data")
    df = df.select(F.col("No").alias("no"), text_or_null(F.col("station")).alias("said"), *[F.col(f"`{c}`").alias(_safe(c)) for c in columns])
    return fill_runs(df, "no", "said", "station")


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible reading of PM2.5, TEMP and PRES with the reason."""
    names = [f.name for f in PRSA_CHECKED]
    df = table(spark, sf_dir, "prsa_data").select(F.col("No").alias("no"), "year", "month", "day", "hour", text_or_null(F.col("station")).alias("said"), *[F.col(f"`{c}`").alias(_safe(c)) for c in names])
    df = prsa_times(df).select("no", "said", *[_safe(c) for c in names], floordiv(F.col("ts_us"), US_HOUR).alias("utc_hour"))
    df = fill_runs(df, "no", "said", "station")
    checked = [Field(_safe(f.name), f.low, f.high, f.ratio, f.least_range) for f in PRSA_CHECKED]
    out = implausible(df, "no", "station", "utc_hour", checked, NO_NUMBER)
    return out.withColumn("field", F.regexp_replace("field", "_", "."))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_flags(spark, sf_dir).select("no", "field").distinct()


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing PM2.5 and station: no, field, station, the value filled and the method that filled it.

    The group of a reading is the file that encloses it; a missing station is the mode of its group (which is exact), and
    only where no file encloses it that of its cluster.
    """
    df = _readings(spark, sf_dir, *PRSA_NUMBERS, "wd", "hour")
    numbers = [_safe(c) for c in PRSA_NUMBERS]
    df = df.withColumns({c: number_or_null(F.col(c)) for c in numbers} | {"wd": text_or_null(F.col("wd")), "part": F.call_function("div", F.col("hour"), F.lit(6)).cast("string")})
    out = fill_similar(df, "no", numbers, ["said", "wd", "part"], ["PM2_5"], ["said"], "station")
    missing = F.col("field") == "said"
    return out.select(
        "no",
        F.when(missing, "station").otherwise("PM2.5").alias("field"),
        F.when(missing, F.col("filled_cat")).otherwise(F.coalesce("station", F.lit(""))).alias("station"),
        "filled_num",
        "filled_cat",
        "cluster",
        "method",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_filled(spark, sf_dir).select("no", "field", "station").distinct()
