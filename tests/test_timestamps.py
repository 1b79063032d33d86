from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import timestamps as T

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*a, tz="UTC", fold=0):
    return round((datetime(*a, tzinfo=ZoneInfo(tz), fold=fold) - EPOCH) / timedelta(microseconds=1))


CASES = {
    "2023-10-10 05:00:00": us(2023, 10, 10, 5, tz="Europe/Tallinn"),
    "2023-10-10T05:00:00": us(2023, 10, 10, 5, tz="Europe/Tallinn"),
    "2023/10/10 05:00:00": us(2023, 10, 10, 5, tz="Europe/Tallinn"),
    "2023-10-10 05:00:00,250": us(2023, 10, 10, 5, tz="Europe/Tallinn") + 250_000,
    "10.11.2023 07:00": us(2023, 11, 10, 7, tz="Europe/Tallinn"),
    "20231010T010000Z": us(2023, 10, 10, 1),
    "2023-10-29 22:00:00 EET": us(2023, 10, 29, 20),
    "2023-10-10 00:00:00 EEST": us(2023, 10, 9, 21),
    "2023-10-11t20:00:00.000z": us(2023, 10, 11, 20),
    "Thu, 12 Oct 2023 00:00:00 +0300": us(2023, 10, 11, 21),
    "1696910400": us(2023, 10, 10, 4),
    "1696928400000": us(2023, 10, 10, 9),
    "1696892400000000": us(2023, 10, 9, 23),
    "2023-10-10 08:00 Europe/Tallinn": us(2023, 10, 10, 5),
    "2023-10-10T11:00:00.000000+03": us(2023, 10, 10, 8),
    "2023-10-10 11:30:00+05:30": us(2023, 10, 10, 6),
    "2023-10-10 01:30:00-03:30": us(2023, 10, 10, 5),
    "2023-10-13 22:45:00+1245": us(2023, 10, 13, 10),
    "Oct 10, 2023 3:00 PM": us(2023, 10, 10, 12),
    "Oct 9, 2023 12:00 AM": us(2023, 10, 8, 21),
    "1 Nov 2023 02:00 UTC": us(2023, 11, 1, 2),
    "2023-10-10 24:00:00": us(2023, 10, 11, 0, tz="Europe/Tallinn"),
}


def normalised(spark, rows, **more):
    df = spark.createDataFrame(rows, "k bigint, g string, t string")
    return {r["k"]: r for r in T.normalise(df, "t", "Europe/Tallinn", source="s", key="k", fold_by=["g"], **more).collect()}


def test_every_form(spark):
    texts = list(CASES)
    got = normalised(spark, [(i, "g", t) for i, t in enumerate(texts)])
    assert {t: got[i]["ts_us"] for i, t in enumerate(texts)} == CASES
    assert [t for i, t in enumerate(texts) if got[i]["ts_usual"]] == ["2023-10-10 05:00:00", "2023-10-10 24:00:00"]


def test_twice_occurring_hour_and_repeats(spark):
    rows = [(1, "a", "2023-10-29 03:00:00"), (2, "a", "2023-10-29 03:00:00"), (3, "b", "2023-10-29 03:00:00"), (4, "a", "2023-10-29 04:00:00"), (5, "a", "2023-10-29 03:00:00 EEST")]
    got = normalised(spark, rows)
    first = us(2023, 10, 29, 3, tz="Europe/Tallinn")
    assert [got[i]["ts_us"] for i in (1, 2, 3)] == [first, first + 3_600_000_000, first]
    assert [got[i]["ts_status"] for i in (1, 2, 3, 4, 5)] == ["first", "second", "first", "ok", "ok"]


def test_skipped_hour_moves_forward(spark):
    assert normalised(spark, [(1, "a", "2024-03-31 03:30:00")])[1]["ts_us"] == us(2024, 3, 31, 1, 30)


@pytest.mark.parametrize("text", [None, "", "  ", "yesterday", "2023-13-45 00:00:00", "2023-02-30 00:00:00", "x" * 100_000, "99"])
def test_unreadable(spark, text):
    r = normalised(spark, [(1, "a", text), (2, "a", "2023-10-10 05:00:00")])[1]
    assert r["ts_us"] is None and r["ts_status"] == "unparsed" and r["ts_usual"] is False


def test_mixture_decides_day_or_month_first(spark):
    day_first = [(i, "g", f"{13 + i % 15}/04/2024 10:00") for i in range(40)]
    got = normalised(spark, [*day_first, (99, "g", "03/04/2024 10:00")])
    assert got[99]["ts_us"] == us(2024, 4, 3, 10, tz="Europe/Tallinn") and got[99]["ts_posterior"] > 0.9
    month_first = [(i, "g", f"04/{13 + i % 15}/2024 10:00") for i in range(40)]
    assert normalised(spark, [*month_first, (99, "g", "03/04/2024 10:00")])[99]["ts_us"] == us(2024, 3, 4, 10, tz="Europe/Tallinn")


def test_unresolved_is_marked(spark):
    got = normalised(spark, [(1, "g", "03/04/2024 10:00"), (2, "g", "05/06/2024 10:00")])
    assert {r["ts_status"] for r in got.values()} == {"unresolved"}
    assert [got[k]["ts_us"] for k in (1, 2)] == [None, None]
    assert got[1]["ts_candidates"] == [us(2024, 3, 4, 10, tz="Europe/Tallinn"), us(2024, 4, 3, 10, tz="Europe/Tallinn")]
    sure = normalised(spark, [(1, "g", "2023-10-10 05:00:00")])[1]
    assert sure["ts_candidates"] is None and sure["ts_posterior"] == 1.0


def test_sources_have_mixtures_of_their_own(spark):
    rows = [(i, "a", f"{13 + i % 15}/04/2024 10:00") for i in range(40)] + [(100 + i, "b", f"04/{13 + i % 15}/2024 10:00") for i in range(40)] + [(200, "a", "03/04/2024 10:00"), (201, "b", "03/04/2024 10:00"), (202, None, "03/04/2024 10:00")]
    df = spark.createDataFrame(rows, "k bigint, g string, t string")
    got = {r["k"]: r for r in T.normalise(df, "t", "UTC", source=F.col("g"), key="k").collect()}
    assert got[200]["ts_us"] == us(2024, 4, 3, 10) and got[201]["ts_us"] == us(2024, 3, 4, 10) and len(got) == 83


def test_time_in_parts(spark):
    rows = [("2015", 1, 5, 3), ("15", 1, 5, 3), ("2015.0", 1, 5, 3), ("2015", 1, 4, 24), ("1420628400", None, None, None), (None, 1, 1, 1), ("2015", 2, 30, 1), ("2015", None, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, y string, mo int, d int, h int")
    got = [r["ts_us"] for r in T.normalise(df, "y", "Asia/Shanghai", fields=T.Fields("mo", "d", "h")).orderBy("k").collect()]
    at = us(2015, 1, 5, 3, tz="Asia/Shanghai")
    assert got == [at, at, at, us(2015, 1, 5, 0, tz="Asia/Shanghai"), 1420628400_000_000, None, None, None]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k bigint, g string, t string")
    assert T.normalise(df, "t", "UTC", key="k").count() == 0
    df = spark.createDataFrame([(1, "2023-10-10 05:00:00", 7, "x", 3)], "k bigint, t string, ts_us int, _tm_src string, _tc_p int")
    r = T.normalise(df, "t", "UTC", key="k").collect()[0]
    assert r["ts_us"] == us(2023, 10, 10, 5) and r["_tm_src"] == "x" and r["_tc_p"] == 3


def test_other_session_zone_changes_nothing(spark):
    df = spark.createDataFrame([(1, "2023-10-29 03:00:00"), (2, "2024-03-10 02:30:00"), (3, "20231010T010000Z")], "k bigint, t string")
    out = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        out.append([r["ts_us"] for r in T.normalise(df, "t", "Europe/Tallinn", key="k").orderBy("k").collect()])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out[0] == out[1]


def test_em_takes_the_span_into_account():
    counts = pd.DataFrame({"source": "s", "sig": ["ymd:1", "epoch_s:1,epoch_ms:0"], "n": [100, 5]})
    got = T.em_formats(counts).set_index("sig")
    assert got.loc["epoch_s:1,epoch_ms:0", "fmt"] == "epoch_s"


def test_result_columns(spark):
    df = spark.createDataFrame([(1, "2023-10-10 05:00:00")], "k bigint, t string")
    assert T.normalise(df, "t", "UTC", out="z").columns == ["k", "t", "z_us", "z_format", "z_posterior", "z_status", "z_usual", "z_candidates"]
    assert T.unusual(T.normalise(df, "t", "UTC")).count() == 0
