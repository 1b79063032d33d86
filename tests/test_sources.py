import json

import pytest

from tidemark.plans.evaluation import us_of
from tidemark.sources.archives import air_quality, climate_final, climate_updates, energy_blocks, open_dataset, synthetic_table, yaml_log
from tidemark.sources.bundle import SourceError, card, inferred, merge, simulated, validation_report
from tidemark.sources.sinks import manifest, write_features

H = 3_600_000_000
AIR = "No,year,month,day,hour,PM2.5,PM10,SO2,NO2,CO,O3,TEMP,PRES,DEWP,RAIN,wd,WSPM,station\n"


@pytest.fixture()
def air(tmp_path):
    (tmp_path / "PRSA_Data_Northgate_20130301-20170228.csv").write_text(AIR + "1,2017,2,28,9,12,NA,1,2,300,4,5.5,1020,-7,0,NNW,2.1,Northgate\n2,2017,2,28,10,NA,3,1,2,300,4,5.5,1020,-7,0,NA,2.1,Northgate\n")
    (tmp_path / "PRSA_Data_Southgate_20130301-20170228.csv").write_text(AIR + "1,2017,2,28,9,40,9,1,2,300,4,6.5,1021,-7,0,E,2.1,Southgate\n")
    return tmp_path


def test_air_quality(spark, air):
    b = air_quality(spark, str(air))
    rows = {r["record_id"]: r for r in b.records.collect()}
    assert len(rows) == 3 * 12 + 3
    at = us_of("2017-02-28T09:00:00+08:00")
    pm = rows["beijing:Northgate:pm2_5:20170228T0100"]
    assert (pm["value_num"], pm["event_us"], pm["available_us"], pm["unit"]) == (12.0, at, at + H, "microgram / meter ** 3")
    assert rows["beijing:Northgate:wd:20170228T0100"]["value_cat"] == "NNW" and rows["beijing:Northgate:wd:20170228T0100"]["available_us"] == at + H // 2
    assert rows["beijing:Northgate:pm2_5:20170228T0200"]["value_num"] is None and rows["beijing:Northgate:wd:20170228T0200"]["value_cat"] is None
    label = rows["beijing:target:Northgate:20170228T0100"]
    assert (label["kind"], label["available_us"]) == ("label", at + 2 * H)
    few = open_dataset(spark, "beijing", [f"root={air}", "scenario=staggered", "stations=Southgate", "features=pm2_5,wd", "targets=false"])
    assert few.records.count() == 2 and {s["feature_name"] for s in few.sources} == {"pm2_5", "wd"}
    with pytest.raises(SourceError):
        air_quality(spark, str(air), scenario="hopeful")
    with pytest.raises(SourceError):
        open_dataset(spark, "beijing", [f"root={air}", "zone=UTC"])
    with pytest.raises(SourceError):
        open_dataset(spark, "beijing", [])


@pytest.fixture()
def energy(tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("train.csv", "county,is_business,product_type,target,is_consumption,datetime,data_block_id,row_id,prediction_unit_id\n0,0,1,12.5,1,2021-09-02 09:00:00,1,0,7\n0,0,1,3.25,0,2021-09-02 09:00:00,1,1,7\n1,0,3,,1,2021-09-02 09:00:00,1,2,9\n")
    put("client.csv", "product_type,county,eic_count,installed_capacity,is_business,date,data_block_id\n1,0,108,952.89,0,2021-09-01,1\n3,5,17,1411.0,1,2021-09-01,1\n")
    put("electricity_prices.csv", "forecast_date,euros_per_mwh,origin_date,data_block_id\n2021-09-02 09:00:00,89.12,2021-09-01,1\n2021-09-02 09:00:00,90.12,2021-09-01,1\n")
    put("historical_weather.csv", "datetime,temperature,shortwave_radiation,latitude,longitude,data_block_id\n2021-08-31 09:00:00,14.2,320.0,58.5,25.5,1\n2021-08-31 09:00:00,13.2,310.0,59.0,25.5,1\n")
    put("weather_station_to_county_mapping.csv", "county_name,longitude,latitude,county\nA,25.5,58.49999999999999,0\nB,25.5,59.0,\n")
    return tmp_path


def test_energy_blocks(spark, energy):
    b = energy_blocks(spark, str(energy), 1, "2021-09-01T11:00:00+03:00")
    rows = {r["record_id"]: r for r in b.records.collect()}
    release, day = us_of("2021-09-01T11:00:00+03:00"), 24 * H
    t = rows["enefit:enefit_target:7:target_consumption:20210902T0600:b1"]
    assert (t["kind"], t["value_num"], t["available_us"]) == ("label", 12.5, release + 2 * day)
    assert rows["enefit:enefit_target:7:target_production:20210902T0600:b1"]["value_num"] == 3.25
    assert rows["enefit:enefit_target:9:target_consumption:20210902T0600:b1"]["value_num"] is None
    assert rows["enefit:enefit_client:7:installed_capacity:20210831T2100:b1"]["available_us"] == release
    assert not any(":enefit_client:9" in r for r in rows)
    price = [r for r in rows if "electricity" in r]
    assert len(price) == 2  # for both units
    assert [r["record_id"] for r in b.superseded.orderBy("record_id").collect()] == sorted(price)
    assert sum("weather_actual:station:58.5:25.5" in r for r in rows) == 2
    assert [tuple(r) for r in b.graphs.collect()] == [("weather_stations", "7", "station:58.5:25.5")]
    one = energy_blocks(spark, str(energy), 1, "2021-09-01T11:00:00+03:00", units=["7"], stations=["station:59.0:25.5"], broadcast=False)
    assert {r["entity_id"] for r in one.records.select("entity_id").distinct().collect()} == {"7", "market", "station:59.0:25.5"}
    with pytest.raises(Exception, match="before the declared first"):
        energy_blocks(spark, str(energy), 2, "2021-09-01T11:00:00+03:00").records.collect()


def climate_row(station, date, time, t="3.1", flag="0"):
    f = [station, date, time, date, time, "2.6", "-105.1", "40.0", t, "3.0", "3.0", "3.0", "0.0", "7.0", flag, "0.0", "0", "0.0", "0", "C", "2.4", "0", "2.4", "0", "2.4", "0", "81.0", "0"]
    return " ".join(f + ["-99.000"] * 5 + ["-9999.0"] * 5)


def test_climate(spark, tmp_path):
    up = tmp_path / "updates" / "2024"
    up.mkdir(parents=True)
    (up / "CRN60H0203-202401010200.txt").write_text("****0000000123****\nSXUS80 KWNO 010200\nCRNH02\n" + climate_row("94074", "20240101", "0100") + "\n" + climate_row("53131", "20240101", "0100", "-9999.0", "3") + "\n\x03\n")
    (up / "CRN60H0203-202401010300.txt").write_text(climate_row("94074", "20240101", "0100", "4.4") + "\n")
    (up / "CRN60H0203-202401010400.txt").write_text("****0000000123****\n")
    b = climate_updates(spark, str(tmp_path / "updates"), features=["t_calc", "solarad"])
    rows = {r["record_id"]: r for r in b.records.collect()}
    assert len(rows) == 4
    r = rows["uscrn:94074:t_calc:20240101T0100"]
    assert (r["value_num"], r["available_us"]) == (3.1, us_of("2024-01-01T02:00:00Z"))
    assert rows["uscrn:53131:t_calc:20240101T0100"]["value_num"] is None and rows["uscrn:53131:solarad:20240101T0100"]["quality"] == "3"
    assert [x["record_id"] for x in b.superseded.collect()] == ["uscrn:94074:t_calc:20240101T0100"]
    assert climate_updates(spark, str(tmp_path / "updates"), as_of="2024-01-01T02:00:00Z").superseded.count() == 0
    final = tmp_path / "final.txt"
    final.write_text(climate_row("94074", "20240101", "0100", "9.9") + "\n")
    f = climate_final(spark, str(final))
    assert [(x["kind"], x["value_num"], x["available_us"] - x["event_us"]) for x in f.records.collect()] == [("label", 9.9, 720 * H)]
    both = merge([b, f], "all")
    assert both.records.count() == 5 and both.label_sources == {"uscrn_final"}
    assert "| label | uscrn_final | t_calc | 1 |" in card(both)
    assert {r["source_id"] for r in validation_report(both.records)["streams"]} == {"uscrn_update", "uscrn_final"}
    assert b.late(us_of("2024-01-01T01:30:00Z"), us_of("2024-01-01T02:00:00Z")).count() == 4
    (up / "CRN60H0203-202401010500.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="another width"):
        climate_updates(spark, str(tmp_path / "updates")).records.collect()
    (up / "CRN05H0203-202401010500.txt").write_text("")
    with pytest.raises(SourceError):
        climate_updates(spark, str(tmp_path / "updates"))


def test_yaml_log(spark, tmp_path):
    p = tmp_path / "log.yaml"
    p.write_text('records:\n  - {source: s, feature: f, event_time: "2024-01-01T00:00:00Z", value: 1}\n  - {id: x, source: s, feature: f, event_time: "2024-01-01T01:00:00+01:00", available_time: "2024-01-01T05:00:00Z", value: wet}\nrequests:\n  - {at: "2024-01-01T03:00:00Z"}\n')
    log, req = yaml_log(spark, str(p))
    a, b = log.orderBy("record_id").collect()
    assert (a["record_id"], a["entity_id"], a["value_num"], a["available_us"] - a["event_us"]) == ("r000", "e1", 1.0, 0)
    assert (b["value_cat"], b["event_us"], b["available_us"] - b["event_us"]) == ("wet", a["event_us"], 5 * H)
    assert req.collect()[0]["prediction_us"] - a["event_us"] == 3 * H
    for t in ("2024-01-01T00:00:00", '"2024-01-01T00:00:00"'):
        p.write_text(f"records:\n  - {{source: s, feature: f, event_time: {t}, value: 1}}\n")
        with pytest.raises(ValueError):
            yaml_log(spark, str(p))


def test_synthetic_table_is_repeatable():
    a = synthetic_table(2, 3, "2024-01-01T00:00:00+00:00", 3600, 7, "own")
    assert a == synthetic_table(2, 3, "2024-01-01T00:00:00+00:00", 3600, 7, "own") and a[:3] == synthetic_table(1, 3, "2024-01-01T00:00:00+00:00", 3600, 7, "own")
    assert all(10 * int(s[1:]) + 0.25 * k <= float(v) < 10 * int(s[1:]) + 0.25 * k + 1 for s, k, _, v in a)


def test_availability_models(spark):
    with pytest.raises(NotImplementedError):
        inferred()
    from pyspark.sql import functions as F

    with pytest.raises(SourceError):
        simulated(F.lit(1), -1)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_sinks(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 2.5, ["a", "b"])], "request_ix bigint, v double, v__lineage array<string>")
    write_features(df, str(tmp_path / fmt), fmt)
    back = spark.read.format(fmt).option("header", "true").load(str(tmp_path / fmt)).collect()
    assert float(back[0]["v"]) == 2.5


def test_manifest(tmp_path):
    manifest(str(tmp_path), {"scores.json": {"b": 1, "a": 2}, "results.txt": "ok\n"}, {"seed": 1})
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert [a["path"] for a in m["artifacts"]] == ["results.txt", "scores.json"] and (tmp_path / "scores.json").read_bytes() == b'{\n  "a": 2,\n  "b": 1\n}\n'
