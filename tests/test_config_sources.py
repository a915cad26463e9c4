import pytest
from pyspark.sql import functions as F

from combline.config import Thresholds
from combline.functions import weather
from combline.session import exists, release, shared_dir, written
from combline.sources import readings as src


def test_thresholds(tmp_path):
    assert Thresholds(env={})["quality.jumps.max_weight_jump_kg"] == 3.63 and Thresholds(env={})["events.swarm.temp_swing_f"] == 5.0
    cfg = Thresholds(env={"COMBLINE_STATUS_WATCH_SCORE": "25", "COMBLINE_REGIONS_REGION_RADIUS_MILES": "12.5", "COMBLINE_METRIC_WEIGHTS_LATEST_WEIGHT_KG": "0.5"})
    assert cfg["status.watch_score"] == 25 and cfg["regions.region_radius_miles"] == 12.5 and cfg.metrics()[0].weight == 0.5
    with pytest.raises(KeyError):
        cfg["status.nothing"]
    with pytest.raises(KeyError):
        cfg.section("status.watch_score")
    with pytest.raises(ValueError):
        Thresholds(env={"COMBLINE_STATUS_WATCH_SCORE": "high"})["status.watch_score"]
    with pytest.raises(FileNotFoundError):
        Thresholds(tmp_path / "none.toml")
    bad = tmp_path / "bad.toml"
    bad.write_text("[metric_weights]\nlatest_weight_kg = 1.0\n")
    with pytest.raises(ValueError):
        Thresholds(bad)


def test_attributes_and_sides(spark):
    rows = [(1, '{"wL":{"N":"28.5"},"tL":{"N":"94.8"},"hL":{"N":"55.1"},"wR":{"S":"off"}}'), (2, "no json"), (3, None), (4, "{}"), (5, '{"wL":{"N":"x"},"tL":{"N":"1"},"hL":{"N":"2"}}')]
    df = spark.createDataFrame(rows, "id int, sensor_data string")
    assert [(r.id, r.colony_side, r.w) for r in src.split_sides(src.attribute_values(df)).collect()] == [(1, "L", 28.5)]


def test_sequence_keeps_the_order_of_large_ids(spark):
    rows = [(10, 2**40), (10, 5), (11, 1), (9, 2**62)]
    df = spark.createDataFrame(rows, "ts long, o long").withColumn("s", src.sequence_of(F.col("ts"), F.col("o")))
    assert [(r.ts, r.o) for r in df.orderBy("s").collect()] == sorted(rows)


def test_sites(spark, tmp_path):
    p = tmp_path / "sites.json"
    p.write_text('{"sites": [{"hive_id": "A", "latitude": 0, "longitude": -80.5, "county": ""}]}')
    r = src.read_sites(spark, str(p)).first()
    assert (r.latitude, r.longitude, r.county) == (0.0, -80.5, None)
    p.write_text('{"sites": [], "radius": 3}')
    with pytest.raises(ValueError):
        src.read_sites(spark, str(p))


def test_hourly_document_and_its_words(spark):
    doc = '{"hourly":{"time":["2026-06-01T07:00","2026-06-01T08:00","2026-06-01T19:00"],"temperature_2m":[70.25,71,31],"relative_humidity_2m":[39.6,50,70],"surface_pressure":[1000.04,1,2],"cloud_cover":[10.4,50,90],"weather_code":[0,1,4]}}'
    rows = src.hourly_rows(spark.createDataFrame([("A", doc), ("B", None)], "hive_id string, payload string")).orderBy("clock_time").collect()
    assert [(r.hive_id, r.clock_time, r.temperature_f, r.humidity_pct, r.cloudiness_pct) for r in rows] == [("A", "07:00", 70.2, 40, 10), ("A", "19:00", 31.0, 70, 90)]
    assert rows[0].overview == "Warm and dry morning with mostly clear skies and Clear conditions."
    assert rows[1].overview == "Freezing and humid evening with mostly cloudy skies and weather code 4 conditions."
    assert len(weather.CODES) == 28


def test_csv_caches(spark, tmp_path):
    (tmp_path / "A_SENS.csv").write_text('device_uid,timestamp,event_type,sensor_data,user_id\nd1,1783091640,telemetry,"{""wL"":{""N"":""28.5""},""tL"":{""N"":""94.8""},""hL"":{""N"":""55.1""}}",u\nd2,1783091640,telemetry,"{}",u\n')
    sites = spark.createDataFrame([("A", "d1")], "hive_id string, device_uid string")
    r = src.read_sensor_cache(spark, str(tmp_path), sites)
    assert [(x.hive_id, x.colony_side, x.ts_epoch, x.weight_kg) for x in r.collect()] == [("A", "L", 1783091640, 28.5)]
    assert src.readings_of(r).first().colony_id == "A:L"
    with pytest.raises(FileNotFoundError):
        src.read_sensor_cache(spark, str(tmp_path / "none"), sites)


def test_written_tables_can_be_released(spark):
    t = written(spark.range(3), "x")
    assert t.count() == 3 and exists(spark, shared_dir(spark))
    release(spark)
    assert not exists(spark, f"{shared_dir(spark)}/combline-{spark.sparkContext.applicationId}")


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[3,2,3000]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default=None: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    if fine:
        assert shared_dir(fake)
    else:
        with pytest.raises(RuntimeError):
            shared_dir(fake)
