import sys
from datetime import date, datetime

from pyspark import cloudpickle

from combline.sources import fetch
from combline.sources.readings import hourly_rows, hourly_sources, read_sensor_cache, read_weather_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not have this file


class Pages:
    """Three items on two pages."""

    def query(self, **ask):
        who, low = ask["ExpressionAttributeValues"][":d"]["S"], ask["ExpressionAttributeValues"][":a"]["N"]
        if "ExclusiveStartKey" not in ask:
            cells = [{"device_uid": {"S": who}, "timestamp": {"N": low}, "sensor_data": {"M": {"wL": {"N": "1"}}}}, {"device_uid": {"S": who}, "timestamp": {"N": "7"}, "user_id": {"NULL": True}}]
            return {"Items": cells, "LastEvaluatedKey": {"x": 1}}
        return {"Items": [{"device_uid": {"S": who}, "timestamp": {"N": "9"}, "event_type": {"S": "t"}}]}


def _answer(url):
    year = "2026" if "archive" in url else "2027"
    return {"time": [f"{year}-01-01T07:00"], "temperature_2m": [50.0], "relative_humidity_2m": [40], "surface_pressure": [1000.0], "cloud_cover": [10], "weather_code": [0]}


def test_device_rows_follow_pages(spark):
    sites = spark.createDataFrame([("A", "d1"), ("B", "d2"), ("C", None), ("D", "d1")], "hive_id string, device_uid string")
    rows = sorted((r.device_uid, r.timestamp, r.sensor_data or "", r.event_type or "") for r in fetch.device_rows(sites, Pages, "t", 5, 10).collect())
    assert rows == [(d, *x) for d in ("d1", "d2") for x in ((5, '{"wL":{"N":"1"}}', ""), (7, "", ""), (9, "", "t"))]


def test_time_range():
    assert fetch.time_range(1, "America/New_York", datetime(2026, 3, 9, 0, 0)) == (1772946000, 1773028800)


def test_services_share_a_range(spark):
    today = date(2026, 12, 31)
    assert hourly_sources(date(2026, 12, 1), today, today) == [("recent", date(2026, 12, 1), today)]
    assert hourly_sources(date(2026, 1, 1), date(2026, 2, 1), today) == [("archive", date(2026, 1, 1), date(2026, 2, 1))]
    assert hourly_sources(date(2026, 1, 1), today, today) == [("archive", date(2026, 1, 1), date(2026, 12, 23)), ("recent", date(2026, 12, 24), today)]
    sites = spark.createDataFrame([("A", 1.0, 2.0), ("B", None, 2.0)], "hive_id string, latitude double, longitude double")
    docs = fetch.weather_documents(sites, date(2026, 1, 1), today, today, "America/New_York", _answer)
    assert sorted((r.hive_id, str(r.observed_date)) for r in hourly_rows(docs).collect()) == [("A", "2026-01-01"), ("A", "2027-01-01")]


class Left(Pages):
    def query(self, **ask):
        cell = {k: {"N": "40"} for k in ("wL", "tL", "hL")}
        return {"Items": [{"device_uid": ask["ExpressionAttributeValues"][":d"], "timestamp": {"N": "1783091640"}, "sensor_data": {"M": cell}}]}


def test_refreshed_caches_read_back(spark, tmp_path):
    sites = spark.createDataFrame([("A", "d1", 1.0, 2.0), ("B", "d2", 3.0, 4.0)], "hive_id string, device_uid string, latitude double, longitude double")
    fetch.refresh(sites, str(tmp_path / "s"), str(tmp_path / "w"), 7, "America/New_York", Left, "t", _answer, datetime(2027, 1, 2))
    assert sorted((r.hive_id, r.device_uid, r.weight_kg) for r in read_sensor_cache(spark, str(tmp_path / "s"), sites).collect()) == [("A", "d1", 40.0), ("B", "d2", 40.0)]
    w = read_weather_cache(spark, str(tmp_path / "w")).orderBy("hive_id").collect()
    assert [(r.hive_id, r.latitude, r.clock_time, r.weather_code) for r in w] == [("A", 1.0, "07:00", 0), ("B", 3.0, "07:00", 0)]
