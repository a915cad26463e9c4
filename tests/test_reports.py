import json

from pyspark.sql import functions as F

from combline.__main__ import main
from combline.sources import readings as src


def test_from_caches_to_reports(spark, tmp_path):
    start = 1_780_300_800
    cells = lambda w: json.dumps({k: {"N": str(v)} for k, v in w.items()}).replace('"', '""')
    for hive, uid, base in (("A", "d1", 30.0), ("B", "d2", 50.0), ("C", "d3", 20.0)):
        lines = ["device_uid,timestamp,event_type,sensor_data,user_id"]
        for h in range(170 if hive != "C" else 20):
            left = base + (0 if h < 60 or hive != "A" else -8)
            lines.append(f'{uid},{start + h * 3600},t,"{cells({"wL": left, "tL": 94, "hL": 55, "wR": base + h * 0.01, "tR": 94, "hR": 55})}",u')
        (tmp_path / f"{hive}_SENS.csv").write_text("\n".join(lines))
        days = [f"{hive},36.2,-81.6,2026-06-0{k},07:00,70,1000,10,50,0,Warm and dry" for k in range(1, 8)]
        (tmp_path / f"{hive}_data.csv").write_text("hive_id,latitude,longitude,date,clock_time,temperature_F,pressure_hPa,cloudiness_percent,humidity_percent,weather_condition_code,weather_overview\n" + "\n".join(days))
    sites = [{"hive_id": h, "device_uid": u, "latitude": 36.2, "longitude": -81.6} for h, u in (("A", "d1"), ("B", "d2"), ("C", "d3"))]
    (tmp_path / "sites.json").write_text(json.dumps({"sites": sites}))
    base = ["--sensor", str(tmp_path), "--weather", str(tmp_path), "--sites", str(tmp_path / "sites.json")]
    text = main(["score", *base], spark)
    assert "Colonies compared: " in text and "harvest" in text and "NOT REPORTING: C:L" in text and "Regional highlights:" in text
    doc = json.loads(main(["score", *base, "--json", str(tmp_path / "out.json")], spark))
    assert {c["colony_id"]: c["weight_events"][0]["kind"] for c in doc["colonies"] if c["weight_events"]} == {"A:L": "harvest"}
    assert doc["metadata"]["not_reporting_colony_count"] == 2 and doc["regions"][0]["site_count"] == 3
    sister = json.loads(main(["sister", *base, "--json", str(tmp_path / "s.json")], spark))
    assert {s["hive_id"]: s["weaker_side"] for s in sister["sites"]}["A"] == "L" and sister["metadata"]["sister_site_count"] == len(sister["sites"])
    assert "Sites compared" in main(["sister", *base], spark)
    log = main(["events", *base, "--site", "A"], spark)
    assert "A:L (1 events)" in log and log.endswith("Total: 1 events") and main(["events", *base, "--site", "B"], spark).endswith("Total: 0 events")
    labels = {"records": [{"site_id": "A", "colony_side": "L", "observed_at": "2026-06-03T16:00:00-04:00", "label": "event", "kinds": ["harvest"]}], "audited_ranges": [{"site_id": "A", "start": "2026-06-01T00:00:00-04:00", "end": "2026-06-09T00:00:00-04:00"}]}
    (tmp_path / "labels.json").write_text(json.dumps(labels))
    v = json.loads(main(["validate", *base, "--labels", str(tmp_path / "labels.json")], spark))
    assert (v["precision"], v["recall"]) == (1.0, 1.0) and v["confusion"]["true_positive"] == 1
    assert json.loads(main(["sensitivity", *base], spark))["one_at_a_time_variants"] == 20


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([('{"S":"d1"}', '{"N":"5"}', '{"M":{"wL":{"N":"1"}}}', '{"BOOL":true}')], "device_uid string, timestamp string, sensor_data string, user_id string").withColumn("event_type", F.lit("t"))
    plain = src.plain_values(df, ["device_uid", "timestamp", "sensor_data", "user_id"]).withColumn("timestamp", F.col("timestamp").cast("long"))
    src.write_sensor_cache(plain, str(tmp_path / "s"))
    back = spark.read.csv(str(tmp_path / "s"), header=True, schema=src.SENSOR_CSV, escape='"').first()
    assert (back.device_uid, back.timestamp, back.sensor_data, back.user_id) == ("d1", 5, '{"wL":{"N":"1"}}', "true")
