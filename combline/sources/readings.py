"""Readers: tables and CSV caches to readings, weather and sites in one shape."""

from __future__ import annotations

import json
from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from combline.functions.weather import describe
from combline.session import exists

SENSOR_CSV = T.StructType([T.StructField(n, T.LongType() if n == "timestamp" else T.StringType()) for n in ("device_uid", "timestamp", "event_type", "sensor_data", "user_id")])
WEATHER_CSV = T.StructType(
    [T.StructField("hive_id", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("date", T.DateType()), T.StructField("clock_time", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("temperature_F", "pressure_hPa", "cloudiness_percent", "humidity_percent")]
    + [T.StructField("weather_condition_code", T.IntegerType()), T.StructField("weather_overview", T.StringType())]
)
MEMBERS = ["wL", "tL", "hL", "wR", "tR", "hR", "tE", "hE"]


def wall_seconds(ts: Column) -> Column:
    """Seconds of a zone-less timestamp on its own clock, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def sequence_of(ts: Column, ord_: Column) -> Column:
    """One number that orders by ts, then by ord_; of fixed width, so aggregates over it stay hash aggregates."""
    return (ts.cast("decimal(18,0)") * F.lit(Decimal(10**19)).cast("decimal(20,0)") + ord_.cast("decimal(19,0)")).cast("decimal(38,0)")


def readings_of(df: DataFrame) -> DataFrame:
    """Readings of a table with one row per colony side; those without weight, temperature or humidity are left out.

    seq orders a colony's readings: by instant, then by order of arrival, in one decimal that holds any two longs. wall is
    the local clock in seconds.
    """
    out = df.select(
        F.concat_ws(":", "hive_id", "colony_side").alias("colony_id"), "hive_id", "colony_side", F.col("reading_id").alias("ord"), F.col("ts_epoch").alias("ts"),
        sequence_of(F.col("ts_epoch"), F.col("reading_id")).alias("seq"),
        wall_seconds(F.col("observed_at")).alias("wall"), F.col("observed_at").cast("date").alias("day"),
        F.col("weight_kg").alias("w"), F.col("internal_temp_f").alias("t"), F.col("internal_humidity_pct").alias("h"), F.col("external_temp_f").alias("et"), F.col("external_humidity_pct").alias("eh"),
    )
    return out.dropna(subset=["hive_id", "colony_side", "ord", "ts", "wall", "w", "t", "h"])


def attribute_values(df: DataFrame, column: str = "sensor_data") -> DataFrame:
    """df with a double column for each member of an AttributeValue map; members that are absent or no number are null."""
    values = F.from_json(column, "map<string,struct<N:string>>")
    return df.withColumn("_m", values).withColumns({m: F.expr(f"try_cast(_m['{m}'].N AS double)") for m in MEMBERS}).drop("_m")


def split_sides(df: DataFrame) -> DataFrame:
    """A device row with members of both sides as up to two rows, for each side of which weight, temperature and humidity are there."""
    sides = F.array(*(F.struct(F.lit(s).alias("colony_side"), F.col(f"w{s}").alias("w"), F.col(f"t{s}").alias("t"), F.col(f"h{s}").alias("h")) for s in "LR"))
    keep = [c for c in df.columns if c not in MEMBERS or c in ("tE", "hE")]
    return df.select(*keep, F.inline(sides)).dropna(subset=["w", "t", "h"])


def _required(spark: SparkSession, folder: str, label: str) -> None:
    if not exists(spark, folder):
        raise FileNotFoundError(f"no {label} folder {folder}")


def read_sensor_cache(spark: SparkSession, folder: str, sites: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Readings of <hive_id>_SENS.csv files in the shape of the readings table; rows of another device than the site's are left out.

    reading_id is made of the file's rows in no fixed order; it only tells rows apart. A missing folder raises, and so does a cell that is no number.
    """
    _required(spark, folder, "sensor")
    rows = spark.read.csv(f"{folder}/*_SENS.csv", header=True, schema=SENSOR_CSV, escape='"', mode="FAILFAST").withColumn("hive_id", F.regexp_extract(F.input_file_name(), r"([^/]+)_SENS\.csv(?:/[^/]+)?$", 1))
    known = rows.join(sites.select("hive_id", "device_uid"), ["hive_id", "device_uid"])
    local = F.timestamp_add("SECOND", wall_of(F.col("timestamp"), zone), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return split_sides(attribute_values(known)).select(
        F.monotonically_increasing_id().alias("reading_id"), "hive_id", "colony_side", "device_uid", F.col("timestamp").alias("ts_epoch"), local.alias("observed_at"),
        F.col("w").alias("weight_kg"), F.col("t").alias("internal_temp_f"), F.col("h").alias("internal_humidity_pct"), F.col("tE").alias("external_temp_f"), F.col("hE").alias("external_humidity_pct"),
    )


def wall_of(epoch: Column, zone: str) -> Column:
    """Seconds on zone's clock at an instant; neither step looks at the session's zone."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(epoch), F.lit(zone)))


def read_weather_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of <hive_id>_data.csv files; empty cells are null. A missing folder raises, and so does a cell that is no number."""
    _required(spark, folder, "weather")
    return spark.read.csv(f"{folder}/*_data.csv", header=True, schema=WEATHER_CSV, escape='"', mode="FAILFAST").withColumn("obs_id", F.monotonically_increasing_id()).withColumnsRenamed(
        {"date": "observed_date", "temperature_F": "temperature_f", "pressure_hPa": "pressure_hpa", "cloudiness_percent": "cloudiness_pct", "humidity_percent": "humidity_pct", "weather_condition_code": "weather_code", "weather_overview": "overview"}
    )


def hourly_rows(df: DataFrame, column: str = "payload", hours: tuple[int, ...] = (7, 14, 19)) -> DataFrame:
    """Parallel arrays of an hourly weather document as rows of the given hours, with the sentence that tells them."""
    kind = "struct<hourly:struct<time:array<string>,temperature_2m:array<double>,surface_pressure:array<double>,cloud_cover:array<double>,relative_humidity_2m:array<double>,weather_code:array<int>>>"
    doc = df.withColumn("_d", F.from_json(column, kind)).where(F.col("_d.hourly.time").isNotNull())
    names = ["time", "temperature_2m", "surface_pressure", "cloud_cover", "relative_humidity_2m", "weather_code"]
    rows = doc.select(*[c for c in df.columns if c != column], F.inline(F.arrays_zip(*(F.col(f"_d.hourly.{n}") for n in names))))
    at = F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm"))
    rows = rows.where(F.hour(at).isin(*hours))
    words = describe(F.hour(at), F.col("temperature_2m"), F.col("relative_humidity_2m"), F.col("cloud_cover"), F.col("weather_code"))
    return rows.select(
        *[c for c in df.columns if c != column], F.to_date(at).alias("observed_date"), F.substring("time", 12, 5).alias("clock_time"),
        F.bround("temperature_2m", 1).alias("temperature_f"), F.bround("surface_pressure", 1).alias("pressure_hpa"), F.bround("cloud_cover").alias("cloudiness_pct"), F.bround("relative_humidity_2m").alias("humidity_pct"), "weather_code", words.alias("overview"),
    )


def hourly_sources(start: date, end: date, today: date, recent_days: int = 85, lag_days: int = 7) -> list[tuple[str, date, date]]:
    """Which of two weather services (recent, archive) has which days from start to end: the recent one reaches back recent_days, the archive ends lag_days ago."""
    if start >= today - timedelta(days=recent_days):
        return [("recent", start, end)]
    split = today - timedelta(days=lag_days)
    if end < split:
        return [("archive", start, end)]
    return [("archive", start, split - timedelta(days=1)), ("recent", split, end)]


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a JSON inventory {"sites": [...]}; settings that belong into the thresholds raise."""
    doc = json.loads(Path(path).read_text())
    if extra := sorted(set(doc) - {"sites"}):
        raise ValueError(f"settings {extra} belong into the thresholds file")
    names = ["hive_id", "device_uid", "display_name", "county", "state", "region_label"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
    cell = lambda v, number: None if v is None or v == "" else float(v) if number else str(v)
    return spark.createDataFrame([tuple(cell(s.get(f.name), f.dataType == T.DoubleType()) for f in schema) for s in doc["sites"]], schema)


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled events and audited ranges of a JSON document; a range without a side holds for both."""
    doc = spark.read.json(path, multiLine=True)
    records = doc.select(F.posexplode("records").alias("ord", "r")).select(
        "ord", F.concat_ws(":", "r.site_id", "r.colony_side").alias("colony_id"), F.unix_seconds(F.to_timestamp("r.observed_at")).alias("at"), "r.label", "r.kinds"
    )
    side = F.coalesce(F.col("a.colony_side"), F.lit("*")) if "colony_side" in doc.select(F.explode("audited_ranges").alias("a")).select("a.*").columns else F.lit("*")
    ranges = doc.select(F.explode("audited_ranges").alias("a")).select(
        F.col("a.site_id").alias("hive_id"), side.alias("side"), F.unix_seconds(F.to_timestamp("a.start")).alias("start"), F.unix_seconds(F.to_timestamp("a.end")).alias("end")
    )
    return records, ranges


def plain_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with AttributeValue cells ({"S": ...}, {"N": ...}, {"BOOL": ...}, {"M": ...}) as plain text; a map stays JSON without blanks."""

    def plain(c: str) -> Column:
        get = lambda k: F.get_json_object(F.col(c), f"$.{k}")
        return F.coalesce(get("S"), get("N"), get("BOOL"), get("M"), F.col(c))

    return df.withColumns({c: plain(c) for c in columns})


def write_sensor_cache(df: DataFrame, path: str) -> None:
    """Device rows as CSV in the columns of the sensor cache."""
    df.select([f.name for f in SENSOR_CSV]).write.mode("overwrite").csv(path, header=True, escape='"')


def write_weather_cache(df: DataFrame, path: str) -> None:
    """Weather rows as CSV in the columns of the weather cache."""
    names = {"observed_date": "date", "temperature_f": "temperature_F", "pressure_hpa": "pressure_hPa", "cloudiness_pct": "cloudiness_percent", "humidity_pct": "humidity_percent", "weather_code": "weather_condition_code", "overview": "weather_overview"}
    df.withColumnsRenamed(names).select([f.name for f in WEATHER_CSV]).write.mode("overwrite").csv(path, header=True, escape='"')
