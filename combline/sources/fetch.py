"""Rows from the two services that feed the caches: a key-value store of device rows and an hourly weather service.

Neither client is imported here: the caller gives a function that makes one, which runs where the rows are fetched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from typing import Any
from urllib.parse import urlencode
from urllib.request import urlopen
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame

from combline.sources.readings import hourly_rows, hourly_sources, write_sensor_cache, write_weather_cache

#: Addresses of the public weather service and the measures asked for.
SERVICES = {"recent": "https://api.open-meteo.com/v1/forecast", "archive": "https://archive-api.open-meteo.com/v1/archive"}
MEASURES = "temperature_2m,relative_humidity_2m,surface_pressure,cloud_cover,weather_code"


def time_range(days: int, zone: str, end: datetime | None = None) -> tuple[int, int]:
    """First and last epoch second of the days up to end (now, if not given) in zone."""
    last = end or datetime.now(ZoneInfo(zone))
    if last.tzinfo is None:
        last = last.replace(tzinfo=ZoneInfo(zone))
    return int((last - timedelta(days=days)).timestamp()), int(last.timestamp())


def device_pages(client: Any, table: str, device: str, start: int, end: int) -> Iterator[dict]:
    """All items of a device from start to end, both included, in order of time, page after page."""
    ask = {
        "TableName": table, "KeyConditionExpression": "#d = :d AND #t BETWEEN :a AND :z", "ExpressionAttributeNames": {"#d": "device_uid", "#t": "timestamp"},
        "ExpressionAttributeValues": {":d": {"S": device}, ":a": {"N": str(start)}, ":z": {"N": str(end)}}, "ScanIndexForward": True,
    }
    while True:
        page = client.query(**ask)
        yield from page.get("Items", [])
        if not page.get("LastEvaluatedKey"):
            return
        ask["ExclusiveStartKey"] = page["LastEvaluatedKey"]


def _plain(cell: dict | None) -> str | None:
    if not cell:
        return None
    kind, value = next(iter(cell.items()))
    return json.dumps(value, separators=(",", ":")) if kind in ("M", "L") else None if kind == "NULL" else str(value)


def device_rows(sites: DataFrame, make_client: Callable[[], Any], table: str, start: int, end: int) -> DataFrame:
    """Rows of all devices of sites in the columns of the sensor cache. Each task asks for its devices one after another."""
    names = ["device_uid", "timestamp", "event_type", "sensor_data", "user_id"]

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            for device in b["device_uid"].dropna().unique():
                rows = [[_plain(i.get(n)) for n in names] for i in device_pages(client, table, device, start, end)]
                out = pd.DataFrame(rows, columns=names)
                yield out.assign(timestamp=pd.to_numeric(out["timestamp"]).astype("Int64"))

    known = sites.select("device_uid").distinct()
    return known.repartition("device_uid").mapInPandas(fetch, "device_uid string, timestamp long, event_type string, sensor_data string, user_id string")


def request_hourly(url: str) -> dict:
    """The hourly arrays of one answer of the weather service."""
    with urlopen(url, timeout=30) as answer:
        if answer.status != 200:
            raise RuntimeError(f"HTTP {answer.status} for {url}")
        return json.loads(answer.read().decode())["hourly"]


def weather_documents(sites: DataFrame, start: date, end: date, today: date, zone: str, request: Callable[[str], dict] = request_hourly) -> DataFrame:
    """hive_id, latitude, longitude, payload: for each site one document of hourly arrays, put together from the services that have its days."""
    parts = hourly_sources(start, end, today)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b.itertuples(index=False):
                whole: dict[str, list] = {}
                for service, a, z in parts:
                    ask = {"latitude": s.latitude, "longitude": s.longitude, "start_date": a.isoformat(), "end_date": z.isoformat(), "hourly": MEASURES, "temperature_unit": "fahrenheit", "timezone": zone}
                    for k, v in request(f"{SERVICES[service]}?{urlencode(ask)}").items():
                        whole.setdefault(k, []).extend(v)
                rows.append((s.hive_id, s.latitude, s.longitude, json.dumps({"hourly": whole})))
            yield pd.DataFrame(rows, columns=["hive_id", "latitude", "longitude", "payload"])

    return sites.select("hive_id", "latitude", "longitude").dropna().repartition("hive_id").mapInPandas(fetch, "hive_id string, latitude double, longitude double, payload string")


def refresh(
    sites: DataFrame, sensor_dir: str, weather_dir: str, days: int, zone: str, make_client: Callable[[], Any], table: str, request: Callable[[str], dict] = request_hourly, end: datetime | None = None
) -> None:
    """Both caches of the last days, written anew: device rows by site, weather in one table. Device rows are fetched once."""
    from pyspark.sql import functions as F

    from combline.session import written

    first, last = time_range(days, zone, end)
    rows = written(device_rows(sites, make_client, table, first, last), "device-rows")
    for s in sites.select("hive_id", "device_uid").collect():  # the inventory names the files
        write_sensor_cache(rows.where(F.col("device_uid") == s["device_uid"]), f"{sensor_dir}/{s['hive_id']}_SENS.csv")
    upto = (end or datetime.now(ZoneInfo(zone))).date()
    documents = weather_documents(sites, upto - timedelta(days=days - 1), upto, upto, zone, request)
    write_weather_cache(hourly_rows(documents), f"{weather_dir}/all_data.csv")
