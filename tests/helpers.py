"""Small tables of readings and weather for the scenarios."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

START = datetime(2026, 6, 1, 0, 0)
ZONE_H = -4  # June: no clock change in the scenarios
COLUMNS = "colony_id string, hive_id string, colony_side string, ord long, ts long, wall long, day date, w double, t double, h double, et double, eh double"


def readings(weights, hive="H1", side="L", temps=None, hums=None, drift=0.0, wobble=0.0, start=START, hours=None, ord0=0, et=70.0, eh=60.0):
    """Hourly rows with the given weights (or at the given hours)."""
    rows = []
    for i, base in enumerate(weights):
        at = start + timedelta(hours=hours[i] if hours else i)
        wall = int((at - datetime(1970, 1, 1)).total_seconds())
        rows.append((f"{hive}:{side}", hive, side, ord0 + i, wall - ZONE_H * 3600, wall, at.date(), float(base + i * drift + wobble * math.sin(i)),
                     float(temps[i] if temps else 94.0), float(hums[i] if hums else 55.0), et, eh))
    return rows


def frame(spark, *parts):
    from pyspark.sql import functions as F

    from combline.sources.readings import sequence_of

    df = spark.createDataFrame([r for p in parts for r in p], COLUMNS)
    return df.withColumn("seq", sequence_of(F.col("ts"), F.col("ord")))


def utc(year, month, day, hour=0):
    return int(datetime(year, month, day, hour, tzinfo=timezone.utc).timestamp())
