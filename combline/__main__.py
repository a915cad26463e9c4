"""python -m combline score|sister|events|validate|sensitivity --sensor DIR --weather DIR --sites FILE [--json OUT] ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from combline.config import Thresholds
from combline.operators import features, steps, validation
from combline.plans.analysis import Analysis
from combline.sinks import reports
from combline.sources import readings as src


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="combline", description=__doc__)
    p.add_argument("what", choices=["score", "sister", "events", "validate", "sensitivity"])
    for name in ("sensor", "weather", "sites"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--thresholds", default=None)
    p.add_argument("--window-days", type=int, default=None)
    p.add_argument("--site", action="append", default=[])
    p.add_argument("--labels", default=None)
    p.add_argument("--tolerance-hours", type=float, default=6.0)
    p.add_argument("--replay-days", type=int, default=None)
    p.add_argument("--json", default=None)
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("combline").getOrCreate()
    cfg = Thresholds(args.thresholds)
    sites = src.read_sites(spark, args.sites)
    raw = src.read_sensor_cache(spark, args.sensor, sites, cfg["data.default_timezone"])
    if raw.isEmpty():
        raise ValueError("no sensor readings found")
    whole = src.readings_of(raw)
    if args.what == "events":
        return _out(reports.event_log(steps.detect(whole, cfg), tuple(args.site)), args.json)
    if args.what == "validate":
        records, ranges = src.read_labels(spark, args.labels)
        events = steps.detect(whole, cfg) if args.replay_days is None else validation.first_seen(steps.detect(validation.replayed(whole, args.replay_days), cfg))
        return _out(json.dumps(reports.validation_report(validation.match_events(events, records, ranges, args.tolerance_hours)), indent=2, default=str), args.json)
    days = args.window_days or cfg["window.rolling_window_days"]
    a = Analysis(src.readings_of(features.in_window(raw, days)), src.read_weather_cache(spark, args.weather), sites, cfg, history=whole)
    if args.what == "sensitivity":
        return _out(json.dumps(reports.sensitivity_report(a), indent=2), args.json)
    as_json, as_text = (reports.scoring_json, reports.scoring_text) if args.what == "score" else (reports.sister_json, reports.sister_text)
    return _out(as_json(a) if args.json else as_text(a), args.json)


def _out(text: str, path: str | None) -> str:
    if path:
        Path(path).write_text(text)
    else:
        print(text)
    return text


if __name__ == "__main__":
    main()
