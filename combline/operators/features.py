"""Per colony features: day types of the weather, daily changes, first and last readings, and the wide table of them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combline.config import Thresholds
from combline.functions.weather import RAINY_CODES
from combline.operators import steps
from combline.operators.quality import settling
from combline.operators.quantiles import quantiles


def pct_change(start: Column, end: Column) -> Column:
    """Change in percent of start; 0 from 0."""
    return F.when(start == 0, F.lit(0.0)).otherwise((end - start) / start * 100)


def in_window(readings: DataFrame, days: int, at: str = "observed_at") -> DataFrame:
    """Rows at most days before the newest one, that day's instant included. The bound goes into the scan as a literal."""
    newest = readings.agg(F.max(at).alias("m")).first()["m"]
    return readings.limit(0) if newest is None else readings.where(F.col(at) >= F.lit(newest) - F.expr(f"INTERVAL {int(days)} DAYS"))


def on_days(weather: DataFrame, readings: DataFrame) -> DataFrame:
    """Weather of the days on which any colony has a reading; all of it if there is no reading at all."""
    days = readings.select(F.col("day").alias("observed_date")).distinct()
    return weather.join(F.broadcast(days), "observed_date", "left_semi") if not days.isEmpty() else weather


def day_types(weather: DataFrame, cfg: Thresholds) -> DataFrame:
    """hive_id, observed_date, day_type: poor before favorable, neutral where neither holds. Null measures say nothing."""
    g = weather.groupBy("hive_id", "observed_date").agg(
        F.coalesce(F.bool_or(F.col("weather_code").isin(RAINY_CODES)), F.lit(False)).alias("rainy"), F.avg("temperature_f").alias("temp"), F.avg("cloudiness_pct").alias("cloud"), F.avg("humidity_pct").alias("humid")
    )
    no = F.lit(False)
    poor = F.col("rainy") | F.coalesce((F.col("temp") < cfg["weather.poor_low_temp_f"]) | (F.col("temp") > cfg["weather.poor_high_temp_f"]), no) | F.coalesce(F.col("cloud") >= cfg["weather.poor_cloudiness_pct"], no)
    fine = (
        F.coalesce(F.col("temp").between(cfg["weather.favorable_low_temp_f"], cfg["weather.favorable_high_temp_f"]), no)
        & F.coalesce(F.col("cloud") < cfg["weather.favorable_cloudiness_pct"], ~no) & F.coalesce(F.col("humid") < cfg["weather.favorable_humidity_pct"], ~no)
    )
    return g.select("hive_id", "observed_date", F.when(poor, "poor").when(fine, "favorable").otherwise("neutral").alias("day_type"))


def weather_shares(weather: DataFrame, cfg: Thresholds) -> DataFrame:
    """Per hive: means, share of rainy among rows with a code, share of cloudy among all rows, in percent."""
    rainy = F.when(F.col("weather_code").isNotNull(), F.col("weather_code").isin(RAINY_CODES).cast("double"))
    cloudy = F.coalesce((F.col("cloudiness_pct") >= cfg["weather.cloudy_reading_pct"]).cast("double"), F.lit(0.0))
    return weather.groupBy("hive_id").agg(
        F.avg("temperature_f").alias("avg_weather_temp_f"), F.avg("humidity_pct").alias("avg_weather_humidity_pct"), F.coalesce(100 * F.avg(rainy), F.lit(0.0)).alias("rainy_weather_reading_pct"), (100 * F.avg(cloudy)).alias("cloudy_weather_reading_pct")
    )


def dominant_overview(weather: DataFrame) -> DataFrame:
    """hive_id, overview: the most frequent text that is not empty; of equally frequent ones that with the smallest obs_id."""
    texts = weather.where((F.col("overview") != "") & F.col("hive_id").isNotNull()).groupBy("hive_id", "overview").agg(F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "overview")).alias("b")
    return texts.groupBy("hive_id").agg(best).select("hive_id", F.col("b.overview").alias("dominant_weather_overview"))


def daily_changes(readings: DataFrame, events: DataFrame) -> DataFrame:
    """colony_id, hive_id, day, n, pct: first to last weight of each day with two readings or more and without an event."""
    quiet = readings.join(events.select("colony_id", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("wall") / 86_400).cast("int")).alias("day")).distinct(), ["colony_id", "day"], "left_anti") if events is not None else readings
    g = quiet.groupBy("colony_id", "hive_id", "day").agg(F.count(F.lit(1)).alias("n"), F.min_by("w", "seq").alias("a"), F.max_by("w", "seq").alias("z"))
    return g.where("n >= 2").select("colony_id", "hive_id", "day", "n", pct_change(F.col("a"), F.col("z")).alias("pct"))


def weather_windows(changes: DataFrame, types: DataFrame) -> DataFrame:
    """Per colony: number and mean change of favorable days, number and mean loss of poor days."""
    d = changes.join(types.withColumnRenamed("observed_date", "day"), ["hive_id", "day"])
    good, poor = F.col("day_type") == "favorable", F.col("day_type") == "poor"
    return d.groupBy("colony_id").agg(
        F.count_if(good).alias("favorable_weather_window_count"), F.count_if(poor).alias("poor_weather_window_count"),
        F.coalesce(F.avg(F.when(good, F.col("pct"))), F.lit(0.0)).alias("favorable_weather_weight_slope_pct_per_day"),
        F.coalesce(F.avg(F.when(poor, F.abs(F.least(F.lit(0.0), F.col("pct"))))), F.lit(0.0)).alias("poor_weather_weight_loss_pct"),
    )


def first_last(readings: DataFrame) -> DataFrame:
    """Per colony: number of readings, first and last local time, days between (an hour at least), last weight."""
    g = readings.groupBy("colony_id", "hive_id", "colony_side").agg(
        F.count(F.lit(1)).alias("sample_count"), F.min_by("wall", "seq").alias("start_wall"), F.max_by("wall", "seq").alias("end_wall"), F.max_by("w", "seq").alias("latest_weight_kg")
    )
    return g.withColumn("days_observed", _days_observed())


def _days_observed() -> Column:
    return F.greatest((F.col("end_wall") - F.col("start_wall")) / 86400.0, F.lit(1 / 24))


def first_last_of_days(days: DataFrame) -> DataFrame:
    """first_last of what steps.day_sums gives."""
    g = days.groupBy("colony_id", "hive_id", "colony_side").agg(
        F.sum("n").alias("sample_count"), F.min_by("wall0", "seq0").alias("start_wall"), F.max_by("wall1", "seq1").alias("end_wall"), F.max_by("w1", "seq1").alias("latest_weight_kg")
    )
    return g.withColumn("days_observed", _days_observed())


def movements(days: DataFrame, events: DataFrame, types: DataFrame, cfg: Thresholds) -> DataFrame:
    """One row per colony with readings, from their day_sums and the day_types of the weather: what colonies are compared by.

    Only types of days with a daily change count, so there is no need to leave others out before."""
    merged = steps.merge_short(steps.segment_sums_of_days(days, events), cfg)
    out = first_last_of_days(days).join(steps.trend(steps.segment_slopes(merged)), "colony_id", "left")
    changes = days.where("quiet and n >= 2").select("colony_id", "hive_id", "day", "n", pct_change(F.col("w0"), F.col("w1")).alias("pct"))
    out = out.join(weather_windows(changes, types), "colony_id", "left")
    return out.fillna(0, ["favorable_weather_window_count", "poor_weather_window_count"]).fillna(
        0.0, ["favorable_weather_weight_slope_pct_per_day", "poor_weather_weight_loss_pct", "delta_kg", "weight_pct_change", "weight_slope_kg_per_day", "weight_slope_pct_per_day"]
    )


def with_counts(moved: DataFrame, events: DataFrame, counts: DataFrame | None) -> DataFrame:
    """moved with the numbers of events, excluded readings and days with a flag."""
    out = moved.join(events.groupBy("colony_id").agg(F.count(F.lit(1)).alias("weight_event_count")), "colony_id", "left")
    if counts is not None:
        out = out.join(counts.select("colony_id", F.col("excluded").alias("excluded_reading_count"), F.col("issue_days").alias("data_quality_issue_days")), "colony_id", "left")
    else:
        out = out.withColumns({"excluded_reading_count": F.lit(0), "data_quality_issue_days": F.lit(0)})
    return out.fillna(0, ["weight_event_count", "excluded_reading_count", "data_quality_issue_days"])


def with_weather(out: DataFrame, days: DataFrame, weather: DataFrame, cfg: Thresholds) -> DataFrame:
    """out with averages, shares and the most frequent text of the weather of the days with readings; null without weather."""
    w = on_days(weather, days)
    return out.join(weather_shares(w, cfg), "hive_id", "left").join(dominant_overview(w), "hive_id", "left")


def features(days: DataFrame, events: DataFrame, weather: DataFrame, counts: DataFrame | None, cfg: Thresholds) -> DataFrame:
    """One wide row per colony with readings, from their day_sums. Colonies without weather keep null averages and counts of 0."""
    return with_weather(with_counts(movements(days, events, day_types(weather, cfg), cfg), events, counts), days, weather, cfg)


def normal_movement(readings: DataFrame, events: DataFrame, cfg: Thresholds) -> DataFrame:
    """channel, x: absolute changes between neighbours, but for those up to the settle time after an event."""
    limit = cfg["quality.jumps.max_jump_interval_hours"]
    elapsed = (F.col("wall") - F.col("p_wall")) / 3600.0
    pairs = steps.with_previous(readings, limit).where((elapsed > 0) & (elapsed <= limit) & (F.col("w") > 0) & (F.col("p_w") > 0))
    calm = settling(pairs, events, cfg).where(~F.col("settling"))
    dw = F.abs(F.col("w") - F.col("p_w"))
    values = {"weight_kg": dw, "weight_pct": dw / F.col("p_w") * 100, "temp_f": F.abs(F.col("t") - F.col("p_t")), "humidity_pp": F.abs(F.col("h") - F.col("p_h"))}
    return calm.select(F.inline(F.array(*(F.struct(F.lit(k).alias("channel"), v.alias("x")) for k, v in values.items()))))


def channel_report(movement: DataFrame, cfg: Thresholds, fractions: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Percentiles of normal movement per channel, and for each threshold its rank and what 0.75, 1 and 1.25 of it would exclude."""
    counted = movement.groupBy("channel", "x").agg(F.count(F.lit(1)).alias("n"))
    limits = {"weight_kg": "max_weight_jump_kg", "weight_pct": "max_weight_jump_pct", "temp_f": "max_temp_jump_f", "humidity_pp": "max_humidity_jump_pct"}
    limit = F.lit(None).cast("double")
    for k, v in limits.items():
        limit = F.when(F.col("channel") == k, F.lit(float(cfg["quality.jumps." + v]))).otherwise(limit)
    sums = counted.withColumn("limit", limit).groupBy("channel", "limit").agg(
        F.sum("n").alias("pairs"), F.sum(F.when(F.col("x") <= F.col("limit"), F.col("n")).otherwise(0)).alias("below"),
        *(F.sum(F.when(F.col("x") > F.col("limit") * f, F.col("n")).otherwise(0)).alias(f"over_{name}") for f, name in ((0.75, "075"), (1.0, "100"), (1.25, "125"))),
    )
    return quantiles(counted, ["channel"], "x", "n", fractions), sums.withColumn("rank_pct", F.col("below") * 100.0 / F.col("pairs"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
