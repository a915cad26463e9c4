"""Queries over the colony analysis and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combline.config import Thresholds
from combline.functions.weather import describe
from combline.operators import features as ft
from combline.operators import quality as qf
from combline.operators import regions, scoring, steps, validation
from combline.operators.spatial import near_pairs
from combline.plans.analysis import Analysis
from combline.session import written
from combline.sources.readings import MEMBERS, attribute_values, readings_of, split_sides


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(_t(spark, d, "sensor_readings"))


def _weather(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "weather_readings").where("hive_id is not null and observed_date is not null")


def _cfg() -> Thresholds:
    return Thresholds(env={})


def _all(spark: SparkSession, d: str) -> Analysis:
    return Analysis(_readings(spark, d), _weather(spark, d), _t(spark, d, "hive_sites"), _cfg())


def _q(x, digits: int = 6):
    """Half up in plain floating point, so that both engines round alike."""
    return scoring.rounded(F.col(x) if isinstance(x, str) else x, digits)


def _sel(df: DataFrame, plain: list[str], doubles: list[str]) -> DataFrame:
    return df.select(*plain, *(_q(c).alias(c) for c in doubles))


# --- sources and predicates


def readings_projection(spark, d):
    return _readings(spark, d).select("colony_id", F.col("ord").alias("reading_id"), F.col("ts").alias("ts_epoch"), "wall", "w", "t", "h")


def rolling_window_filter(spark, d):
    raw = _t(spark, d, "sensor_readings").dropna(subset=["hive_id", "colony_side", "reading_id", "ts_epoch", "observed_at", "weight_kg", "internal_temp_f", "internal_humidity_pct"])
    return readings_of(ft.in_window(raw, _cfg()["window.rolling_window_days"])).select("colony_id", F.col("ord").alias("reading_id"))


def json_attribute_decode(spark, d):
    values = attribute_values(_t(spark, d, "sensor_raw"))
    return values.select("raw_id", F.inline(F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("value")) for m in MEMBERS)))).where("value is not null")


def side_split(spark, d):
    return split_sides(attribute_values(_t(spark, d, "sensor_raw").select("raw_id", "sensor_data"))).select("raw_id", "colony_side", "w", "t", "h")


def impossible_bounds(spark, d):
    r = _readings(spark, d).withColumn("reasons", F.array_join(qf.impossible_reasons(_cfg()), ", ")).where("reasons <> ''")
    return r.select(F.col("ord").alias("reading_id"), "reasons")


def external_anomalies(spark, d):
    r = _readings(spark, d).withColumn("reasons", F.array_join(qf.external_reasons(_cfg()), ", ")).where("reasons <> ''")
    return r.select(F.col("ord").alias("reading_id"), "reasons")


def adjacent_jump_flags(spark, d):
    cfg = _cfg()
    r = steps.with_previous(_readings(spark, d), cfg["quality.jumps.max_jump_interval_hours"])
    why = qf.jump_reasons({c: F.col(f"p_{c}") for c in ("wall", "w", "t", "h")}, {c: F.col(c) for c in ("wall", "w", "t", "h")}, cfg)
    return r.withColumn("reasons", F.array_join(why, ", ")).where("reasons <> ''").select(F.col("ord").alias("reading_id"), "reasons")


# --- steps


def step_candidates(spark, d):
    return _sel(steps.candidates(_readings(spark, d), _cfg()), ["colony_id", "ts", "wall"], ["before", "after", "delta", "pct", "elapsed"])


def step_classify(spark, d):
    return steps.candidates(_readings(spark, d), _cfg()).groupBy("colony_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def step_clusters(spark, d):
    c = steps.clustered(steps.candidates(_readings(spark, d), _cfg()), _cfg())
    return c.groupBy("colony_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("wall").alias("first_wall"), F.max("wall").alias("last_wall"))


def step_cluster_net(spark, d):
    return _sel(steps.net_steps(steps.candidates(_readings(spark, d), _cfg()), _cfg()), ["colony_id", "ts", "kind", "steps"], ["before", "after", "delta", "pct", "elapsed"])


def step_confirmed(spark, d):
    r, cfg = _readings(spark, d), _cfg()
    return _sel(steps.confirmed(steps.net_steps(steps.candidates(r, cfg), cfg), r, cfg), ["colony_id", "ts", "kind"], ["delta", "level"])


def step_corroborated(spark, d):
    return steps.detect(_readings(spark, d), _cfg()).select("colony_id", "ts", "kind", "corroborated")


def event_descriptions(spark, d):
    e = steps.detect(_readings(spark, d), _cfg())
    return e.select("colony_id", "ts", steps.described(e).alias("description"))


def window_replay_dedupe(spark, d):
    cfg = _cfg()
    r = written(validation.replayed(_readings(spark, d), 30, 15), "replay")
    return validation.first_seen(steps.detect(r, cfg)).select("colony_id", "wall", "kind", "first_window")


def _segmented(spark, d):
    cfg, r = _cfg(), _readings(spark, d)
    events = written(steps.detect(r, cfg), "events")
    return steps.segmented(r.where(F.size(qf.impossible_reasons(cfg)) == 0), events), cfg


def segment_ids(spark, d):
    return _segmented(spark, d)[0].select(F.col("ord").alias("reading_id"), "segment")


def _merged(spark, d):
    seg, cfg = _segmented(spark, d)
    return steps.merge_short(steps.segment_sums(seg), cfg)


def short_segment_merge(spark, d):
    return _sel(_merged(spark, d), ["colony_id", "merged", "n", "wall0", "wall1"], ["w0", "w1"])


def segment_slopes(spark, d):
    return _merged(spark, d).transform(steps.segment_slopes).select("colony_id", "merged", _q("slope", 4).alias("slope"), _q("slope_pct", 4).alias("slope_pct"))


def segmented_trend(spark, d):
    tr = steps.trend(steps.segment_slopes(_merged(spark, d)))
    return tr.select("colony_id", "segments", *(_q(c, 4).alias(c) for c in ("delta_kg", "weight_pct_change", "weight_slope_kg_per_day", "weight_slope_pct_per_day")))


# --- quality


def range_settle_semi(spark, d):
    r, cfg = _readings(spark, d), _cfg()
    return qf.settling(r, written(steps.detect(r, cfg), "events"), cfg).where("settling").select(F.col("ord").alias("reading_id"))


def quality_fold(spark, d):
    a = _all(spark, d)
    return a.judged.select(F.col("ord").alias("reading_id"), "kept", "reasons", "note_n", _q("note_kg").alias("note_kg"))


def quality_summary(spark, d):
    return qf.quality_counts(_all(spark, d).flags)


# --- weather and features


def weather_day_types(spark, d):
    return ft.day_types(_weather(spark, d), _cfg())


def weather_aggregates(spark, d):
    cols = ["avg_weather_temp_f", "avg_weather_humidity_pct", "rainy_weather_reading_pct", "cloudy_weather_reading_pct"]
    return _sel(ft.weather_shares(_weather(spark, d), _cfg()), ["hive_id"], cols)


def dominant_overview(spark, d):
    return ft.dominant_overview(_weather(spark, d))


def weather_sentences(spark, d):
    w = _weather(spark, d)
    hour = F.substring("clock_time", 1, 2).cast("int")
    words = describe(hour, F.col("temperature_f"), F.col("humidity_pct"), F.col("cloudiness_pct"), F.col("weather_code"))
    return w.select("obs_id", words.alias("sentence")).where("sentence is not null")


def weather_date_filter(spark, d):
    return ft.on_days(_weather(spark, d), _readings(spark, d)).select("obs_id")


def daily_pct_change(spark, d):
    return _sel(ft.daily_changes(_readings(spark, d), None), ["colony_id", F.col("day").cast("string").alias("day"), "n"], ["pct"])


def event_day_antijoin(spark, d):
    r, cfg = _readings(spark, d), _cfg()
    return ft.daily_changes(r, written(steps.detect(r, cfg), "events")).select("colony_id", F.col("day").cast("string").alias("day"))


def colony_first_last(spark, d):
    return _sel(ft.first_last(_readings(spark, d)), ["colony_id", "sample_count", "start_wall", "end_wall"], ["latest_weight_kg", "days_observed"])


_FLAT = ["latest_weight_kg", "weight_pct_change", "favorable_weather_weight_slope_pct_per_day", "poor_weather_weight_loss_pct"]
_COUNTS = ["sample_count", "segments", "favorable_weather_window_count", "poor_weather_window_count", "weight_event_count", "excluded_reading_count", "data_quality_issue_days"]


def features_flat(spark, d):
    f = _all(spark, d).features
    return f.select("colony_id", "region_id", *(F.col(c).cast("bigint").alias(c) for c in _COUNTS), *(_q(c, 4).alias(c) for c in _FLAT), _q("weight_slope_pct_per_day", 4).alias("weight_slope_pct_per_day"))


def run_metadata(spark, d):
    f = _all(spark, d).features
    out = f.agg(
        F.count(F.lit(1)).alias("colony_count"), F.count_distinct("region_id").alias("region_count"), F.sum("sample_count").alias("valid_sensor_reading_count"), F.sum("excluded_reading_count").alias("excluded_sensor_reading_count"),
        F.sum("weight_event_count").alias("weight_event_count"), F.count_if(F.col("weight_event_count") > 0).alias("colonies_with_weight_events"), F.min("days_observed").alias("lo"), F.max("days_observed").alias("hi"),
    )
    return out.select(*(c for c in out.columns if c not in ("lo", "hi")), _q("lo").alias("min_colony_days_observed"), _q("hi").alias("max_colony_days_observed"))


def percentiles(spark, d):
    r, cfg = _readings(spark, d), _cfg()
    q = ft.channel_report(ft.normal_movement(r, written(steps.detect(r, cfg), "events"), cfg), cfg)[0]
    return q.select("channel", "q", _q("value").alias("value"))


def threshold_rank(spark, d):
    r, cfg = _readings(spark, d), _cfg()
    t = ft.channel_report(ft.normal_movement(r, written(steps.detect(r, cfg), "events"), cfg), cfg)[1]
    return t.select("channel", "pairs", "below", "over_075", "over_100", "over_125", _q("rank_pct").alias("rank_pct"))


# --- scores


def peer_stats(spark, d):
    return _all(spark, d).comparisons.select("colony_id", "metric", "peer_count", _q("peer_mean", 4).alias("peer_mean"), _q("peer_std", 4).alias("peer_std"))


def badness_z(spark, d):
    return _all(spark, d).comparisons.select("colony_id", "metric", _q("badness_z", 4).alias("badness_z"))


def metric_confidence(spark, d):
    return _all(spark, d).comparisons.select("colony_id", "metric", _q("z_bound", 4).alias("z_bound"), "confidence")


def colony_score(spark, d):
    return _all(spark, d).scores.select("colony_id", "score", F.col("performance_flags").cast("bigint").alias("performance_flags"), F.col("low_confidence").cast("bigint").alias("low_confidence"))


def status(spark, d):
    return _all(spark, d).scores.select("colony_id", "status")


def reporting_gaps(spark, d):
    return _all(spark, d).gaps.select("colony_id", "last_wall", _q("gap_days").alias("gap_days"))


def silent_placeholders(spark, d):
    return _all(spark, d).standing.select("colony_id", "status", "silent", F.col("sample_count").cast("bigint").alias("sample_count"))


def region_summary(spark, d):
    return scoring.region_summary(_all(spark, d).scores)


def top_drivers(spark, d):
    return scoring.top_drivers(_all(spark, d).comparisons).select("colony_id", "metric", F.col("rank").cast("bigint").alias("rank"))


def sister_metrics(spark, d):
    return _all(spark, d).sisters.select("hive_id", "metric", "worse_side", _q("raw_gap", 4).alias("raw_gap"), _q("impact", 4).alias("impact"))


def sister_verdict(spark, d):
    return _all(spark, d).sister_sites


def _agreement(spark, d):
    a = _all(spark, d)
    return scoring.rank_agreement(written(scoring.rescored(a.comparisons, scoring.one_at_a_time(spark, a.cfg.metrics()), a.cfg), "rescored"))


def weight_variants(spark, d):
    a = _all(spark, d)
    return scoring.rescored(a.comparisons, scoring.one_at_a_time(spark, a.cfg.metrics()), a.cfg).select(F.col("variant").cast("bigint").alias("variant"), "region_id", "colony_id", "score", F.col("rank").cast("bigint").alias("rank"))


def kendall_tau(spark, d):
    return _agreement(spark, d).select(F.col("variant").cast("bigint").alias("variant"), "region_id", F.col("colonies").cast("bigint").alias("colonies"), F.col("max_shift").cast("bigint").alias("max_shift"), _q("tau").alias("tau"))


def dirichlet_variants(spark, d):
    a = _all(spark, d)
    out = scoring.rank_agreement(written(scoring.rescored(a.comparisons, scoring.drawn(spark, a.cfg.metrics(), 100.0, 50), a.cfg), "rescored"))
    return out.groupBy("region_id").agg(_q(F.avg("tau")).alias("mean_tau"), F.max("max_shift").alias("max_shift"))


# --- regions


def haversine_pairs(spark, d):
    return near_pairs(_t(spark, d, "hive_sites"), "hive_id", "latitude", "longitude", 10.0)


def components(spark, d):
    return _all(spark, d).regions


def nearest_region(spark, d):
    a = _all(spark, d)
    placed = a.sites.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    near = regions.nearest_region(placed, a.regions.withColumnRenamed("region_id", "component"), a.cfg["regions.min_region_site_count"])
    return near.select("component", "nearest", _q("miles", 4).alias("miles"))


def merged_regions(spark, d):
    a = _all(spark, d)
    rows = a.sites.join(a.regions, "hive_id").select("hive_id", "region_id", "latitude", "longitude").distinct().orderBy("hive_id").collect()
    merged = regions.merge_undersized([tuple(r) for r in rows], a.cfg["regions.min_region_site_count"])
    return spark.createDataFrame(sorted(merged.items()), "hive_id string, region_id string")


# --- validation


def _labels(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log made of the readings themselves: each reading whose id ends in 00 is said to be an event or, every third one, not; each month of left colonies is audited."""
    every = r.where(F.col("ord") % 100 == 0)
    records = every.select("colony_id", F.col("ord"), F.col("ts").alias("at"), F.when(F.col("ord") % 300 == 0, "non_event").otherwise("event").alias("label"), F.array(F.lit("harvest"), F.lit("swarm")).alias("kinds"))
    ranges = r.where("colony_side = 'L'").groupBy("hive_id").agg(F.min("ts").alias("start"), (F.min("ts") + 30 * 86_400).alias("end")).withColumn("side", F.lit("L"))
    return records, ranges


def _outcomes(spark, d):
    r = _readings(spark, d)
    return validation.match_events(written(steps.detect(r, _cfg()), "events"), *_labels(r), 6.0)


def greedy_match(spark, d):
    return _outcomes(spark, d).select("colony_id", "record", "detected", "kind", _q("offset_hours").alias("offset_hours"), "outcome")


def audited_ranges(spark, d):
    r = _readings(spark, d)
    return validation.audited(steps.detect(r, _cfg()), _labels(r)[1]).select("colony_id", "ts", "audited")


def precision_recall(spark, d):
    """Events of windows replayed against those of the full history as the log: counts and rates."""
    r, cfg = _readings(spark, d), _cfg()
    full = steps.detect(r, cfg).select("colony_id", "wall", F.lit(True).alias("full"))
    seen = validation.first_seen(steps.detect(written(validation.replayed(r, 30, 15), "replay"), cfg)).select("colony_id", "wall", F.lit(True).alias("seen"))
    both = full.join(seen, ["colony_id", "wall"], "full_outer")
    outcome = F.when(F.col("full") & F.col("seen"), "true_positive").when(F.col("full"), "false_negative").otherwise("false_positive")
    out = validation.rates(both.select(outcome.alias("outcome")))
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in ("true_positive", "false_negative", "false_positive")), *(_q(c).alias(c) for c in ("precision", "recall", "f1")))


_NAMES = """readings_projection rolling_window_filter json_attribute_decode side_split impossible_bounds external_anomalies adjacent_jump_flags
step_candidates step_classify step_clusters step_cluster_net step_confirmed step_corroborated event_descriptions window_replay_dedupe segment_ids short_segment_merge segment_slopes
segmented_trend range_settle_semi quality_fold quality_summary weather_day_types weather_aggregates dominant_overview weather_sentences weather_date_filter daily_pct_change event_day_antijoin
colony_first_last features_flat run_metadata percentiles threshold_rank peer_stats badness_z metric_confidence colony_score status reporting_gaps silent_placeholders
region_summary top_drivers sister_metrics sister_verdict weight_variants kendall_tau dirichlet_variants haversine_pairs components nearest_region merged_regions
greedy_match audited_ranges precision_recall""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

from combline.queries.colony_sql import SQL  # noqa: E402, F401
