"""Peer comparison: every metric of a colony against its region, weighted into one score, with what stands out as flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combline.config import Metric, Thresholds


def comparisons(features: DataFrame, metrics: list[Metric], cfg: Thresholds) -> DataFrame:
    """Long table: a row per colony and metric with the region's mean, deviation and number of peers (the colony included).

    A metric with a gate is compared among colonies whose gate count is at least 1; pools below the least number of peers
    give no row. z is turned so that more is worse; without spread it is 0. confidence is low where the pool is so small
    that z carries only its sign, or z lies at the bound that the pool's size sets.
    """
    cells = F.array(*(
        F.struct(F.lit(k).alias("ord"), F.lit(m.name).alias("metric"), F.lit(m.weight).alias("weight"), F.lit(1.0 if m.higher_is_better else -1.0).alias("sign"),
                 (F.lit(True) if m.gate is None else F.col(m.gate) >= 1).alias("ok"), F.col(m.name).cast("double").alias("value"))
        for k, m in enumerate(metrics)
    ))
    long = features.select("region_id", "colony_id", "hive_id", "colony_side", F.inline(cells)).where("ok").drop("ok")
    # sums are combined before they meet, so a region with most of the colonies never lies in one task
    pool = long.groupBy("region_id", "metric").agg(F.count(F.lit(1)).alias("peer_count"), F.avg("value").alias("peer_mean"), F.stddev_pop("value").alias("peer_std"))
    long = long.join(pool.where(F.col("peer_count") >= cfg["scoring.min_peer_count"]), ["region_id", "metric"])
    # nine digits: of two peers z is 1 in exact arithmetic, and a last bit must decide neither flags nor ranks
    z = F.when(F.col("peer_std") < 1e-6, F.lit(0.0)).otherwise(rounded((F.col("peer_mean") - F.col("value")) / F.col("peer_std") * F.col("sign"), 9))
    bound = F.sqrt(F.col("peer_count") - 1)
    low = (F.col("peer_count") <= 2) | ((F.col("peer_std") > 0) & (F.col("z_bound") > 0) & (F.abs("badness_z") >= 0.999 * F.col("z_bound")))
    return long.withColumns({"badness_z": z, "z_bound": bound}).withColumn("confidence", F.when(low, "low").otherwise("normal")).drop("sign")


def rounded(x, digits: int):
    """Half up in plain floating point."""
    return F.floor(x * float(10**digits) + F.lit(0.5)).cast("double") / float(10**digits)


def weighted_score(raw, weight, cfg: Thresholds):
    """The weighted mean z scaled to 0..100, to one digit; six digits first, so that sums in another order round alike."""
    return rounded(rounded(F.least(F.lit(100.0), raw / F.greatest(weight, F.lit(0.001)) * cfg["scoring.badness_z_score_scale"]), 6), 1)


def scores(features: DataFrame, compared: DataFrame, cfg: Thresholds) -> DataFrame:
    """A row per colony of features: score, counts of flags by class, and the status that follows from them."""
    at = F.col("badness_z") >= cfg["status.zscore_badness_threshold"]
    per = compared.groupBy("colony_id").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("badness_z")) * F.col("weight")).alias("_raw"), F.sum("weight").alias("_w"), F.count_if(at).alias("metric_flags"), F.count_if(F.col("confidence") == "low").alias("low_confidence")
    )
    f = features.join(per, "colony_id", "left").fillna(0, ["metric_flags", "low_confidence"]).fillna(0.0, ["_raw", "_w"])
    score = weighted_score(F.col("_raw"), F.col("_w"), cfg)
    drop = (F.col("weight_pct_change") <= -cfg["status.weight_drop_pct_threshold"]).cast("int")
    f = f.withColumns({"score": score, "drop_flags": drop}).withColumn("performance_flags", F.col("drop_flags") + F.col("metric_flags"))
    faulty = ((F.col("excluded_reading_count") > 0) | (F.col("data_quality_issue_days") > 0)) & issue_days_material(F.col("data_quality_issue_days"), F.lit(float(cfg["window.rolling_window_days"])), cfg)
    status = (
        F.when((F.col("score") >= cfg["status.underperforming_score"]) | (F.col("performance_flags") >= cfg["status.underperforming_flag_count"]), "underperforming")
        .when((F.col("score") >= cfg["status.watch_score"]) | (F.col("performance_flags") > 0) | faulty, "watch")
        .otherwise("normal")
    )
    return f.withColumn("status", status).drop("_raw", "_w")


def issue_days_material(days, window_days, cfg: Thresholds):
    """Whether days with faults make up more than the given share of the window; never in an empty window."""
    return (window_days > 0) & (days > window_days * cfg["status.quality_issue_day_share_threshold"])


def reporting_gaps(readings: DataFrame, colonies: DataFrame, cfg: Thresholds) -> DataFrame:
    """Colonies (hive_id, colony_side, region_id) whose last reading is older than the limit against the newest of all, or that never reported.

    Result: colonies' columns, colony_id, last_wall, gap_days (both null for a colony never seen).
    """
    last = readings.groupBy("colony_id").agg(F.max("wall").alias("last_wall"))
    newest = last.agg(F.max("last_wall").alias("m")).first()["m"]
    all_ = colonies.withColumn("colony_id", F.concat_ws(":", "hive_id", "colony_side")).join(last, "colony_id", "left")
    gap = (F.lit(newest).cast("bigint") - F.col("last_wall")) / 86400.0
    return all_.withColumn("gap_days", gap).where(F.col("gap_days").isNull() | (F.col("gap_days") > cfg["status.max_reporting_gap_days"]))


def with_gaps(scored: DataFrame, gaps: DataFrame) -> DataFrame:
    """scored with reporting_gap_days and the status that silence forces, and a row with no samples for each silent colony that has none."""
    late = gaps.select("colony_id", F.lit(True).alias("_late"), F.col("gap_days").alias("reporting_gap_days"))
    seen = scored.join(late, "colony_id", "left").withColumn("status", F.when(F.col("_late"), "underperforming").otherwise(F.col("status"))).withColumn("silent", F.coalesce("_late", F.lit(False))).drop("_late")
    missing = gaps.join(scored.select("colony_id"), "colony_id", "left_anti").select(
        "colony_id", "hive_id", "colony_side", "region_id", F.lit(0).cast("bigint").alias("sample_count"), F.lit(0.0).alias("score"), F.lit("underperforming").alias("status"), F.col("gap_days").alias("reporting_gap_days"), F.lit(True).alias("silent")
    )
    return seen.unionByName(missing, allowMissingColumns=True)


def region_summary(scored: DataFrame) -> DataFrame:
    """Per region: sites, colonies by status, and the two best of the normal ones (first the best of each part of a region)."""
    best = scored.where("status = 'normal'").withColumn("_part", F.pmod(F.xxhash64("colony_id"), F.lit(64)))
    for by in (["region_id", "_part"], ["region_id"]):
        best = best.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("score", "colony_id"))).where("_k <= 2")
    top = best.groupBy("region_id").agg(F.max(F.when(F.col("_k") == 1, F.col("colony_id"))).alias("best_1"), F.max(F.when(F.col("_k") == 2, F.col("colony_id"))).alias("best_2"))
    g = scored.groupBy("region_id").agg(
        F.count_distinct("hive_id").alias("site_count"), F.count(F.lit(1)).alias("colony_count"), *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("normal", "watch", "underperforming"))
    )
    return g.join(top, "region_id", "left")


def top_drivers(compared: DataFrame, k: int = 3) -> DataFrame:
    """The k metrics of each colony with the largest z above 0; equal ones in the catalog's order."""
    w = Window.partitionBy("colony_id").orderBy(F.col("badness_z").desc(), "ord")
    return compared.where("badness_z > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sister_metrics(features: DataFrame, compared: DataFrame, metrics: list[Metric], cfg: Thresholds) -> DataFrame:
    """hive_id, metric, left, right, worse_side, raw_gap, impact: the two colonies of a site in every metric that both have."""
    side = lambda s: compared.where(F.col("colony_side") == s).select("hive_id", "metric", "ord", "weight", F.col("value").alias(f"v_{s}"), F.col("peer_std").alias(f"s_{s}"))
    both = side("L").join(side("R").drop("ord", "weight"), ["hive_id", "metric"])
    up = [m.name for m in metrics if m.higher_is_better]
    gap = F.when(F.col("metric").isin(up), F.col("v_R") - F.col("v_L")).otherwise(F.col("v_L") - F.col("v_R"))
    spread = F.when((F.col("s_L") > 0) & (F.col("s_R") > 0), (F.col("s_L") + F.col("s_R")) / 2).otherwise(F.greatest("s_L", "s_R"))
    norm = F.when(spread > 0, F.abs(gap) / spread).otherwise(0.0)
    return both.select(
        "hive_id", "metric", "ord", F.col("v_L").alias("left_value"), F.col("v_R").alias("right_value"), F.when(gap > 0, "L").when(gap < 0, "R").alias("worse_side"), F.abs(gap).alias("raw_gap"),
        F.least(F.lit(100.0), norm * F.col("weight") * cfg["scoring.badness_z_score_scale"]).alias("impact"),
    )


#: Metrics that are movements of the weight.
TRENDS = ["weight_pct_change", "weight_slope_pct_per_day", "favorable_weather_weight_slope_pct_per_day", "poor_weather_weight_loss_pct"]


def sister_sites(features: DataFrame, sisters: DataFrame, cfg: Thresholds) -> DataFrame:
    """A row per site with a reporting colony: both sides' sums of impact, the weaker side, and the side whose decline stands out."""
    sides = features.where("sample_count > 0").groupBy("hive_id").agg(F.count_distinct("colony_side").alias("sides"))
    sums = sisters.groupBy("hive_id").agg(*(F.sum(F.when(F.col("worse_side") == s, F.col("impact")).otherwise(0.0)).alias(f"_{s}") for s in "LR"))
    out = sides.join(sums, "hive_id", "left").fillna(0.0, ["_L", "_R"]).withColumns({"left_score": rounded(F.col("_L"), 1), "right_score": rounded(F.col("_R"), 1)})
    gap = F.abs(F.col("left_score") - F.col("right_score"))
    alike = gap < cfg["sister.similar_gap"]
    weaker = F.when((F.col("sides") < 2) | alike, F.lit(None).cast("string")).when(F.col("left_score") > F.col("right_score"), "L").otherwise("R")
    notable = (F.greatest("left_score", "right_score") >= cfg["sister.notable_score"]) | (gap >= cfg["sister.notable_gap"])
    out = out.withColumn("weaker_side", weaker).withColumn("verdict", F.when(F.col("sides") < 2, "incomplete").when(alike, "similar").when(notable, "notably weaker").otherwise("mildly weaker"))
    bad = F.when(F.col("worse_side") == "L", F.col("left_value")).otherwise(F.col("right_value"))
    falling = F.when(F.col("metric") == "poor_weather_weight_loss_pct", bad > 0).otherwise(bad < 0)
    concern = sisters.join(out.select("hive_id", "weaker_side"), "hive_id").where(
        F.col("metric").isin(TRENDS) & F.col("worse_side").isNotNull() & (F.col("weaker_side").isNull() | (F.col("worse_side") != F.col("weaker_side"))) & (F.col("impact") >= cfg["sister.significant_weight_trend_impact"]) & falling
    )
    first = concern.groupBy("hive_id").agg(F.min(F.struct((-F.col("impact")).alias("i"), "ord", "worse_side")).alias("c")).select("hive_id", F.col("c.worse_side").alias("declining_side"))
    return out.join(first, "hive_id", "left").select("hive_id", "left_score", "right_score", "weaker_side", "verdict", "declining_side")


def rescored(compared: DataFrame, variants: DataFrame, cfg: Thresholds) -> DataFrame:
    """variant, region_id, colony_id, score, rank for every variant (variant, metric, variant_weight); z does not depend on weights, so one job scores them all."""
    j = compared.join(F.broadcast(variants), "metric")
    raw, w = F.sum(F.greatest(F.lit(0.0), F.col("badness_z")) * F.col("variant_weight")), F.sum("variant_weight")
    s = j.groupBy("variant", "region_id", "colony_id").agg(weighted_score(raw, w, cfg).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("variant", "region_id").orderBy(F.col("score").desc(), "colony_id")))


def one_at_a_time(spark, metrics: list[Metric], factors: tuple[float, ...] = (0.5, 0.75, 1.25, 1.5)) -> DataFrame:
    """Weight vectors in which one metric's weight is multiplied; variant 0 is the catalog's own. A handful of rows."""
    rows = [(0, m.name, m.weight) for m in metrics]
    for k, (i, f) in enumerate(((i, f) for i in range(len(metrics)) for f in factors), 1):
        rows += [(k, m.name, m.weight * (f if i == at else 1.0)) for at, m in enumerate(metrics)]
    return spark.createDataFrame(rows, "variant int, metric string, variant_weight double")


def drawn(spark, metrics: list[Metric], concentration: float, draws: int = 500, seed: int = 20260727) -> DataFrame:
    """Weight vectors drawn around the catalog's own, the tighter the larger the concentration; variant 0 is the catalog's own."""
    import random

    rng = random.Random(seed + int(concentration))
    rows = [(0, m.name, m.weight) for m in metrics]
    for k in range(1, draws + 1):
        g = [rng.gammavariate(concentration * m.weight, 1.0) for m in metrics]
        rows += [(k, m.name, x / sum(g)) for m, x in zip(metrics, g)]
    return spark.createDataFrame(rows, "variant int, metric string, variant_weight double")


def rank_agreement(ranked: DataFrame, buckets: int = 16) -> DataFrame:
    """variant, region_id, colonies, max_shift, tau: each variant's ranks against those of variant 0. tau is 1 for fewer than two colonies.

    Pairs of colonies are compared rank by rank within (variant, region); a region is dealt to buckets of the first one's
    rank, so a large region is spread.
    """
    base = ranked.where("variant = 0").select("region_id", "colony_id", F.col("rank").alias("r0"))
    j = ranked.join(base, ["region_id", "colony_id"]).select("variant", "region_id", "colony_id", "rank", "r0")
    a = j.select("variant", "region_id", F.col("rank").alias("ra"), F.col("r0").alias("r0a"), F.pmod("r0", F.lit(buckets)).alias("_b"))
    b = j.select("variant", "region_id", F.col("rank").alias("rb"), F.col("r0").alias("r0b"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    sign = a.join(b, ["variant", "region_id", "_b"]).where("r0a < r0b").groupBy("variant", "region_id").agg(F.sum(F.signum((F.col("rb") - F.col("ra")).cast("double"))).alias("s"))
    n = j.groupBy("variant", "region_id").agg(F.count(F.lit(1)).alias("colonies"), F.max(F.abs(F.col("rank") - F.col("r0"))).alias("max_shift"))
    tau = F.when(F.col("colonies") < 2, 1.0).otherwise(F.col("s") * 2 / (F.col("colonies") * (F.col("colonies") - 1)))
    return n.join(sign, ["variant", "region_id"], "left").select("variant", "region_id", "colonies", "max_shift", tau.alias("tau"))
