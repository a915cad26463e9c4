import pytest
from helpers import START, frame, readings

from combline.config import Thresholds
from combline.operators import features as ft
from combline.operators import scoring

CFG = Thresholds(env={})
NAMES = "colony_id region_id latest_weight_kg weight_pct_change weight_slope_pct_per_day favorable_weather_weight_slope_pct_per_day poor_weather_weight_loss_pct favorable_weather_window_count poor_weather_window_count excluded_reading_count data_quality_issue_days".split()
#: Six colonies' measures, and below the scores they must come to.
SIX = [
    ("PRT_1:L", "r1", 22.490818, -10.759086787182884, -1.3816825297290691, -1.3817658363522625, 0.0, 8, 0, 0, 0),
    ("WTG_HSCHL:R", "r1", 23.73251, -6.041248306975004, -1.3043531285098335, -1.1973874551642656, 0.0, 7, 0, 0, 0),
    ("PRT_1:R", "r1", 27.10967, -4.133281468253266, -0.6488227749795962, -0.5805090833213191, 0.0, 8, 0, 0, 0),
    ("WTG_HSCHL:L", "r1", 27.562208, -4.770172620639644, -0.1633130707800777, -0.5723172741868149, 0.0, 8, 0, 0, 0),
    ("6LR:L", "r1", 49.20807, -4.191461821886098, -0.32110912919566886, -0.5131323063184511, 0.24123673281594635, 7, 1, 0, 0),
    ("6LR:R", "r1", 46.07139, -1.3216333636334798, -0.2874037060447054, -0.5806668247041085, 0.0, 7, 1, 0, 0),
]
SCORES = {"PRT_1:L": (47.7, "underperforming"), "WTG_HSCHL:R": (27.2, "underperforming"), "PRT_1:R": (8.7, "normal"), "WTG_HSCHL:L": (8.0, "normal"), "6LR:L": (2.1, "watch"), "6LR:R": (0.0, "normal")}


def wide(spark, rows):
    from pyspark.sql import functions as F

    kinds = ["string", "string"] + ["double"] * 5 + ["long"] * 4
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))
    side = F.split("colony_id", ":")
    return df.withColumns({"hive_id": side[0], "colony_side": side[1], "sample_count": F.lit(10).cast("long")})


def colony(name, region="r1", weight=10.0, pct=0.0, fav=1, poor=1, slope=0.0, favs=0.0, excluded=0, days=0):
    return (name, region, weight, pct, slope, favs, 0.0, fav, poor, excluded, days)


def scored(spark, rows, cfg=CFG):
    f = wide(spark, rows)
    c = scoring.comparisons(f, cfg.metrics(), cfg)
    return f, c, scoring.scores(f, c, cfg)


def test_six_known_scores(spark):
    _, _, s = scored(spark, SIX)
    assert {r.colony_id: (r.score, r.status) for r in s.collect()} == SCORES


def test_known_sister_scores(spark):
    f, c, _ = scored(spark, SIX)
    got = {r.hive_id: (r.left_score, r.right_score, r.weaker_side, r.verdict) for r in scoring.sister_sites(f, scoring.sister_metrics(f, c, CFG.metrics(), CFG), CFG).collect()}
    assert got == {"6LR": (13.7, 5.2, "L", "mildly weaker"), "PRT_1": (42.5, 0.0, "L", "notably weaker"), "WTG_HSCHL": (0.0, 26.8, "R", "notably weaker")}


def test_peers_are_of_the_region(spark):
    _, c, _ = scored(spark, [colony("A:L", "a", 10.0), colony("B:L", "a", 20.0), colony("C:L", "b", 100.0), colony("D:L", "b", 110.0)])
    assert {r.region_id: r.peer_mean for r in c.where("metric = 'latest_weight_kg'").collect()} == {"a": 15.0, "b": 105.0}


def test_confidence_of_small_pools(spark):
    _, c, _ = scored(spark, [colony("A:L", weight=10.0, favs=-2.0), colony("B:L", weight=20.0, favs=3.0), colony("C:L", weight=30.0, fav=0), colony("D:L", weight=40.0, fav=0)])
    got = {(r.colony_id, r.metric): (r.peer_count, r.z_bound, r.confidence) for r in c.collect()}
    assert got["A:L", "favorable_weather_weight_slope_pct_per_day"] == (2, 1.0, "low")
    assert got["A:L", "latest_weight_kg"][::2] == (4, "normal") and ("C:L", "favorable_weather_weight_slope_pct_per_day") not in got
    _, c, _ = scored(spark, [colony("A:L", weight=1.0), colony("B:L", weight=1.0), colony("C:L", weight=100.0)])
    r = c.where("colony_id = 'C:L' and metric = 'latest_weight_kg'").first()
    assert r.z_bound == pytest.approx(2**0.5) and r.confidence == "low"


@pytest.mark.parametrize(("days", "window", "material"), [(2, 7, False), (3, 7, True), (9, 30, False), (10, 30, True), (5, 0, False)])
def test_share_of_faulty_days(spark, days, window, material):
    from pyspark.sql import functions as F

    assert spark.range(1).select(scoring.issue_days_material(F.lit(days), F.lit(float(window)), CFG).alias("x")).first().x == material


def test_faulty_days_make_a_watch(spark):
    _, _, s = scored(spark, [colony("A:L", days=2, excluded=1), colony("B:L", days=3, excluded=1)])
    assert {r.colony_id: r.status for r in s.collect()} == {"A:L": "normal", "B:L": "watch"}


def test_gaps_and_placeholders(spark):
    r = frame(spark, readings([40.0] * 100, hive="NOW"), readings([40.0] * 80, hive="LATE"), readings([40.0] * 28, hive="OLD"))
    colonies = spark.createDataFrame([(h, "L", "r1") for h in ("NOW", "LATE", "OLD", "NEVER")], "hive_id string, colony_side string, region_id string")
    gaps = scoring.reporting_gaps(r, colonies, CFG)
    assert {g.colony_id: g.gap_days for g in gaps.collect()} == {"OLD:L": 3.0, "NEVER:L": None}
    _, _, s = scored(spark, [colony("NOW:L"), colony("LATE:L"), colony("OLD:L")])
    got = {x.colony_id: (x.status, x.silent) for x in scoring.with_gaps(s, gaps).collect()}
    assert got == {"NOW:L": ("normal", False), "LATE:L": ("normal", False), "OLD:L": ("underperforming", True), "NEVER:L": ("underperforming", True)}


def test_decline_of_the_stronger_side_is_named(spark):
    f, c, _ = scored(spark, [colony("S:L", weight=50.0, pct=-4.0), colony("S:R", weight=20.0, pct=-1.0), colony("T:L", weight=50.0, pct=0.0), colony("T:R", weight=20.0, pct=0.0)])
    site = {r.hive_id: r for r in scoring.sister_sites(f, scoring.sister_metrics(f, c, CFG.metrics(), CFG), CFG).collect()}["S"]
    assert (site.weaker_side, site.declining_side) == ("R", "L")


def test_one_side_only_is_incomplete(spark):
    f, c, _ = scored(spark, [colony("S:L"), colony("T:L")])
    assert {r.verdict for r in scoring.sister_sites(f, scoring.sister_metrics(f, c, CFG.metrics(), CFG), CFG).collect()} == {"incomplete"}


def test_unchanged_weights_give_the_same_ranks(spark):
    _, c, s = scored(spark, SIX)
    v = scoring.rescored(c, scoring.one_at_a_time(spark, CFG.metrics()), CFG)
    assert {r.colony_id: r.score for r in v.where("variant = 0").collect()} == {k: x[0] for k, x in SCORES.items()}
    agree = scoring.rank_agreement(v).collect()
    assert len(agree) == 21 and {r.tau for r in agree if r.variant == 0} == {1.0} and all(-1 <= r.tau <= 1 for r in agree)


def test_daily_changes_by_day_type(spark):
    weights = [100.0] * 23 + [101.0] + [101.0] * 24 + [101.0] * 23 + [100.0]
    r = frame(spark, readings(weights))
    rows = [("H1", d, 1, 70.0, 10.0, 50.0) for d in ("2026-06-01", "2026-06-03")] + [("H1", "2026-06-02", 1, 70.0, 80.0, 50.0), ("H1", "2026-06-04", 61, 70.0, 10.0, 50.0), ("H1", "2026-06-05", None, None, None, None)]
    from pyspark.sql import functions as F

    w = spark.createDataFrame(rows, "hive_id string, observed_date string, weather_code int, temperature_f double, cloudiness_pct double, humidity_pct double").withColumn("observed_date", F.col("observed_date").cast("date"))
    types = ft.day_types(w, CFG)
    assert {str(x.observed_date): x.day_type for x in types.collect()} == {"2026-06-01": "favorable", "2026-06-02": "neutral", "2026-06-03": "favorable", "2026-06-04": "poor", "2026-06-05": "neutral"}
    changes = {str(x.day): round(x.pct, 6) for x in ft.daily_changes(r, None).collect()}
    assert changes["2026-06-01"] == 1.0 and changes["2026-06-03"] == -0.990099
    got = ft.weather_windows(ft.daily_changes(r, None), types).first()
    assert got.favorable_weather_window_count == 2 and got.poor_weather_window_count == 0


def test_dominant_text_and_empty_weather(spark):
    w = spark.createDataFrame([("H", "b", 1), ("H", "a", 2), ("H", "a", 3), ("H", "b", 4), ("H", "", 5), ("H", None, 6)], "hive_id string, overview string, obs_id long")
    assert ft.dominant_overview(w).first().dominant_weather_overview == "b"
    assert ft.dominant_overview(w.limit(0)).collect() == []


def _analysis(spark):
    """An analysis of two sites whose weather has no texts."""
    from combline.plans.analysis import Analysis

    r = frame(spark, *(readings([30.0 + k] * 30, hive=h, side=s, drift=0.02 * k) for k, (h, s) in enumerate((h, s) for h in ("H1", "H2") for s in "LR")))
    weather = spark.createDataFrame([("H1", START.date(), 1, 75.0, 10.0, 50.0)], "hive_id string, observed_date date, weather_code int, temperature_f double, cloudiness_pct double, humidity_pct double")
    sites = spark.createDataFrame([("H1", 40.0, -80.0), ("H2", 40.01, -80.0)], "hive_id string, latitude double, longitude double")
    return Analysis(r, weather, sites, CFG)


def test_statuses_need_no_texts_of_the_weather(spark):
    got = {r.colony_id: (r.region_id, r.status, r.favorable_weather_window_count) for r in _analysis(spark).scores.collect()}
    assert set(got) == {"H1:L", "H1:R", "H2:L", "H2:R"} and {v[0] for v in got.values()} == {"H1"}
    assert got["H1:L"][2] == 1 and got["H2:L"][2] == 0


def test_z_needs_no_flags(spark):
    a = _analysis(spark)
    assert a.comparisons.where("metric = 'latest_weight_kg'").count() == 4
    assert not {"flags", "features"} & set(vars(a))


def test_sisters_need_no_flags(spark):
    a = _analysis(spark)
    worse = {(r.hive_id, r.worse_side) for r in a.sisters.where("metric = 'latest_weight_kg'").collect()}
    assert worse == {("H1", "L"), ("H2", "L")} and not {"flags", "features"} & set(vars(a))


def test_changed_weights_need_no_flags(spark):
    a = _analysis(spark)
    got = scoring.rescored(a.comparisons, scoring.one_at_a_time(spark, a.cfg.metrics()), a.cfg)
    assert got.groupBy("variant").count().where("count = 4").count() == 1 + 4 * len(a.cfg.metrics())
    assert not {"flags", "features"} & set(vars(a))
