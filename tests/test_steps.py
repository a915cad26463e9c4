from helpers import frame, readings

from combline.config import Thresholds
from combline.operators import quality, steps

CFG = Thresholds(env={})


def kinds(spark, *parts):
    return sorted((r.colony_id, r.kind) for r in steps.detect(frame(spark, *parts), CFG).collect())


def trend(spark, *parts):
    r = frame(spark, *parts)
    events = steps.detect(r, CFG)
    merged = steps.merge_short(steps.segment_sums(steps.segmented(r, events)), CFG)
    return steps.trend(steps.segment_slopes(merged)).first()


HARVEST = [40.0] * 48 + [30.0] * 48


def test_harvest_opens_a_segment_and_leaves_the_trend_alone(spark):
    part = readings(HARVEST, drift=0.02, wobble=0.05)
    assert kinds(spark, part) == [("H1:L", "harvest")]
    t = trend(spark, part)
    assert t.segments == 2 and 0 < t.delta_kg < 3 and t.weight_slope_kg_per_day > 0


def test_addition_and_swarm(spark):
    assert kinds(spark, readings([25.0] * 30 + [36.0] * 30)) == [("H1:L", "addition")]
    assert kinds(spark, readings([40.0] * 30 + [31.0] * 30, temps=[94.0] * 30 + [78.0] * 30)) == [("H1:L", "swarm")]


def test_quiet_week_dip_dropout_and_small_gain_are_no_events(spark):
    week = readings([40.0] * 168, drift=0.03)
    assert kinds(spark, week) == [] and trend(spark, week).segments == 1
    assert kinds(spark, readings([40.0] * 40 + [30.0] + [40.0] * 40)) == []
    assert kinds(spark, readings([40.0] * 40 + [0.0] + [40.0] * 40)) == []
    assert kinds(spark, readings([23.5] * 20 + [26.2] * 30)) == []


def test_step_across_a_dropout_is_not_seen(spark):
    assert kinds(spark, readings([40.0] * 24 + [0.0] + [30.0] * 24)) == []


def test_drop_that_settles_is_one_event_and_a_short_tail_no_segment(spark):
    part = readings([47.0] * 30 + [32.0] + [35.0] * 40)
    assert kinds(spark, part) == [("H1:L", "harvest")] and trend(spark, part).segments == 2
    tail = readings([40.0] * 48 + [30.0] * 10)
    assert kinds(spark, tail) == [("H1:L", "harvest")] and trend(spark, tail).segments == 1


def test_corroboration(spark):
    def told(*parts):
        return sorted((r.colony_id, r.corroborated) for r in steps.detect(frame(spark, *parts), CFG).collect())

    flat = [30.0] * 60
    up, up5, down = ([30.0] * 30 + [x] * 30 for x in (36.0, 35.0, 24.0))
    assert told(readings(up), readings(up5, side="R")) == [("H1:L", True), ("H1:R", True)]
    assert told(readings(down), readings(up, side="R")) == [("H1:L", True), ("H1:R", True)]
    assert told(readings(up), readings(flat, side="R")) == [("H1:L", False)]
    assert told(readings(up)) == [("H1:L", False)]
    late = [30.0] * 80 + [36.0] * 30
    assert told(readings(up + [36.0] * 50), readings(late, side="R")) == [("H1:L", False), ("H1:R", False)]


def test_description(spark):
    e = steps.detect(frame(spark, readings([25.0] * 30 + [36.0] * 30)), CFG)
    text = e.select(steps.described(e).alias("d")).first().d
    assert text.startswith("Likely addition: weight gained 11.0 kg (+44.0%) around 2026-06-02T06:00:00")


def test_empty(spark):
    r = frame(spark)
    assert steps.detect(r, CFG).collect() == []
    assert quality.judged(r, steps.detect(r, CFG), CFG).collect() == []
