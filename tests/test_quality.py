import random

import pyarrow as pa
from helpers import frame, readings
from pyspark.sql import functions as F

from combline.config import Thresholds
from combline.operators import features, quality, steps
from combline.session import written

CFG = Thresholds(env={})


def judge(spark, *parts):
    r = frame(spark, *parts)
    return {(x.colony_id, x.ord): x for x in quality.judged(r, steps.detect(r, CFG), CFG).collect()}


def plain(rows, events):
    """The same rules one reading after another."""
    out, anchor, pending = {}, None, []

    def jump(a, b):
        hours = (b[5] - a[5]) / 3600
        if not 0 < hours <= 6:
            return False
        dw = abs(b[7] - a[7])
        return (dw > 3.63 and a[7] and dw / a[7] * 100 > 12) or abs(b[8] - a[8]) > 25 or abs(b[9] - a[9]) > 45

    def flush():
        for p in pending:
            out[p[0], p[3]] = False
        pending.clear()

    for r in rows:
        if not (0.45 <= r[7] <= 136.08 and 32 <= r[8] <= 120 and 0 <= r[9] <= 100):
            flush()
            out[r[0], r[3]] = False
        elif anchor is None or any(0 <= r[5] - e <= 3 * 3600 for e in events) or not jump(anchor, r):
            flush()
            out[r[0], r[3]] = True
            anchor = r
        else:
            if pending and jump(pending[-1], r):
                flush()
            pending.append(r)
            if len(pending) == 3:
                for p in pending:
                    out[p[0], p[3]] = True
                anchor = r
                pending.clear()
    flush()
    return out


def test_impossible_values_and_single_spikes_go(spark):
    got = judge(spark, readings([40.0] * 10 + [200.0] + [40.0] * 5 + [50.0] + [40.0] * 5))
    bad = {k[1]: v.reasons for k, v in got.items() if not v.kept}
    assert bad == {10: "weight", 16: "weight"}


def test_a_shift_that_stays_is_let_back_in(spark):
    temps = [94.0] * 10 + [60.0] * 20
    got = judge(spark, readings([40.0] * 30, temps=temps))
    assert all(v.kept for v in got.values())
    first = got["H1:L", 10]
    assert first.note_n == 3 and first.note_kg == 0.0


def test_readings_after_an_event_are_kept(spark):
    weights = [30.0] * 20 + [37.0] * 30
    temps = [94.0] * 20 + [60.0] * 6 + [94.0] * 24
    assert all(v.kept for v in judge(spark, readings(weights, temps=temps)).values())


def test_events_pass_with_their_excursion(spark):
    got = judge(spark, readings([30.0] * 20 + [36.0] * 20, temps=[92.0] * 20 + [62.0] + [92.0] * 19))
    assert all(v.kept for v in got.values())


def test_against_the_rules_one_after_another(spark):
    rng = random.Random(5)
    parts = []
    for side in "LR":
        w, t, hours, at = [], [], [], 0.0
        for _ in range(900):
            at += rng.choice([0.5, 1, 1, 1, 2, 7])
            hours.append(at)
            w.append(40 + rng.choice([0] * 12 + [8, -9, 15, 120]) + rng.random())
            t.append(94 + rng.choice([0] * 9 + [-30, 28, -70]))
        parts.append(readings(w, side=side, temps=t, hours=hours))
    r = frame(spark, *parts)
    events = steps.detect(r, CFG)
    at = {}
    for e in events.collect():
        at.setdefault(e.colony_id, []).append(e.wall)
    got = {(x.colony_id, x.ord): x.kept for x in quality.judged(r, events, CFG).collect()}
    want = {}
    for p in parts:
        want |= plain(p, at.get(p[0][0], []))
    assert got == want and not all(want.values())


def test_flags_by_day(spark):
    r = frame(spark, readings([40.0] * 10 + [200.0] + [40.0] * 50, et=200.0))
    flags = quality.quality_flags(quality.judged(r, steps.detect(r, CFG), CFG), CFG)
    row = quality.quality_counts(flags).first()
    assert (row.excluded, row.issues, row.issue_days) == (1, 61, 3)


def _hard(spark):
    rng, rows = random.Random(7), []
    for hive, side, n in (("H1", "L", 900), ("H1", "R", 700), ("H2", "L", 300)):
        w, weights, hours = 40.0, [], []
        for i in range(n):
            w += rng.choice([0, 0, 0, 0, 0, 0.2, -0.2, 4.5, -4.0]) if rng.random() < 0.2 else 0
            weights.append(200.0 if rng.random() < 0.02 else w + (9 if rng.random() < 0.03 else 0))
            hours.append((hours[-1] if hours else 0) + rng.choice([0, 1, 1, 1, 2, 2, 7 if rng.random() < 0.2 else 1]))
        rows.append(readings(weights, hive=hive, side=side, hours=hours, et=70.0 if side == "L" else 140.0))
    return frame(spark, *rows)


def test_readings_in_order_once_say_the_same(spark):
    r = _hard(spark)
    p = written(quality.prepared(r, CFG), "prepared")
    assert dict(p.dtypes)["seq"] == "bigint"
    by = lambda d: [tuple(x) for x in d.orderBy("colony_id", "seq").select("colony_id", "ord").collect()]
    assert by(p) == by(r)
    plans = steps.candidates(p, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plans and "Sort" not in plans
    key = lambda e: sorted((x.colony_id, x.ts, x.kind, round(x.delta, 9), x.corroborated) for x in e.collect())
    events = written(steps.detect(p, CFG), "events")
    assert key(events) == key(steps.detect(r, CFG)) and events.count() > 5
    say = lambda d: sorted((x.colony_id, x.ord, x.kept, x.reasons, x.note_n) for x in d.collect())
    assert say(quality.judged(p, events, CFG)) == say(quality.judged(r, events, CFG))


def test_segments_and_days_from_one_pass(spark):
    r = _hard(spark)
    p = written(quality.prepared(r, CFG), "prepared")
    events = written(steps.detect(p, CFG), "events")
    days = steps.day_sums(p, events)
    row = lambda d: sorted((x.colony_id, x.segment, x.n, x.w0, x.w1, x.wall0, x.wall1, round(x.sx, 6), round(x.sxw, 4)) for x in d.collect())
    assert row(steps.segment_sums_of_days(days, events)) == row(steps.segment_sums(steps.segmented(p, events)))
    ends = lambda d: sorted((x.colony_id, x.sample_count, x.start_wall, x.end_wall, x.latest_weight_kg) for x in d.collect())
    assert ends(features.first_last_of_days(days)) == ends(features.first_last(p))
    quiet = sorted((x.colony_id, str(x.day), x.n, x.w0, x.w1) for x in days.where("quiet and n >= 2").collect())
    assert [q[:3] for q in quiet] == sorted((x.colony_id, str(x.day), x.n) for x in features.daily_changes(p, events).collect())


def test_days_from_sums_where_the_clock_runs_back(spark):
    """Weights step just before and just after the hour that comes twice; its readings are in the day's right part."""
    rows, at = [], 0
    for k in range(60):
        for hive, back in (("H1", 19.5), ("H2", 20.5)):
            w = 40.0 + (6 if k >= 20 else 0) + (7 if k >= 44 else 0)
            for half in (0, 1):
                hours = k + half / 2
                wall = int(hours * 3600) - (3600 if hours >= back else 0)
                rows.append((f"{hive}:L", hive, "L", at, 1_782_000_000 + int(hours * 3600), 1_781_913_600 + wall, w + hours / 100))
                at += 1
    r = spark.createDataFrame(rows, "colony_id string, hive_id string, colony_side string, ord long, ts long, wall long, w double")
    r = r.selectExpr("*", "date_add(date'1970-01-01', cast(floor(wall / 86400) as int)) as day", "94D as t", "55D as h", "70D as et", "60D as eh", "cast(ts * 1000000 + ord as decimal(38,0)) as seq")
    p = written(quality.prepared(r, CFG), "prepared")
    events = written(steps.detect(p, CFG), "events")
    assert events.count() == 4
    row = lambda d: sorted((x.colony_id, str(x.day), x.part, x.quiet, x.n, x.w0, x.w1, x.wall0, x.wall1, round(x.sxw, 4)) for x in d.collect())
    want = row(steps.day_sums(r, events))
    assert row(steps.day_sums(p, events)) == want
    assert row(steps.day_sums(p.withColumn("since", F.lit(0)), events)) == want  # torn sums are taken apart


def test_steps_and_suspects_are_few(spark):
    """Readings go through one exchange and a scan each for the few and for the sums; sums, not readings, meet the events."""
    r = _hard(spark)
    plan = quality.prepared(r, CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and plan.count("Sort ") == 1
    p = written(quality.prepared(r, CFG), "prepared")
    few = quality.few(p)
    key = lambda e: sorted((x.colony_id, x.ts, x.kind, round(x.delta, 9), x.corroborated) for x in e.collect())
    assert key(steps.detect(few, CFG)) == key(steps.detect(r, CFG))
    # a gain of 4 kg on 40 is no jump, so it makes no suspects
    calm = quality.prepared(frame(spark, readings([40.0] * 10 + [44.0] * 20)), CFG)
    assert calm.where("sure").count() == 30


def test_not_a_number_is_above_all_numbers(spark):
    r = frame(spark, readings([40.0] * 5 + [float("nan")] + [40.0] * 5, temps=[94.0] * 8 + [float("nan")] + [94.0] * 2))
    p = written(quality.prepared(r, CFG), "prepared")
    got = lambda d: sorted((x.ts, x.kind) for x in steps.candidates(d, CFG).collect())
    assert got(p) == got(r) and got(p)
    assert {x.ord: x.bad for x in p.where("bad <> ''").collect()} == {5: "weight", 8: "temperature"}


def test_digest_says_what_the_readings_say(spark):
    """One pass writes the few and sums in place of the readings; the features of both are the same, and so are flags and last readings."""
    from combline.plans.analysis import Analysis

    r = _hard(spark)
    p = written(quality.prepared(r, CFG), "prepared")
    d = written(quality.digested(r, CFG), "digest")
    some = quality.few_of(d, CFG)
    assert some.count() < 0.9 * p.count()
    say = lambda x: sorted(repr(row) for row in x.where("not sure or after or head or tail").select(*sorted(p.columns)).collect())
    assert say(some) == say(p)
    events = written(steps.detect(some, CFG), "events")
    a = Analysis(r, spark.createDataFrame([], "hive_id string, observed_date date"), spark.createDataFrame([], "hive_id string, latitude double, longitude double"), CFG)
    row = lambda x: sorted((y.colony_id, str(y.day), y.part, y.quiet, y.n, y.w0, y.w1, y.wall0, y.wall1, y.hive_id, y.colony_side, round(y.sx, 6), round(y.sxx, 4), round(y.sxw, 4)) for y in x.collect())
    assert row(a.days) == row(steps.day_sums(quality.judged(r, events, CFG).where("kept"), events)) and "ordered" not in vars(a)
    flags = lambda x: sorted((y.colony_id, y.ord, y.flag, y.what) for y in x.collect())
    assert flags(a.flags) == flags(quality.quality_flags(quality.judged(r, events, CFG), CFG)) and a.flags.where("flag = 'external'").count() > 100
    last = lambda x: {y.colony_id: y.wall for y in x.groupBy("colony_id").agg(F.max("wall").alias("wall")).collect()}
    assert last(quality.last_seen(d)) == last(r)


def test_digest_where_the_clock_runs_back(spark):
    """A sum that is torn by an event is taken from the readings."""
    r = _hard(spark)
    d = written(quality.digested(r, CFG), "digest")
    events = written(steps.detect(quality.few_of(d, CFG), CFG), "events")
    p = written(quality.prepared(r, CFG), "prepared").where("sure")
    sums = quality.sums_of(d).withColumn("since", F.lit(0).cast("bigint"))
    merged = sums.groupBy("colony_id", "hive_id", "colony_side", "day", "since").agg(*steps._added(), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*steps.STEP_SUMS)
    row = lambda x: sorted((y.colony_id, str(y.day), y.part, y.quiet, y.n, y.w0, y.w1, round(y.sxw, 4)) for y in x.collect())
    assert row(steps.days_of_sums(merged, events, lambda: p)) == row(steps.day_sums(p, events))


def test_equal_ids_are_each_decided_once(spark):
    r = frame(spark, readings([40.0] * 10 + [50.0] + [40.0] * 5), readings([50.0], hours=[10], ord0=10))
    got = quality.judged(r, steps.detect(r, CFG), CFG)
    assert got.count() == r.count() == 17 and got.where("not kept").count() == 2


def test_the_fold_does_not_depend_on_its_batches():
    """A run let back in, one that is not, impossible values and new islands, in batches of any size."""
    w = [40.0, 40.0, 60.0, 60.0, 60.0, 60.0, 40.0, 40.0, 60.0, 500.0, 40.0, 90.0, 90.0, 90.0]
    rows = [{"colony_id": c, "island": "", "ord": i, "wall": i * 3600, "w": x, "t": 94.0, "h": 55.0, "bad": "weight" if x > 400 else "", "settling": False, "a_wall": None, "a_w": None, "a_t": None, "a_h": None} for c in "AB" for i, x in enumerate(w)]
    kinds = {"colony_id": pa.string(), "island": pa.string(), "ord": pa.int64(), "wall": pa.int64(), "bad": pa.string(), "settling": pa.bool_(), "a_wall": pa.int64()}
    table = pa.Table.from_pylist(rows, schema=pa.schema([(c, kinds.get(c, pa.float64())) for c in rows[0]]))
    got = [[x for b in quality._fold(CFG, ["colony_id", "ord"])(iter(table.to_batches(max_chunksize=n))) for x in b.to_pylist()] for n in (1, 2, 5, 100)]
    assert all(g == got[0] for g in got) and [(x["colony_id"], x["ord"]) for x in got[0]] == [(x["colony_id"], x["ord"]) for x in rows]
    assert [x["ord"] for x in got[0] if not x["kept"]] == [6, 7, 9, 10] * 2
    assert [(x["ord"], x["note_n"], x["note_kg"]) for x in got[0] if x["note_n"]] == [(2, 3, 20.0), (11, 3, 30.0)] * 2
