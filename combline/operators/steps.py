"""Abrupt weight steps: candidates, clusters, confirmation, corroboration, and the segments between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combline.config import Thresholds
from combline.session import written

HOUR = 3600
BLOCK_S = 16 * 86_400


def halo(df: DataFrame, t: str, before_s: int = 0, after_s: int = 0, block_s: int = BLOCK_S) -> DataFrame:
    """df spread over time blocks: _block, and _core for the block that owns the row. Rows near a border lie in both blocks,
    so that what looks back before_s or ahead after_s sees all it needs within (key, _block), however large the key."""
    block = lambda c: F.floor(c / block_s)
    out = df.withColumn("_home", block(F.col(t))).withColumn("_block", F.explode(F.sequence(block(F.col(t) - after_s), block(F.col(t) + before_s))))
    return out.withColumn("_core", F.col("_block") == F.col("_home")).drop("_home")


def with_previous(readings: DataFrame, hours: float, cols: tuple[str, ...] = ("w", "wall", "t", "h")) -> DataFrame:
    """readings with p_<col> of the reading before, where that lies at most hours (and an hour for a clock change) back."""
    near = halo(readings, "ts", before_s=int((hours + 2) * HOUR))
    w = Window.partitionBy("colony_id", "_block").orderBy("ts", "ord")
    return near.withColumns({f"p_{c}": F.lag(c).over(w) for c in cols}).where("_core").drop("_core", "_block")


def steps_from_previous(cfg: Thresholds) -> Column:
    """Whether a reading with p_w and p_wall gains or loses enough against the one before, within the longest time; null counts as no."""
    elapsed, delta = (F.col("wall") - F.col("p_wall")) / 3600.0, F.col("w") - F.col("p_w")
    near = (elapsed > 0) & (elapsed <= cfg["events.max_event_interval_hours"]) & (F.col("p_w") > 0) & (F.col("w") > 0)
    drop = (delta < 0) & (F.abs(delta / F.col("p_w") * 100) >= cfg["events.harvest_floor_pct"]) & (F.abs(delta) >= cfg["events.harvest_floor_kg"])
    return near & ((delta >= cfg["events.addition_floor_kg"]) | drop)


def candidates(readings: DataFrame, cfg: Thresholds) -> DataFrame:
    """Readings that step from the one before. Times are differences on the local clock; a pair with a weight of 0 or less
    is no step, and neither are the readings around it compared. Readings that have p_<col> are taken as they are."""
    limit = cfg["events.max_event_interval_hours"]
    r = (readings if "p_w" in readings.columns else with_previous(readings, limit)).withColumns({"elapsed": (F.col("wall") - F.col("p_wall")) / 3600.0, "delta": F.col("w") - F.col("p_w")})
    r = r.where(steps_from_previous(cfg)).withColumn("pct", F.col("delta") / F.col("p_w") * 100)
    restless = (F.abs(F.col("t") - F.col("p_t")) >= cfg["events.swarm.temp_swing_f"]) | (F.abs(F.col("h") - F.col("p_h")) >= cfg["events.swarm.humidity_swing_pct"])
    kind = F.when(F.col("delta") >= cfg["events.addition_floor_kg"], "addition").when(restless, "swarm").otherwise("harvest")
    return r.select("colony_id", "hive_id", "colony_side", "seq", "ts", "wall", kind.alias("kind"), F.col("p_w").alias("before"), F.col("w").alias("after"), "delta", "pct", "elapsed")


def clustered(steps: DataFrame, cfg: Thresholds) -> DataFrame:
    """steps with cluster: a step joins the one before it if that is at most the confirmation time earlier."""
    w = Window.partitionBy("colony_id").orderBy("seq")
    far = F.coalesce((F.col("wall") - F.lag("wall").over(w)) / 3600.0 > cfg["events.confirmation_window_hours"], F.lit(True))
    return steps.withColumn("_new", far.cast("int")).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def net_steps(steps: DataFrame, cfg: Thresholds) -> DataFrame:
    """One row per cluster: from the first step's weight to the last one's, dated by its first largest step."""
    c = clustered(steps, cfg)
    size = F.struct(F.abs("delta").alias("a"), (-F.col("seq")).alias("s"))
    g = c.groupBy("colony_id", "hive_id", "colony_side", "cluster").agg(
        F.count(F.lit(1)).alias("steps"), F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"),
        F.max_by(F.struct("seq", "ts", "wall", "kind", "delta", "pct", "elapsed"), size).alias("d"), F.min_by("wall", "seq").alias("w0"), F.max_by("wall", "seq").alias("w1"),
    )
    one = F.col("steps") == 1
    net = F.when(one, F.col("d.delta")).otherwise(F.col("after") - F.col("before"))
    g = g.withColumn("delta", net).withColumn("pct", F.when(one, F.col("d.pct")).otherwise(F.col("delta") / F.col("before") * 100))
    large = F.when(F.col("delta") > 0, F.col("delta") >= cfg["events.addition_floor_kg"]).otherwise((F.abs("pct") >= cfg["events.harvest_floor_pct"]) & (F.abs("delta") >= cfg["events.harvest_floor_kg"]))
    kind = F.when(one, F.col("d.kind")).when(F.col("delta") > 0, "addition").when((F.col("delta") < 0) & (F.col("d.delta") > 0), "harvest").otherwise(F.col("d.kind"))
    elapsed = F.when(one, F.col("d.elapsed")).otherwise((F.col("w1") - F.col("w0")) / 3600.0)
    return g.where(one | large).select("colony_id", "hive_id", "colony_side", F.col("d.seq").alias("seq"), F.col("d.ts").alias("ts"), F.col("d.wall").alias("wall"), kind.alias("kind"), "before", "after", "delta", "pct", elapsed.alias("elapsed"), "steps")


def confirmed(events: DataFrame, readings: DataFrame, cfg: Thresholds) -> DataFrame:
    """Events of which the median weight over the confirmation time keeps the direction and enough of the size."""
    span = int(cfg["events.confirmation_window_hours"] * HOUR)
    bucket = lambda c: F.floor(c / span)
    e = events.select("colony_id", F.col("seq").alias("e_seq"), F.col("wall").alias("e_wall")).withColumn("_b", F.explode(F.array(*(bucket(F.col("e_wall")) + k for k in (-1, 0, 1)))))
    # prepared readings know whether a step lies near enough before them
    r = readings.where("w > 0 and after" if "after" in readings.columns else "w > 0").select("colony_id", "seq", "wall", "w", bucket(F.col("wall")).alias("_b"))
    ahead = e.hint("shuffle_hash").join(r, ["colony_id", "_b"]).where((F.col("seq") >= F.col("e_seq")) & (F.col("wall") - F.col("e_wall") <= span))
    level = ahead.groupBy("colony_id", F.col("e_seq").alias("seq")).agg(F.percentile("w", F.lit(0.5)).alias("level"))
    kept = F.col("level") - F.col("before")
    ok = (F.col("delta") != 0) & ((kept > 0) == (F.col("delta") > 0)) & (F.abs(kept) >= F.abs("delta") * cfg["events.confirmation_retention"])
    return events.join(level, ["colony_id", "seq"]).where(ok)


def corroborated(events: DataFrame, readings: DataFrame, cfg: Thresholds) -> DataFrame:
    """events with corroborated: the other colony of the site reports and has an event at most the given hours away."""
    span = int(cfg["events.corroboration_window_hours"] * HOUR)
    bucket = lambda c: F.floor(c / span)
    some = readings.where("head") if "head" in readings.columns else readings
    both = some.groupBy("hive_id").agg(F.count_distinct("colony_side").alias("sides")).where("sides = 2").select("hive_id")
    other = events.select("hive_id", F.col("colony_side").alias("o_side"), F.col("wall").alias("o_wall")).withColumn("_b", F.explode(F.array(*(bucket(F.col("o_wall")) + k for k in (-1, 0, 1)))))
    mine = events.select("hive_id", "colony_id", "colony_side", "seq", "wall", bucket(F.col("wall")).alias("_b")).join(both, "hive_id", "left_semi")
    hits = mine.join(other, ["hive_id", "_b"]).where((F.col("o_side") != F.col("colony_side")) & (F.abs(F.col("o_wall") - F.col("wall")) <= span))
    hits = hits.select("colony_id", "seq").distinct().withColumn("_hit", F.lit(True))
    return events.join(hits, ["colony_id", "seq"], "left").withColumn("corroborated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def described(events: DataFrame) -> Column:
    """An event in words: kind, direction, size and local time."""
    kind = F.concat(F.lit("Likely "), F.col("kind"), F.when(F.col("corroborated"), " (corroborated)").otherwise(""))
    size = F.format_string("%.1f kg (%+.1f%%)", F.abs("delta"), F.col("pct"))
    when = F.replace(F.timestamp_add("SECOND", F.col("wall"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(kind, F.lit(": weight "), F.when(F.col("delta") > 0, "gained ").otherwise("dropped "), size, F.lit(" around "), when, F.lit("."))


def detect(readings: DataFrame, cfg: Thresholds) -> DataFrame:
    return corroborated(confirmed(net_steps(candidates(readings, cfg), cfg), readings, cfg), readings, cfg)


def segmented(readings: DataFrame, events: DataFrame) -> DataFrame:
    """readings with segment: the number of events at or before it on the local clock.

    Each stretch between events is laid out over the days it covers, so readings meet theirs on (colony, day).
    """
    ends = readings.groupBy("colony_id").agg(F.min("wall").alias("lo"), F.max("wall").alias("hi"))
    marks = events.select("colony_id", F.col("wall").alias("at")).unionByName(ends.select("colony_id", (F.col("lo") - 1).alias("at")))
    # several events of one instant open one segment, numbered by all of them
    marks = marks.groupBy("colony_id", "at").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("colony_id").orderBy("at")
    spans = marks.withColumns({"segment": (F.sum("n").over(w) - 1).cast("int"), "to": F.lead("at").over(w)}).join(ends, "colony_id")
    day = lambda c: F.floor(c / 86_400)
    first, last = F.greatest("at", "lo"), F.least(F.coalesce(F.col("to") - 1, F.col("hi")), F.col("hi"))
    laid = spans.where(first <= last).select("colony_id", "at", F.coalesce("to", F.col("hi") + 1).alias("to"), "segment", F.explode(F.sequence(day(first), day(last))).alias("_d"))
    return readings.withColumn("_d", day(F.col("wall"))).join(laid, ["colony_id", "_d"]).where((F.col("wall") >= F.col("at")) & (F.col("wall") < F.col("to"))).drop("_d", "at", "to")


def segment_sums(seg: DataFrame) -> DataFrame:
    """Per colony and segment: what adds up over merged segments. x is in days of the local clock."""
    x = F.col("wall") / 86_400.0 - 19_000.0
    return seg.groupBy("colony_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq0"), F.max("seq").alias("seq1"), F.min_by("w", "seq").alias("w0"), F.max_by("w", "seq").alias("w1"),
        F.min_by("wall", "seq").alias("wall0"), F.max_by("wall", "seq").alias("wall1"), F.sum(x).alias("sx"), F.sum("w").alias("sw"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("w")).alias("sxw"),
    )


def _sums() -> list[Column]:
    x = F.col("wall") / 86_400.0 - 19_000.0
    return [
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq0"), F.max("seq").alias("seq1"), F.min_by("w", "seq").alias("w0"), F.max_by("w", "seq").alias("w1"),
        F.min_by("wall", "seq").alias("wall0"), F.max_by("wall", "seq").alias("wall1"), F.sum(x).alias("sx"), F.sum("w").alias("sw"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("w")).alias("sxw"),
    ]


def _added() -> list[Column]:
    """_sums of rows of such sums."""
    return [
        F.sum("n").alias("n"), F.min_by("w0", "seq0").alias("w0"), F.max_by("w1", "seq1").alias("w1"), F.min_by("wall0", "seq0").alias("wall0"), F.max_by("wall1", "seq1").alias("wall1"),
        F.min("seq0").alias("seq0"), F.max("seq1").alias("seq1"), *(F.sum(c).alias(c) for c in ("sx", "sw", "sxx", "sxw")),
    ]


#: Columns of sums over readings with the same steps before and after them.
STEP_SUMS = ["colony_id", "hive_id", "colony_side", "day", "since", "n", "seq0", "seq1", "w0", "w1", "wall0", "wall1", "sx", "sw", "sxx", "sxw", "lo", "hi"]
_COLONY_DAY = ["colony_id", "hive_id", "colony_side", "day"]


def step_sums(readings: DataFrame) -> DataFrame:
    """Prepared readings summed from step to step within each day."""
    return readings.groupBy(*_COLONY_DAY, "since").agg(*_sums(), F.min("wall").alias("lo"), F.max("wall").alias("hi")).select(*STEP_SUMS)


def _part(c: str) -> Column:
    return F.when(F.col("_at").isNull(), 0).otherwise(F.size(F.filter("_at", lambda e: e <= F.col(c))))


def _met(df: DataFrame, events: DataFrame) -> DataFrame:
    """df with quiet and _at, the times of the events of its colony and day."""
    of_day = events.groupBy("colony_id", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("wall") / 86_400).cast("int")).alias("day")).agg(F.collect_list("wall").alias("_at"))
    return df.join(of_day.hint("shuffle_hash"), ["colony_id", "day"], "left").withColumn("quiet", F.col("_at").isNull())


def _day_rows(readings: DataFrame, events: DataFrame) -> DataFrame:
    return _met(readings.select(*_COLONY_DAY, "seq", "wall", "w"), events).groupBy(*_COLONY_DAY, _part("wall").alias("part"), "quiet").agg(*_sums())


def day_sums(readings: DataFrame, events: DataFrame) -> DataFrame:
    """Per colony, day and part of a day between events: what adds up over segments, and whether the day is quiet (without
    an event). One pass over the readings serves whatever is told of days, segments and colonies.

    Prepared readings are summed from step to step first, as days_of_sums has it."""
    if "since" not in readings.columns:
        return _day_rows(readings, events)
    return days_of_sums(step_sums(readings), events, lambda: readings)


def days_of_sums(sums: DataFrame, events: DataFrame, readings: Callable[[], DataFrame]) -> DataFrame:
    """day_sums of what step_sums tells, written. Events can only be at steps, so only sums are exchanged to meet them. Where
    the clock ran back over an event, such a sum is torn and its day is taken from the readings, one by one."""
    torn = F.bool_or(_part("lo") != _part("hi")).alias("torn")
    days = written(_met(sums, events).groupBy(*_COLONY_DAY, _part("lo").alias("part"), "quiet").agg(*_added(), torn), "days")
    again = days.where("torn").select("colony_id", "day").distinct()
    if again.isEmpty():
        return days.drop("torn")
    again = written(again, "torn")
    rows = _day_rows(readings().join(again, ["colony_id", "day"], "left_semi"), events)
    return written(days.drop("torn").join(again, ["colony_id", "day"], "left_anti").unionByName(rows), "days")


def segment_sums_of_days(days: DataFrame, events: DataFrame) -> DataFrame:
    """segment_sums of what day_sums gives for the same events: a part's segment is the number of events of the days before and of its own."""
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    marks = events.groupBy("colony_id", F.floor(F.col("wall") / 86_400).cast("int").alias("_d")).agg(F.count(F.lit(1)).alias("_e"))
    both = days.withColumns({"_d": number(F.col("day")), "_e": F.lit(0).cast("bigint")}).unionByName(marks, allowMissingColumns=True)
    before = F.sum("_e").over(Window.partitionBy("colony_id").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1))
    seg = both.withColumn("segment", (F.coalesce(before, F.lit(0)) + F.col("part")).cast("int")).where(F.col("n").isNotNull())
    return seg.groupBy("colony_id", "segment").agg(*_added())


def merge_short(sums: DataFrame, cfg: Thresholds) -> DataFrame:
    """Segments after the first that are shorter than the least length are added to the one before."""
    w = Window.partitionBy("colony_id").orderBy("segment")
    short = (F.col("wall1") - F.col("wall0")) / 3600.0 < cfg["events.min_segment_hours"]
    opens = F.when(F.row_number().over(w) == 1, 1).when(short, 0).otherwise(1)
    m = sums.withColumn("_o", opens).withColumn("merged", F.sum("_o").over(w))
    return m.groupBy("colony_id", "merged").agg(
        F.sum("n").alias("n"), F.min_by("w0", "seq0").alias("w0"), F.max_by("w1", "seq1").alias("w1"), F.min_by("wall0", "seq0").alias("wall0"), F.max_by("wall1", "seq1").alias("wall1"),
        *(F.sum(c).alias(c) for c in ("sx", "sw", "sxx", "sxw")),
    )


def segment_slopes(merged: DataFrame) -> DataFrame:
    """Least-squares slope in kg a day, and in percent of the segment's first weight; 0 without two instants."""
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = F.when((F.col("n") >= 2) & (spread > 1e-9), (F.col("sxw") - F.col("sx") * F.col("sw") / F.col("n")) / spread).otherwise(F.lit(0.0))
    return merged.withColumn("slope", slope).withColumn("slope_pct", F.when(F.col("w0") != 0, F.col("slope") / F.col("w0") * 100).otherwise(F.lit(0.0)))


def trend(slopes: DataFrame) -> DataFrame:
    """Per colony over its segments of two readings or more: summed change, percent of the first weight, slopes weighted by span."""
    scored = F.col("n") >= 2
    span = F.greatest((F.col("wall1") - F.col("wall0")) / 86_400.0, F.lit(1.0 / 24))
    on = lambda c: F.sum(F.when(scored, c).otherwise(F.lit(0.0)))
    g = slopes.groupBy("colony_id").agg(
        F.count(F.lit(1)).alias("segments"), on(F.col("w1") - F.col("w0")).alias("delta_kg"), F.min_by(F.when(scored, F.col("w0")), F.when(scored, F.col("merged"))).alias("start"),
        on(F.col("slope") * span).alias("a"), on(F.col("slope_pct") * span).alias("b"), on(span).alias("s"),
    )
    pct = F.when(F.col("start") != 0, F.col("delta_kg") / F.col("start") * 100).otherwise(F.lit(0.0))
    return g.select(
        "colony_id", "segments", "delta_kg", F.coalesce(pct, F.lit(0.0)).alias("weight_pct_change"),
        F.when(F.col("s") > 0, F.col("a") / F.col("s")).otherwise(F.lit(0.0)).alias("weight_slope_kg_per_day"), F.when(F.col("s") > 0, F.col("b") / F.col("s")).otherwise(F.lit(0.0)).alias("weight_slope_pct_per_day"),
    )
