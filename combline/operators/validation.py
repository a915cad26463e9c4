"""Detections against a labelled log: greedy one-to-one matching, audited ranges, precision and recall, and replay by windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("true_positive", "false_negative", "false_positive", "true_negative", "unaudited_detection")
_SCHEMA = "colony_id string, record bigint, detected bigint, kind string, offset_hours double, outcome string"


def _greedy(tolerance_s: float):
    def match(key: tuple, found: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
        pool = sorted(zip(found["at"].tolist(), found["seq"].tolist(), found["kind"].tolist(), found["audited"].tolist()))
        out = []
        wanted = sorted(zip(records["label"] != "event", records["ord"], records["at"], records["kinds"], records["label"]), key=lambda r: (r[0], r[1]))
        for _, o, at, kinds, label in wanted:
            near = [(abs(d[0] - at), k) for k, d in enumerate(pool) if d[2].split(" ")[0] in kinds and abs(d[0] - at) <= tolerance_s]
            hit = pool.pop(min(near)[1]) if near else None
            outcome = ("true_positive" if hit else "false_negative") if label == "event" else ("false_positive" if hit else "true_negative")
            out.append((key[0], o, hit and hit[0], hit and hit[2], (hit[0] - at) / 3600 if hit else None, outcome))
        out += [(key[0], None, d[0], d[2], None, "false_positive" if d[3] else "unaudited_detection") for d in pool]
        return pd.DataFrame(out, columns=["colony_id", "record", "detected", "kind", "offset_hours", "outcome"]).astype({"record": "Int64", "detected": "Int64", "offset_hours": "Float64"})

    return match


def audited(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """events with audited: whether a range (hive_id, side or *, start, end) of the site holds the instant, its end excluded."""
    day = lambda c: F.floor(c / 86_400)
    r = ranges.select(F.col("hive_id"), F.col("side"), "start", "end", F.explode(F.sequence(day(F.col("start")), day(F.col("end")))).alias("_d"))
    hit = events.select("hive_id", "colony_side", "colony_id", "seq", "ts", day(F.col("ts")).alias("_d")).join(r, ["hive_id", "_d"])
    hit = hit.where(((F.col("side") == "*") | (F.col("side") == F.col("colony_side"))) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    return events.join(hit.select("colony_id", "seq").distinct().withColumn("audited", F.lit(True)), ["colony_id", "seq"], "left").fillna(False, ["audited"])


def match_events(events: DataFrame, records: DataFrame, ranges: DataFrame, tolerance_hours: float = 6.0) -> DataFrame:
    """colony_id, record, detected, kind, offset_hours, outcome. records: ord, colony_id, at, label, kinds.

    Event records take, in their order, the nearest detection of an accepted kind within the tolerance, which is used up;
    records of non-events then take what is left near them. Detections left over are false within an audited range, else
    unaudited. Both sides of a colony are few: a log is kept by hand, and events lie hours apart.
    """
    e = audited(events, ranges).select("colony_id", F.col("ts").alias("at"), F.col("seq").cast("string").alias("seq"), "kind", "audited")
    return e.groupBy("colony_id").cogroup(records.select("colony_id", "ord", "at", "label", "kinds").groupBy("colony_id")).applyInPandas(_greedy(tolerance_hours * 3600), _SCHEMA)


def rates(outcomes: DataFrame) -> DataFrame:
    """One row: counts by outcome, precision, recall (1 where nothing was to be found) and f1 (0 where both are 0)."""
    c = outcomes.groupBy().agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    tp, fp, fn = (F.col(k) for k in ("true_positive", "false_positive", "false_negative"))
    out = c.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0), "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def replayed(readings: DataFrame, window_days: int, step_days: int = 1) -> DataFrame:
    """readings once for each window that holds them; colony_id and hive_id carry the window's number after a #, so detection takes each window by itself.

    Windows end at the first reading plus window_days and every step_days from there, as long as one ends at most a step
    after the last reading; both ends belong to a window.
    """
    ends = readings.agg(F.min("wall").alias("a"), F.max("wall").alias("z")).first()
    if ends["a"] is None:
        return readings.limit(0).withColumn("window", F.lit(None).cast("bigint"))
    day, a = 86_400, ends["a"]
    last = (ends["z"] + step_days * day - a - window_days * day) // (step_days * day)
    first = F.greatest(F.lit(0), F.ceil((F.col("wall") - a - window_days * day) / (step_days * day)))
    upto = F.least(F.lit(last), F.floor((F.col("wall") - a) / (step_days * day)))
    rows = readings.where(first <= upto).withColumn("window", F.explode(F.sequence(first.cast("bigint"), upto.cast("bigint"))))
    tag = lambda c: F.concat(F.col(c), F.lit("#"), F.col("window").cast("string"))
    return rows.withColumns({"colony_id": tag("colony_id"), "hive_id": tag("hive_id")})


def first_seen(events: DataFrame) -> DataFrame:
    """Events of replayed windows once per colony and local time: the one of the earliest window."""
    e = events.withColumns({"_window": F.regexp_extract("colony_id", "#(\\d+)$", 1).cast("bigint"), "colony_id": F.regexp_replace("colony_id", "#\\d+$", ""), "hive_id": F.regexp_replace("hive_id", "#\\d+$", "")})
    row = F.struct(*[c for c in e.columns if c not in ("colony_id", "wall", "_window")])
    return e.groupBy("colony_id", "wall").agg(F.min_by(row, "_window").alias("r"), F.min("_window").alias("first_window")).select("colony_id", "wall", "first_window", "r.*")
