"""Trailing totals by block decomposition: each window is one suffix of a block and one prefix of the next."""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(df: DataFrame, keys: list[str], day: str, value: str, windows: tuple[int, ...] = (7, 30), tail_days: int | None = None) -> DataFrame:
    """Total, count and average of value over each trailing period, for each calendar day of each entity.

    Days run from the entity's first day with a value to tail_days (default: the shortest window less one) after its
    last, days without values included. Result: keys, day, and for each window n: total_n, count_n, avg_n (null if
    nothing was counted). Rows with a null key, day or value count nowhere; an entity without any has no rows.

    A window of n days ending on day d covers the suffix from d-n+1 of one n-day block and the prefix up to d of the
    next one. Rows are first added up per day, before any ordering; all orderings are within one block, whose rows are
    its days, so no task holds a whole entity. All blocks nest in one of lcm(windows) days, by which rows are placed once.
    """
    tail = min(windows) - 1 if tail_days is None else tail_days
    big = lcm(*windows)
    src = df.select(*keys, F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).cast("int").alias("_d"), F.col(value).cast("double").alias("_v"))
    for c in (*keys, "_d", "_v"):
        src = src.where(F.col(c).isNotNull())
    daily = src.groupBy(*keys, "_d").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))

    # calendar: each day with values also stands for the empty days up to the next such day
    month = daily.withColumn("_big", F.floor(F.col("_d") / big).cast("int"))
    edge = month.groupBy(*keys, "_big").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    over = Window.partitionBy(*keys).orderBy("_big")
    # windows may begin before the first day: those days send suffixes but are no result
    since = F.when(F.lag("_lo").over(over).isNull(), F.col("_lo") - (max(windows) - 1)).otherwise(F.col("_lo"))
    edge = edge.select(*keys, "_lo", since.alias("_since"), F.coalesce(F.lead("_lo").over(over) - 1, F.col("_hi") + tail).alias("_end"))
    calendar = edge.select(*keys, "_lo", F.explode(F.sequence("_since", "_end")).alias("_d")).select(
        *keys, "_d", (F.col("_d") >= F.col("_lo")).alias("_real"), F.lit(None).cast("double").alias("_s"), F.lit(0).cast("bigint").alias("_n")
    )
    days = (
        calendar.unionByName(daily.select(*keys, "_d", F.lit(True).alias("_real"), "_s", "_n"))
        .withColumn("_big", F.floor(F.col("_d") / big).cast("int"))
        .groupBy(*keys, "_big", "_d")
        .agg(F.max("_real").alias("_real"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_s"), F.sum("_n").alias("_n"))
        .repartition(*keys, "_big")
    )
    for n in windows:
        days = days.withColumn(f"_b{n}", F.floor(F.col("_d") / n).cast("int"))
    placed = days
    for n in windows:
        block = Window.partitionBy(*keys, "_big", f"_b{n}").orderBy("_d")
        upto, since = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
        for x in ("_s", "_n"):
            placed = placed.withColumn(f"{x}{n}_prefix", F.sum(x).over(upto)).withColumn(f"{x}{n}_suffix", F.sum(x).over(since))

    # every day sends its prefix to itself, and its suffix to the day whose window begins on it (in the next block)
    def zero(n: int) -> list:
        return [F.lit(0.0).alias(f"_s{n}"), F.lit(0).cast("bigint").alias(f"_n{n}")]

    prefix = [c for n in windows for c in (F.col(f"_s{n}_prefix").alias(f"_s{n}"), F.col(f"_n{n}_prefix").alias(f"_n{n}"))]
    sends = [F.struct(F.col("_d").alias("_d"), F.col("_real").alias("_own"), *prefix)]
    for n in windows:
        to = F.when(F.pmod(F.col("_d"), F.lit(n)) > 0, F.col("_d") + n - 1)
        own = [c for m in windows for c in ([F.col(f"_s{n}_suffix").alias(f"_s{n}"), F.col(f"_n{n}_suffix").alias(f"_n{n}")] if m == n else zero(m))]
        sends.append(F.struct(to.alias("_d"), F.lit(False).alias("_own"), *own))
    sent = placed.select(*keys, F.inline(F.array(*sends))).where(F.col("_d").isNotNull())
    out = sent.groupBy(*keys, "_d").agg(F.max("_own").alias("_own"), *(F.sum(f"{x}{n}").alias(f"{x}{n}") for n in windows for x in ("_s", "_n")))
    cols = reduce(
        lambda acc, n: [*acc, F.col(f"_s{n}").alias(f"total_{n}"), F.col(f"_n{n}").alias(f"count_{n}"), F.when(F.col(f"_n{n}") > 0, F.col(f"_s{n}") / F.col(f"_n{n}")).alias(f"avg_{n}")],
        windows,
        [],
    )
    return out.where("_own").select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d")).alias("day"), *cols)
