"""Irregular readings onto a regular grid, gaps carried forward within a limit or marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBSERVED, FILLED, MISSING = "observed", "filled", "missing"


def regular_grid(
    df: DataFrame,
    keys: list[str],
    epoch: str,
    value: str,
    order_id: str,
    step_s: int = 3600,
    max_gap: int = 336,
    block_slots: int = 336,
) -> DataFrame:
    """A row for each slot between a source's first and last occupied one.

    Result: keys, slot_epoch (the slot's first second), value (the slot's last non-null reading, or the last one before
    it carried forward), status (observed, filled, missing) and gap_slots (how many empty slots the slot's gap has; 0 if
    observed). A gap of more than max_gap slots is left null and marked missing as a whole.

    Null keys, epochs and values occupy no slot; a source without values has no rows. Of several readings in a slot the
    latest gives the value, of equally late ones that with the larger order_id. Other columns are ignored.

    The sequence is made per source and block of block_slots slots, so no task ever holds a whole source: a block has
    at most block_slots rows, and what must cross blocks is one row per block.
    """
    span = step_s * block_slots
    src = df.select(
        *(F.col(k) for k in keys),
        F.floor(F.col(epoch) / span).cast("bigint").alias("_block"),
        F.floor(F.col(epoch) / step_s).cast("bigint").alias("_slot"),
        F.col(value).cast("double").alias("_v"),
        F.col(epoch).cast("bigint").alias("_t"),
        F.col(order_id).cast("bigint").alias("_o"),
    )
    # _block too: so both uses of the buckets have the same filters
    for c in (*keys, "_slot", "_block", "_v"):
        src = src.where(F.col(c).isNotNull())
    # second within the slot and id in one long (20 and 42 bits), so that the buffers stay of fixed width
    late = F.shiftleft(F.col("_t") - F.col("_slot") * step_s, 42) + F.pmod(F.coalesce("_o", F.lit(0)), F.lit(1 << 42))
    # never null, but asking for it keeps the optimiser from computing slots without values apart: both uses share one exchange
    buckets = src.groupBy(*keys, "_block", "_slot").agg(F.max_by("_v", late).alias("_v")).where(F.col("_v").isNotNull())

    per_block = buckets.groupBy(*keys, "_block").agg(
        F.min("_slot").alias("_first"), F.max("_slot").alias("_last"), F.max_by("_v", "_slot").alias("_last_v")
    )
    in_time = Window.partitionBy(*keys).orderBy("_block")
    blocks = per_block.select(
        *keys, "_block", "_first", "_last", "_last_v",
        F.lag("_last").over(in_time).alias("_in_slot"),
        F.lag("_last_v").over(in_time).alias("_in_v"),
        F.lead("_first").over(in_time).alias("_out_slot"),
        F.lead("_block").over(in_time).alias("_next_block"),
    )
    # an occupied block also stands for the empty blocks up to the next occupied one
    pieces = blocks.select(
        *keys, F.explode(F.expr("sequence(_block, coalesce(_next_block - 1, _block))")).alias("_b"),
        "_block", "_first", "_last", "_last_v", "_in_slot", "_in_v", "_out_slot",
    )
    own = F.col("_b") == F.col("_block")
    lo = F.greatest(F.col("_b") * block_slots, F.when(F.col("_in_slot").isNull() & own, F.col("_first")).otherwise(F.col("_b") * block_slots))
    hi = F.least((F.col("_b") + 1) * block_slots - 1, F.coalesce(F.col("_out_slot"), F.col("_last")))
    skeleton = pieces.select(
        *keys,
        F.col("_b").alias("_block"),
        F.explode(F.sequence(lo, hi)).alias("_slot"),
        F.when(own, F.col("_in_slot")).otherwise(F.col("_last")).alias("_in_slot"),
        F.when(own, F.col("_in_v")).otherwise(F.col("_last_v")).alias("_in_v"),
        "_out_slot",
    )
    joined = skeleton.join(buckets, [*keys, "_block", "_slot"], "left")
    w = Window.partitionBy(*keys, "_block").orderBy("_slot")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("_v").isNotNull(), F.col("_slot"))
    rows = joined.select(
        *keys, "_slot", "_v",
        F.coalesce(F.last(seen, ignorenulls=True).over(before), F.col("_in_slot")).alias("_prev"),
        F.coalesce(F.last("_v", ignorenulls=True).over(before), F.col("_in_v")).alias("_carry"),
        F.coalesce(F.first(seen, ignorenulls=True).over(after), F.col("_out_slot")).alias("_next"),
    )
    gap = F.when(F.col("_v").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("_next") - F.col("_prev") - 1)
    return rows.select(
        *keys,
        (F.col("_slot") * step_s).alias("slot_epoch"),
        F.when(gap <= max_gap, F.col("_carry")).alias(value),
        F.when(F.col("_v").isNotNull(), OBSERVED).when(gap <= max_gap, FILLED).otherwise(MISSING).alias("status"),
        gap.alias("gap_slots"),
    )
