"""Pairing records with the nearest record in time of the same entity, within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_nearest(
    left: DataFrame, right: DataFrame, entity: str, left_id: str, left_epoch: str, right_id: str, right_epoch: str, per: list[str], tolerance_s: int
) -> DataFrame:
    """left_id, per, right_id and gap_s: for each left row and each value of per (columns of right) the nearest right row.

    Only right rows at most tolerance_s seconds away count; of two equally near ones the earlier wins, of equally timed
    ones that with the smaller id. Left rows without a match give no row. A null entity, id or epoch matches nothing; a
    null in per is a value like any other. Repeated left rows (the same id) give one result. Empty inputs: no rows.
    Other columns are ignored, and clashing names are kept apart.

    Time is cut into buckets of tolerance_s; a right row lies in one, a left row looks in its own and the two adjacent
    ones, so all that can match meets on (entity, bucket). Before they meet, a bucket's right rows are cut down to the
    earliest row of each second, so that copies do not multiply; what a left row meets is then at most three buckets of
    one row per second and value of per.
    """
    r = right.select(
        F.col(entity).alias("_e"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(per)), F.col(right_epoch).cast("bigint").alias("_rt"), F.col(right_id).cast("bigint").alias("_rid")
    )
    r = r.where(F.col("_e").isNotNull() & F.col("_rt").isNotNull() & F.col("_rid").isNotNull())
    ps = [f"_p{i}" for i in range(len(per))]
    r = r.groupBy("_e", *ps, "_rt").agg(F.min("_rid").alias("_rid")).withColumn("_bucket", F.floor(F.col("_rt") / tolerance_s))

    lt = left.select(F.col(entity).alias("_e"), F.col(left_id).cast("bigint").alias("_lid"), F.col(left_epoch).cast("bigint").alias("_lt"))
    lt = lt.where(F.col("_e").isNotNull() & F.col("_lt").isNotNull() & F.col("_lid").isNotNull())
    home = F.floor(F.col("_lt") / tolerance_s)
    lt = lt.withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))

    gap = F.abs(F.col("_rt") - F.col("_lt"))
    near = lt.join(r, ["_e", "_bucket"]).where(gap <= tolerance_s)
    # one long orders the candidates: the gap, then earlier before later; ids decide nothing, seconds are unique
    rank = gap * 2 + F.when(F.col("_rt") > F.col("_lt"), 1).otherwise(0)
    best = near.groupBy("_lid", *ps).agg(F.min_by("_rid", rank).alias("_rid"), F.min(gap).alias("gap_s"))
    return best.select(F.col("_lid").alias(left_id), *(F.col(f"_p{i}").alias(c) for i, c in enumerate(per)), F.col("_rid").alias(right_id), "gap_s")
