"""One row per event: of rows that were sent or fetched more than once, the one with the smallest id stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standing(df: DataFrame, keys: list[str], id_col: str, keep: list[str] = ()) -> DataFrame:
    """Columns keys, id_col and keep of the row with the smallest id of each key.

    Numbers and instants ride along as min_by buffers of fixed width, so the hash aggregate combines copies
    before the shuffle and a group of copies of any size arrives as one row per map task.
    Rows with a null key or id belong to no series and are left out. A null in a kept column stays null: the row
    that stands is chosen by its id alone. Equal ids with equal keys are taken to be the same row.
    """
    whole = F.lit(True)
    for c in (*keys, id_col):
        whole = whole & F.col(c).isNotNull()
    aggs = [F.min(id_col).alias(id_col), *(F.min_by(c, id_col).alias(c) for c in keep)]
    return df.where(whole).groupBy(*keys).agg(*aggs)
