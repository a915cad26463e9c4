"""Joining rows to a dictionary of their distinct values when a few values hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary_join(rows: DataFrame, dictionary: DataFrame, keys: list[str], count: str, total: int, share: int = 256) -> DataFrame:
    """Inner join of rows with a dictionary that has one entry per key and, in count, the number of rows with that key.

    Keys with more than total / share rows number fewer than share, whatever the data: only those are broadcast, so a
    hot key never meets in one task. All others are joined by a shuffle in which no key is hot. Null keys match nothing.
    """
    hot = F.col(count) * share > total
    heavy = F.broadcast(dictionary.where(hot))
    light = dictionary.where(~hot)
    marked = rows.join(heavy.select(*keys, F.lit(True).alias("_hot")), keys, "left")
    return marked.where("_hot").drop("_hot").join(heavy, keys).unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(light, keys))
