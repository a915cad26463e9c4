"""Mixed stamps to one UTC instant through a dictionary of the distinct raw texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combline.functions.stamps import parse_stamp
from combline.operators.heavy import dictionary_join
from combline.session import written

KEY = ["source", "day", "raw", "zone"]
_ENTRY = "source string, day string, raw string, zone string, epoch_s bigint"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    zones: dict[str, ZoneInfo] = {}
    for b in batches:
        got = []
        for day, raw, zone in zip(b["day"], b["raw"], b["zone"]):
            z = zones.get(zone) or zones.setdefault(zone, ZoneInfo(zone))
            got.append(parse_stamp(raw, z, pd.Timestamp(day).date() if day else None))
        yield b.assign(epoch_s=pd.array(got, dtype="Int64"))[[*KEY, "epoch_s"]]


def stamp_rows(df: DataFrame, row_id: str, raw: str, source: str, zone: str = "America/New_York", day: str | None = None) -> DataFrame:
    """Rows of one table in the common shape: source, row_id, day (empty where raw holds the date itself), raw, zone.

    Outer blanks, quotes and the final full stop go here, so that variants share one dictionary entry. Texts without any
    digit denote no instant and are left out, as are rows with a null id, raw text or (where one is named) day.
    """
    edge = "[\\\\s\\u00a0\"'\\u201c\\u201d]"
    text = F.expr(f"regexp_replace(`{raw}`, '^{edge}+|(?:{edge}|[.])+$', '')".replace("\"'", "\"\\'"))
    out = df.select(
        F.lit(source).alias("source"),
        F.col(row_id).cast("bigint").alias("row_id"),
        (F.date_format(day, "yyyy-MM-dd") if day else F.lit("")).alias("day"),
        text.alias("raw"),
        F.lit(zone).alias("zone"),
    )
    return out.where(F.col("row_id").isNotNull() & F.col("day").isNotNull() & F.col("raw").rlike("[0-9]"))


class Dictionary:
    """Parsed stamps kept over runs: a folder with one sub-folder for each run that added some.

    An addition counts once Spark has marked it as complete, so a run that dies leaves nothing half done, and additions are
    never changed. Two runs at once may parse the same stamp; entries are made one per key on reading.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def additions(self) -> list[str]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        found = (str(s.getPath()) for s in self._fs.listStatus(self._hadoop(self.path)) if s.isDirectory())
        return sorted(p for p in found if self._fs.exists(self._hadoop(f"{p}/_SUCCESS")))

    def entries(self) -> DataFrame:
        paths = self.additions()
        if not paths:
            return self.spark.createDataFrame([], _ENTRY)
        rows = self.spark.read.schema(_ENTRY).parquet(*paths)
        return rows if len(paths) == 1 else rows.groupBy(*KEY).agg(F.max("epoch_s").alias("epoch_s"))

    def add(self, entries: DataFrame) -> int:
        """Number of entries added; none leaves no folder."""
        at = f"{self.path}/added-{uuid.uuid4().hex}"
        entries.write.parquet(at)
        n = self.spark.read.schema(_ENTRY).parquet(at).count()
        if not n:
            self._fs.delete(self._hadoop(at), True)
        return n


def normalise_instants(rows: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """source, row_id and epoch_s of each row (of stamp_rows) whose stamp denotes exactly one instant.

    The distinct (source, day, raw, zone) are counted and parsed once each. With dictionary_path the parsed stamps persist
    over runs: entries already there, readable or not, are not parsed again, and new ones are added. Without, they lie in the
    session's shared folder for this run. Repeated rows come out as often as they go in. An empty input gives no rows.
    """
    rows = written(rows, "stamp-rows")  # three plans read them
    distinct = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "distinct-stamps")
    if dictionary_path is None:
        known = written(distinct.select(*KEY).mapInPandas(_parse, _ENTRY), "stamps")
    else:
        kept = Dictionary(rows.sparkSession, dictionary_path)
        fresh = distinct.join(kept.entries().select(*KEY), KEY, "left_anti") if kept.additions() else distinct
        kept.add(fresh.select(*KEY).mapInPandas(_parse, _ENTRY))
        known = kept.entries()
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = known.where(F.col("epoch_s").isNotNull()).join(distinct, KEY)
    return dictionary_join(rows, entries, KEY, "n", total).select("source", "row_id", "epoch_s")
