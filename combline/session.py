"""Session helpers: a local builder for tests and benches, and the folder shared by all executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def local_session(cores: int | str = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("combline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a local master without that setting (tests, one machine) gets a temporary folder, which goes when Python ends; on
    a cluster a missing setting raises, as a machine's own folder is of no use to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="combline-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def _own_dir(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"combline-{spark.sparkContext.applicationId}")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table written once to the shared folder and read back: the lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = os.path.join(_own_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df by keys over as many partitions as the session has, however few its bytes: for Python work that costs more than its rows weigh."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path is there on the file system that Spark itself would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def release(spark: SparkSession) -> None:
    """Deletes what this application has written with `written`; results that still read from it must be stored before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
