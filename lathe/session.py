"""Session settings that every query here expects, and access to the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []


def build_session(app: str = "lathe", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew joins, Arrow. Leaves the number of shuffle partitions to AQE or the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, a folder of our own on a local master only.

    On a cluster each executor would write such a folder to its own disk, so there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lathe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under scratch_root(), which release_scratch() removes."""
    _SCRATCH.append(f"{scratch_root(spark)}/lathe-{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Writes df as Parquet under scratch_root() and reads it back, with a folder for each value of the columns `by`, which come last then.

    Cuts the lineage durably (lost executors don't bring it back), fixes what depends on task order, and gives the planner
    true sizes, by which it may broadcast. release_scratch() removes the folders once results are written.
    """
    return materialise_at(df, name, by)[0]


def materialise_at(df: DataFrame, name: str, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """materialise() with the folder, for callers that discard() it themselves."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes one folder by Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch(spark: SparkSession) -> None:
    """Deletes what materialise() wrote in this session; call it when no DataFrame built on it is needed any more."""
    while _SCRATCH:
        discard(spark, _SCRATCH.pop())
