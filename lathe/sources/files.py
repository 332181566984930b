"""Reading raw files and writing results: all-string tables, packed JSON, layouts, exports and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file or of the first file of a folder: its first line alone is read."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"') for c in first[0][0].split(",")] if first else []


def string_schema(names: Sequence[str], rename: Mapping[str, str] | None = None, trailing: str = "trailing_empty") -> StructType:
    """All columns as strings; unnamed last column kept as `trailing`; raises on repeated names."""
    renamed = [(rename or {}).get(n, n) or trailing for n in names]
    if repeated := {n for n in renamed if renamed.count(n) > 1}:
        raise ValueError(f"repeated columns: {', '.join(sorted(repeated))}")
    return StructType([StructField(n, StringType()) for n in renamed])


def read_strings(spark: SparkSession, root: str, names: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """CSV files under a root with key=value folders, every column a string; the folders' keys become columns."""
    return spark.read.schema(string_schema(names, rename)).option("header", True).option("basePath", root).csv(root)


def read_json_strings(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """JSON lines, gzipped or not, with a fixed schema of strings: missing keys are null, unknown ones ignored."""
    return spark.read.schema(string_schema(names)).json(path)


def project_sparse(frames: Sequence[DataFrame], kept: Sequence[str]) -> DataFrame:
    """Frames of varying columns as one with the kept columns; what a frame lacks is null."""
    out = None
    for frame in frames:
        part = frame.select(*[F.col(c).cast("string").alias(c) if c in frame.columns else F.lit(None).cast("string").alias(c) for c in kept])
        out = part if out is None else out.unionByName(part)
    return out


def check_landing(df: DataFrame, required: Sequence[str], identity: Mapping[str, str], low: int, high: int) -> DataFrame:
    """(problem, rows) of a landed file: missing columns, rows of another identity, a row count out of bounds."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        return df.sparkSession.createDataFrame([(f"missing {c}", 0) for c in lacking], "problem string, rows long")
    other = [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(c) for c, v in identity.items()]
    counts = df.agg(F.count("*").alias("_n"), *other)
    rows = [F.when(~F.col("_n").between(low, high), F.struct(F.lit("row count").alias("problem"), F.col("_n").alias("rows")))]
    rows += [F.when(F.col(c) > 0, F.struct(F.lit(f"other {c}").alias("problem"), F.col(c).alias("rows"))) for c in identity]
    return counts.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def write_layout(df: DataFrame, path: str, day: str, cluster: Sequence[str]) -> None:
    """Parquet in one folder a month, sorted by up to three columns inside, so that scans skip folders and row groups.

    Rows are dealt by month and a range of the first cluster column: a month of any size has several writers, and each
    writer few files.
    """
    month = F.trunc(F.col(day).cast("date"), "MM")
    dealt = df.withColumn("month", month).repartitionByRange(F.col("month"), *[F.col(c) for c in cluster[:1]])
    dealt.sortWithinPartitions("month", *cluster[:3]).write.partitionBy("month").parquet(path)


def export_once(df: DataFrame, path: str) -> None:
    """Parquet unless the folder is there, so that an export can be taken up again."""
    df.write.mode("ignore").parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in one canonical order, over several files whose names keep it."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, newest) of a folder of Parquet files, by the reader's own metadata."""
    meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return meta.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.max("file_modification_time").alias("newest"))


def absent_parts(spark: SparkSession, folder: str, names: Sequence[str]) -> list[str]:
    """Names of a contract's files that a folder lacks, in order; asks Spark's file system layer, so any store will do."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for n in names if not store.exists(jvm.org.apache.hadoop.fs.Path(root, n))]


#: Written last: a folder that has it is a published run and never changes.
MARKER = "_PUBLISHED.json"


def publish(spark: SparkSession, run: str, target: str, required: Sequence[str]) -> DataFrame:
    """Copies a run's files to target and writes MARKER there, with their sizes and digests; gives that manifest (name, bytes, sha256).

    Refuses a run without one of the required files, and a target that is published. The copy is staged beside the target, read back and held against
    the source's digests, and moved into place by one rename; what an interrupted copy left is replaced. Digests are taken where the files
    are read, one file a task; names starting with _ or . are no part of a run. Any store that Spark's file system layer reaches will do.
    """
    absent = absent_parts(spark, run, required)
    if absent:
        raise ValueError(f"the run lacks {absent}")
    if not absent_parts(spark, target, [MARKER]):
        raise ValueError(f"{target} is published and doesn't change")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source, final, staged = path(run), path(target), path(target.rstrip("/") + "-staged")
    store, there = source.getFileSystem(conf), final.getFileSystem(conf)
    there.delete(staged, True)
    there.mkdirs(staged)
    names = [f.getPath().getName() for f in store.listStatus(source) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    for name in names:
        jvm.org.apache.hadoop.fs.FileUtil.copy(store, path(source, name), there, path(staged, name), False, conf)

    def digests(folder: str) -> list[tuple]:
        read = spark.read.format("binaryFile").load(folder)
        rows = read.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        return sorted(map(tuple, rows.collect()))

    manifest = digests(run)
    if digests(staged.toString()) != manifest:
        raise ValueError("the copy differs from the run")
    there.delete(final, True)
    if not there.rename(staged, final):
        raise ValueError(f"{target} couldn't be put in place")
    out = there.create(path(final, MARKER), False)
    out.write(bytearray(json.dumps({"files": [dict(zip(("name", "bytes", "sha256"), r, strict=True)) for r in manifest], "required": sorted(required)}, indent=1).encode()))
    out.close()
    return spark.createDataFrame(manifest, "name string, bytes long, sha256 string")
