"""Replaying a table as a stream of files, and collecting a finished stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.scalars import channel
from lathe.session import scratch_folder

#: Rows of a file that a sink writes, so that a large batch is written in bounded chunks.
CHUNK = 5000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Batches whose progress is kept until the counts of a run are read.
_RETAINED = ("spark.sql.streaming.numRecentProgressUpdates", "1000000")


def write_replay(df: DataFrame, ts: str, files: int = 4, arrival: Column | None = None, closing: str | None = None) -> str:
    """Writes df as files that a file source reads one after another; returns the folder. ts becomes an instant in UTC.

    By default the files follow each other in event time, cut between different instants, so that a watermark drops nothing: one pass
    over df, dealt by ranges. With arrival, a whole number per row, there is a file for each number, in that order, whatever its event times: rows that come after
    their time stay late. closing (an interval such as "1 hour") adds a last file of one row, null but for ts, that far after the latest, which
    brings the watermark to the end. A file source goes by the files' times of change, which are set in order after the write.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "replay")
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if arrival is None:
        dealt = timed.repartitionByRange(files, ts)
    else:
        numbers = timed.select(arrival.alias("n")).distinct().count()
        dealt = timed.withColumn("_file", arrival).repartitionByRange(max(1, numbers), "_file")
    sort = [ts] if arrival is None else ["_file", ts]
    dealt.sortWithinPartitions(*sort).write.parquet(path, partitionBy=None if arrival is None else "_file")
    if closing:
        last = timed.agg((F.max(ts) + F.expr(f"INTERVAL {closing}")).alias("at"))
        end = last.select(*[(F.col("at") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in timed.schema])
        end.where(F.col(ts).isNotNull()).coalesce(1).write.parquet(f"{path}/end")
    _age(spark, path)
    return path


def _age(spark: SparkSession, path: str) -> None:
    """Gives the files of a folder times of change that follow their names (and the numbers of their folders)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, found = fs.listFiles(root, True), []
    while listed.hasNext():
        file = listed.next().getPath()
        if file.getName().startswith("part-"):
            folder = file.getParent().getName()
            number = int(folder.removeprefix("_file=")) if folder.startswith("_file=") else 2**31 - 1 if folder == "end" else 0
            found.append((number, file.getName(), file))
    newest = max((fs.getFileStatus(f).getModificationTime() for *_, f in found), default=0)
    for i, (*_, file) in enumerate(sorted(found, key=lambda x: x[:2])):
        fs.setTimes(file, newest - 1000 * (len(found) - i), -1)


def source(spark: SparkSession, path: str, schema: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The stream of a replay folder, a file a trigger. Where a broker's connector is on the class path, this is the one place to change."""
    settings = {"maxFilesPerTrigger": 1, "latestFirst": False, "recursiveFileLookup": True, **(options or {})}
    return spark.readStream.schema(schema).options(**settings).parquet(path)


def keyed(df: DataFrame, key: str, partitions: int = 6) -> DataFrame:
    """df with the channel that its key is sent on: rows of one key keep their order on it."""
    return df.withColumn("channel", channel(F.col(key).cast("string"), partitions))


@contextmanager
def _settings(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """The state store of streams that start inside, and their progress kept; the session's own settings again after it."""
    wanted = dict([_RETAINED] + ([(_PROVIDER, provider)] if provider else []))
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(stream: DataFrame, name: str, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives what it wrote: files, as the checkpoint commits after the write."""
    return run_counted(stream, name, mode, provider)[0]


def run_counted(stream: DataFrame, name: str, mode: str = "append", provider: str | None = None) -> tuple[DataFrame, int]:
    """run_once() with the number of rows that the watermark dropped, from the progress of every batch: what is late is counted, not lost silently."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    with _settings(spark, provider):
        query = writer.format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), dropped


def sink_by_batch(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = CHUNK, provider: str | None = None, after: Callable[[int], None] | None = None) -> None:
    """Writes each batch of a stream to a folder of its own, in files of rows_per_file rows at most, and runs to the end of what is there now.

    A batch that runs again after a failure (the checkpoint commits after the write) replaces its own folder, so every row is there once. `after`
    is called with the number of a batch when it is written and before it is committed.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/batch={number}")
        if after:
            after(number)

    with _settings(stream.sparkSession, provider):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tail(stream: DataFrame, wanted: Column, line: Column, checkpoint: str, emit: Callable[[str], None] = print) -> None:
    """Emits a line for each record that is wanted, as batches come; rows reach the driver one partition at a time, never a whole batch."""

    def show(batch: DataFrame, number: int) -> None:
        for row in batch.where(wanted).select(line.alias("line")).toLocalIterator():
            emit(row.line)

    stream.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_day_legs(legs: DataFrame, schedule: DataFrame) -> DataFrame:
    """legs (tail, service_date, position), a stream or not, with legs_today of the schedule, never below the position, and whether the schedule misses the day."""
    side = schedule.select("tail", "service_date", F.col("legs").alias("_legs"))
    joined = legs.join(side, ["tail", "service_date"], "left")
    return joined.withColumns({"legs_today": F.greatest(F.coalesce("_legs", "position"), F.col("position")), "missed": F.col("_legs").isNull()}).drop("_legs")
