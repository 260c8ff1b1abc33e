"""Structured Streaming: queue processing, duplicates, refresh, and batches of a backfill.

Each takes a streaming DataFrame and returns one, or a function for foreachBatch; run()
drains what is there now with an availableNow trigger into a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from time import sleep

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import stale


def source(spark: SparkSession, path: str, files_per_batch: int = 1_000, form: str = "parquet") -> DataFrame:
    """A streaming read of a folder's or file's rows with its schema; files_per_batch bounds each micro-batch."""
    schema = spark.read.format(form).load(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch)
    return stream.option("pathGlobFilter", name).load(folder) if name.endswith("." + form) and not _is_folder(spark, path) else stream.load(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{where or '/tmp/tessera-checkpoints'}/streams/{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drains the stream now and returns what it wrote."""
    spark = stream.sparkSession
    where = scratch(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{where}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batch/n={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(p["batchId"] for p in query.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{where}/batch/n={last}")


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], where: str | None = None) -> None:
    """Runs a foreachBatch function over what is there now; where: the folder of a stream that goes on later."""
    where = where or scratch(stream.sparkSession)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()


def event_time(rows: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone; files hold one without."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def forever_distinct(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key; the state holds every key seen and grows with them."""
    return stream.dropDuplicates([key])


def distinct_within(stream: DataFrame, key: str, time: str, span: str = "7 days") -> DataFrame:
    """The first row of each key within the span; older keys leave the state."""
    return event_time(stream, time).withWatermark(time, span).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, span: str, late: str, by: list[str]) -> DataFrame:
    """Counts by event-time windows (an extension: the listings themselves have no such query)."""
    timed = event_time(stream, time).withWatermark(time, late)
    return timed.groupBy(F.window(time, span), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def latest_of(stream: DataFrame, time: str, *columns: str) -> DataFrame:
    """One row: the newest of a stream by time (the state that a page polls)."""
    return stream.agg(F.max(F.struct(time, *columns)).alias("_last")).select("_last.*")


def rounds(fetch: Callable[[int, int], DataFrame], quota: int, most: int = 5, wait: float = 0) -> DataFrame | None:
    """What the rounds 1 to most of fetch(round, rows still wanted) bring, until there are quota rows. Each round is written before
    the next begins, wait seconds later."""
    got, left = None, quota
    for number in range(1, most + 1):
        if number > 1 and wait:
            sleep(wait)
        rows = fetch(number, left).limit(left)
        path = f"{scratch(rows.sparkSession)}/round"
        rows.write.parquet(path)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
        got, left = rows if got is None else got.unionByName(rows), left - rows.count()
        if left <= 0:
            break
    return got


def backfill(rows: DataFrame, source: str, target: str, embed: Callable[[list[str]], list[list[float]]], size: int = 10) -> DataFrame:
    """rows with every missing target (a vector) made of its source text, by calls of embed with size texts at most, until none is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch.column(source).to_pylist(), []
            for a in range(0, len(texts), size):
                made += embed([t or "" for t in texts[a : a + size]])
            at = batch.schema.get_field_index(target)
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    return rows.filter(F.col(target).isNotNull()).unionByName(rows.filter(F.col(target).isNull()).mapInArrow(run, rows.schema))


def requeue(rows: DataFrame, now: Column, days: int = 10) -> DataFrame:
    """Queue rows of stale listings (id, url, source, updated_at)."""
    return stale(rows, now, days).select("id", F.lit("pending").alias("status"), now.alias("requested_at"), F.concat(F.lit("Monitoring: "), "source").alias("source_name"), "url")


def retained(messages: DataFrame, now: Column, days: int, time: str = "created_at") -> DataFrame:
    """Messages of the last days."""
    return messages.filter(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS"))
