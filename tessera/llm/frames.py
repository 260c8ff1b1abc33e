"""Small helpers that every operator of the subpackage shares."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: With this, an execution's shuffle files go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch at most, where the session has Spark's usual 10,000: whole texts travel in them, and JVM and Python hold a batch or two each.
BATCH, _BATCH_KEY = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of our own is set only where the session has none and runs on one machine (as in tests).
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = "/tmp/tessera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def run_dir(spark: SparkSession) -> str:
    """The folder of the tables that this application has written."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this application has written: for when its results are stored, since DataFrames that read them can't be run any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a compressed Parquet table in the shared folder, read again.

    Cuts the lineage: what a lost executor had done is read, not done again.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    small_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


#: Bytes of a row group of written tables: a task holds one in memory.
ROW_GROUP = 16 << 20


def fresh(df: DataFrame, name: str) -> str:
    """name, or that with underscores before it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def range_bounds(df: DataFrame, key: str, blocks: int) -> list[int]:
    """At most blocks - 1 keys, present in df, that split it by key into runs of like row counts.

    Only the key column is read; the driver gets one number for each block.
    """
    blocks = max(1, min(blocks, 20_000))
    if blocks == 1:
        return []
    at = [i / blocks for i in range(1, blocks)]
    row = df.select(F.percentile_approx(key, at, max(10_000, 20 * blocks)).alias("q"), F.min(key).alias("least")).first()
    return sorted(set(row.q or []) - {row.least})


def constant(numbers: list[int]) -> Column:
    """A constant array of integers, as one short expression however long it is."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def block_of(key: str, bounds: list[int]) -> Column:
    """The number of bounds that are not above the key (a null key: 0), by a look at every step-th bound and then within a step."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    col = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    base = F.size(F.filter(constant(bounds[step - 1 :: step]), lambda e: e <= col)) * step
    return (base + F.size(F.filter(F.slice(constant(bounds), base + 1, F.lit(step)), lambda e: e <= col))).cast("int")


#: Bounds of runs, at most, since they travel in the plan.
BOUNDS = 20_000
#: Keys sampled for each bound: they decide how alike blocks are in size, and nothing else.
SAMPLED = 100


def run_of(df: DataFrame, key: str, blocks: int) -> Column:
    """The block of each row: about that many runs of an integer key, in its order (a null key comes first).

    Beyond BOUNDS, the keys between two bounds are cut into equal spans: blocks don't grow with the data where keys lie evenly between
    neighbouring bounds, and rows with one key share a block always.
    """
    keys = df.select(F.col(key).cast("bigint").alias("key")).filter("key is not null")
    runs = min(blocks, BOUNDS)
    share = SAMPLED * runs / max(1, keys.count())
    bounds = range_bounds(keys if share >= 1 else keys.sample(share, 7), "key", runs)
    run, spans = block_of(key, bounds), -(-blocks // runs)
    ends = keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).first() if spans > 1 else None
    if ends is None or ends.low is None:
        return run
    edges = constant([ends.low, *bounds, ends.high])
    low, high = F.get(edges, run).cast("double"), F.get(edges, run + 1).cast("double")
    part = (F.col(key).cast("double") - low) / F.nullif(high - low, F.lit(0.0))
    span = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * spans), F.lit(spans - 1))
    return (run * spans + span).cast("int")


def total_bytes(df: DataFrame, name: str = "text") -> int:
    """Octets of a text column; one number comes to the driver."""
    return df.select(F.sum(F.octet_length(name)).alias("n")).first().n or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(block: pa.Table) -> list[int]:
    """Row numbers of a block (doc_id, text) in order of doc_id (null first) and text."""
    ids, texts = block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
