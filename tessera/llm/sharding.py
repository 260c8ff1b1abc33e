"""Sharding by size-tiered compaction, with DataFrame functions only.

A store is a folder.  Every arrival is appended as small immutable shards (Parquet
files), each row dealt to a shard by hash so that a hot source or key is spread evenly.
Compaction puts shards of like size (within one power of TIER) together
into files near the target size, level by level, until no tier holds enough of them.

What is in the store is said by its newest manifest, a table with one row for each shard. A version follows from
the version that its writer has read: its manifest is written aside, and a small file that names it
is moved to the next version's name, which fails if another writer has been first (an atomic step in HDFS). Then the change is made anew on the
newest version, so no writer undoes another's; a compaction whose shards are gone meanwhile is planned anew. Readers of
an older version keep what they had.  A job that dies leaves files that no manifest names.

Defined cases: null and empty texts and any other columns are stored as they are; repeated
rows stay repeated; a row longer than the target is a shard larger than it; an empty
table makes a version without shards; the rows' own columns may have any names, since
the columns that the store adds are named around them (read() says how).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.frames import CLEANUP, fresh, shared_dir, table, written

SMALL_BYTES = 2 << 20
TARGET_BYTES = 16 << 20
#: Shards whose sizes are within a factor of TIER of each other are of one tier; so many of one tier are merged.
TIER, RUN = 4, 4
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("run", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("level", T.IntegerType())])


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


class Store:
    """A store of shards in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, small: int = SMALL_BYTES) -> None:
        self.spark, self.path, self.target, self.small = spark, path.rstrip("/"), target, small
        self._hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._hadoop.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)

    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/versions")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def newest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, run, rows, bytes, level of each shard of a version (the newest)."""
        version = self.newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        with_name = self.spark.read.text(f"{self.path}/versions/v{version:08d}").first()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{with_name.value}")

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Makes manifest the version after base, the one that it was made from; Conflict if there is such a version."""
        name = uuid.uuid4().hex
        self._write(manifest.select([f.name for f in MANIFEST]), f"{self.path}/manifests/{name}")
        aside, final = self._path(f"{self.path}/versions/_{name}"), self._path(f"{self.path}/versions/v{base + 1:08d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        no_overwrite = gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._files.rename(aside, final, no_overwrite)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {base + 1} has been committed by another writer") from None
            raise
        return base + 1

    def change(self, added: DataFrame, removed: DataFrame | None = None) -> int | None:
        """Commits the newest version with shards added (manifest rows) and removed (path), anew whenever another writer is
        first; None if shards to be removed are no longer there."""
        while True:
            base = self.newest()
            now = self.manifest(base)
            if removed is not None:
                if removed.join(now, "path", "left_anti").limit(1).count():
                    return None
                now = now.join(removed.select("path"), "path", "left_anti").select([f.name for f in MANIFEST])
            try:
                return self.commit(now.unionByName(added), base)
            except Conflict:
                continue

    def _write(self, df: DataFrame, path: str, by: str | None = None) -> None:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)

    def _listed(self, run: str, level: int) -> DataFrame:
        """The manifest rows of a run's files, from the files' own metadata."""
        files = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/runs/{run}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return files.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).select("path", F.lit(run).alias("run"), "rows", "bytes", F.lit(level).alias("level"))

    def append(self, df: DataFrame, key: Column, weight: Column) -> int:
        """Adds the rows of df, one arrival, as small shards, in one version. key: what rows are dealt by; weight: a row's size in bytes."""
        about = df.agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).first()
        if not about.n:
            return self.change(self.spark.createDataFrame([], MANIFEST))
        run, shards = uuid.uuid4().hex, max(1, -(-int(about.w or 0) // self.small))
        self._write(df.repartitionById(shards, F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")), f"{self.path}/runs/{run}")
        return self.change(self._listed(run, 0))

    def _small(self, version: int | None = None) -> DataFrame:
        tier = F.floor(F.log(float(TIER), F.greatest(F.col("bytes"), F.lit(1)))).cast("int")
        return self.manifest(version).filter(F.col("bytes") < self.target // 2).withColumn("tier", tier)

    def tiers(self) -> DataFrame:
        """tier, n: small shards of the newest version by tier."""
        return self._small().groupBy("tier").agg(F.count(F.lit(1)).alias("n"))

    def plan(self) -> DataFrame:
        """path, run, level and group (from 0) of the shards to be merged now: of each tier with RUN small shards, groups of about the target size.

        Sums run within (tier, bucket), where buckets hold some hundred shards, so no task sees all shards of a tier; one task
        sees one row for each bucket, to number the groups.
        """
        small = self._small()
        counts = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
        buckets = F.greatest(F.lit(1), F.floor(F.col("n") / 256)).cast("int")
        placed = small.join(counts.filter(F.col("n") >= RUN), "tier").withColumn("bucket", F.pmod(F.xxhash64("path"), buckets).cast("int"))
        before = F.sum("bytes").over(W.partitionBy("tier", "bucket").orderBy("path"))
        dealt = placed.select("path", "run", "level", "tier", "bucket", F.floor((before - F.col("bytes")) / self.target).cast("int").alias("g"))
        sizes = dealt.groupBy("tier", "bucket").agg((F.max("g") + 1).alias("groups"))
        first = F.sum("groups").over(W.orderBy("tier", "bucket")) - F.col("groups")
        return dealt.join(sizes.withColumn("first", first), ["tier", "bucket"]).select("path", "run", "level", (F.col("first") + F.col("g")).cast("int").alias("group"))

    def compact(self, schema: T.StructType) -> int:
        """Merges until no tier holds RUN small shards or merging makes no fewer; the newest version."""
        while True:
            plan = written(self.plan(), "plan")
            groups = plan.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            chosen = written(plan.join(groups, "group").select("path", "run", "level", "group"), "chosen")
            about = chosen.agg(F.max("group").alias("last"), F.max("level").alias("level")).first()
            if about.last is None:
                return self.newest()
            run = uuid.uuid4().hex
            runs = [f"{self.path}/runs/{r.run}" for r in chosen.select("run").distinct().toLocalIterator()]
            old = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*runs)
            shard, group = fresh(old, "_shard"), fresh(old, "_group")
            held = old.withColumn(shard, F.col("_metadata.file_path")).join(chosen.select(F.col("path").alias(shard), F.col("group").alias(group)), shard).drop(shard)
            # a partition, and so a file, for each group
            self._write(held.repartitionById(int(about.last) + 1, F.col(group)).drop(group), f"{self.path}/runs/{run}")
            self.change(self._listed(run, about.level + 1), chosen.select("path"))

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of a version with _shard (under more underscores if that is a column), the path of the shard of each: only files that its manifest names count."""
        manifest = self.manifest(version)
        runs = [f"{self.path}/runs/{r.run}" for r in manifest.select("run").distinct().toLocalIterator()]
        empty = self.spark.createDataFrame([], schema)
        shard = fresh(empty, "_shard")
        if not runs:
            return empty.withColumn(shard, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*runs).withColumn(shard, F.col("_metadata.file_path"))
        return rows.join(manifest.select(F.col("path").alias(shard)), shard, "left_semi")


#: Arrivals of the query: sources are dealt to them by the hash of their name.
ARRIVALS = 4


def arrival(source: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 2), 16, 10).cast("int"), F.lit(ARRIVALS))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS turns, by source, each an append and version of its own; they are compacted and read back through the newest manifest.

    doc_id, n_chars, text_sha256 of each row and whether its shard keeps to the target size; and of the store: version_rows (rows of the
    versions of the arrivals, comma-joined), store_rows (rows of the newest version), full_tiers (tiers that hold RUN small shards still).
    """
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 32
    made = [store.append(docs.filter(arrival(F.col("source")) == n), F.struct("doc_id", "source"), weight) for n in range(ARRIVALS)]
    store.compact(docs.schema)
    rows_of = lambda version: store.manifest(version).agg(F.sum("rows")).first()[0] or 0
    sizes = store.manifest().select(F.col("path").alias("_shard"), "bytes")
    facts = {"version_rows": F.lit(",".join(str(rows_of(v)) for v in made)), "store_rows": F.lit(rows_of(None)).cast("long"), "full_tiers": F.lit(store.tiers().filter(F.col("n") >= RUN).count()).cast("long")}
    return store.read(docs.schema).join(sizes, "_shard").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), (F.col("bytes") <= 2 * TARGET_BYTES).alias("shard_ok"), *(v.alias(c) for c, v in facts.items()))
