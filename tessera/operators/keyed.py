"""A keyed table of hash buckets that batches are merged into: a base and small deltas for each bucket, put together when read.

A folder of Parquet layers and of versions.  merge() writes the batch's rows (of each key one) as a layer with a file for each bucket that has any, and
nothing else; compact() gives buckets with several deltas a new base. A version is a small file that says which layers each bucket has, in the
order of their commits. Versions are made one after another: a version is moved to its name by a rename that fails where the name is taken, so a writer that is
overtaken commits its layer on top of what the other one has made, and no writer's rows are lost.  Rows of an older version stay readable until vacuum().

Merging: in a table with order columns the latest row of each key counts, by them and then by commit, so rows may come in any order. In one without, of each key and column
the value committed last among the rows that supply the column (null included) counts, and others keep; a key that was deleted has what came since.  A batch of a stream that has been merged is known by (stream, number) and changes nothing when it comes again.

Defined cases: rows whose key is null are one key; of several rows of a batch with one key the latest by the order columns counts, with none an
arbitrary one; an empty batch makes a version without a layer; columns that only some layers have are null in the others' rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas of a bucket from which compact() rewrites it.
DELTAS = 4
_SET, _GONE, _LAYER = "_set", "_gone", "_layer"


class Overtaken(RuntimeError):
    """Another writer has made the version that was to be made."""


@dataclass
class Version:
    """The layers of each bucket, oldest first, and the last batch of each stream."""

    number: int = 0
    buckets: dict[str, list[str]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    #: A layer's columns with their types, as JSON.
    schema: str | None = None

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "applied": self.applied, "schema": self.schema})


class KeyedTable:
    """on: the key column; order: columns by which the latest row of a key is told (none: by commit)."""

    def __init__(self, spark: SparkSession, path: str, on: str, order: list[str] | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.on, self.order, self.buckets = spark, path.rstrip("/"), on, order or [], buckets
        self._hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(conf)
        self._files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)

    # versions

    def _names(self, folder: str) -> list[str]:
        where = self._hadoop.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("versions") if n[:1] == "v" and n[1:].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version (the newest); version 0 is the empty table."""
        known = self.versions()
        number = max(known, default=0) if number is None else number
        if not number:
            return Version()
        held = json.loads(self.spark.read.text(f"{self.path}/versions/v{number:08d}", wholetext=True).first().value)
        return Version(number, **held)

    def _commit(self, made: Version, base: int) -> int:
        """Makes a version after base; Overtaken if there is one."""
        aside, final = (self._hadoop.Path(f"{self.path}/versions/{n}") for n in (f"_{uuid.uuid4().hex}", f"v{base + 1:08d}"))
        out = self._fs.create(aside, False)
        out.write(bytearray(made.text().encode()))
        out.close()
        try:
            self._files.rename(aside, final, self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0))
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Overtaken(f"version {base + 1} has been made by another writer") from None
            raise
        return base + 1

    # writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.on), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new layer of rows (with bucket), a file for each bucket that has any; its name and buckets."""
        layer = uuid.uuid4().hex
        rows.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/layers/{layer}")
        return layer, [n.partition("=")[2] for n in self._names(f"layers/{layer}") if n.startswith("bucket=")]

    def merge(self, rows: DataFrame, stream: str | None = None, batch: int = 0, expect: int | None = None, gone: Column | None = None) -> int:
        """Merges rows and returns the version that has them. stream, batch: known batches change nothing. expect: the version that must be
        the newest (Overtaken if it isn't). gone: of rows whose key is deleted, true.
        """
        before = self.version()
        if expect is not None and before.number != expect:
            raise Overtaken(f"version {before.number} is newer than {expect}")
        if stream is not None and before.applied.get(stream, -1) >= batch:
            return before.number
        given = [c for c in rows.columns if c != self.on]
        marked = rows.withColumn(_GONE, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        value = F.struct(*self.order, *(c for c in [*given, _GONE] if c not in self.order)) if self.order else None
        chosen = F.max(value) if self.order else F.first(F.struct(*given, _GONE))
        one = marked.groupBy(self.on).agg(chosen.alias("_row")).select(self.on, "_row.*")
        layer, touched = self._write(one.withColumn(_SET, F.array(*map(F.lit, given)).cast("array<string>")).withColumn("bucket", self._bucket()))
        fields = T.StructType([*(f for f in rows.schema if f.name != _GONE)])
        while True:
            buckets = {b: list(x) for b, x in before.buckets.items()}
            for b in touched:
                buckets.setdefault(b, []).append(layer)
            made = Version(before.number + 1, buckets, before.applied | ({stream: batch} if stream is not None else {}), _widened(before.schema, fields))
            try:
                return self._commit(made, before.number)
            except Overtaken:
                if expect is not None:
                    raise
                before = self.version()
                if stream is not None and before.applied.get(stream, -1) >= batch:
                    return before.number

    def each(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that merges every batch of a stream of that name once."""
        return lambda rows, number: (self.merge(rows, stream, number), None)[1]

    # reading

    def _layers(self, version: Version, buckets: set[str] | None = None) -> DataFrame | None:
        """Rows of the layers that the version names, with _layer (its place among the bucket's layers) and bucket."""
        schema = T.StructType([*T.StructType.fromJson(json.loads(version.schema)), T.StructField(_SET, T.ArrayType(T.StringType())), T.StructField(_GONE, T.BooleanType())]) if version.schema else None
        places: dict[tuple[str, int], list[str]] = {}
        for b, layers in version.buckets.items():
            for place, layer in enumerate(layers):
                if buckets is None or b in buckets:
                    places.setdefault((layer, place), []).append(b)
        out = None
        by_place: dict[int, list[str]] = {}
        for (layer, place), of in places.items():
            by_place.setdefault(place, []).extend(f"{self.path}/layers/{layer}/bucket={b}" for b in of)
        for place, paths in sorted(by_place.items()):
            rows = self.spark.read.schema(schema).parquet(*paths).withColumns({_LAYER: F.lit(place), "bucket": self._bucket()})
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version (the newest). Buckets with one layer are read as they are; the others' rows meet by key."""
        now = self.version(version)
        if now.schema is None:
            raise ValueError(f"{self.path} has no rows yet: its columns aren't known")
        columns = [f["name"] for f in json.loads(now.schema)["fields"]]
        single = {b for b, layers in now.buckets.items() if len(layers) == 1}
        several = set(now.buckets) - single
        parts = []
        if single:
            parts.append(self._layers(now, single).filter(~F.col(_GONE)).select(columns))
        if several:
            parts.append(self._merged(self._layers(now, several), columns).filter(~F.col(_GONE)).select(columns))
        empty = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(now.schema)))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else empty

    def _merged(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """One row of each key, with _set and _gone: the latest row of a table with order columns, else the latest value of each column since the key was last gone."""
        others = [c for c in columns if c != self.on]
        at = F.struct(*self.order, _LAYER)
        if self.order:
            return rows.groupBy(self.on).agg(F.max_by(F.struct(*others, _SET, _GONE), at).alias("_row")).select(self.on, "_row.*")
        lost, alive = F.max(F.when(F.col(_GONE), F.col(_LAYER))), F.max(F.when(~F.col(_GONE), F.col(_LAYER)))
        latest = [F.max_by(F.struct(F.col(c).alias("value"), _LAYER), F.when(F.array_contains(_SET, c) & ~F.col(_GONE), F.col(_LAYER))).alias(c) for c in others]
        found = rows.groupBy(self.on).agg(lost.alias("_lost"), alive.alias("_alive"), F.array_distinct(F.flatten(F.collect_set(_SET))).alias(_SET), *latest)
        since = lambda place: F.col("_lost").isNull() | (place > F.col("_lost"))
        values = [F.when(since(F.col(c)[_LAYER]), F.col(c)["value"]).alias(c) for c in others]
        return found.filter(F.col("_alive").isNotNull() & since(F.col("_alive"))).select(self.on, *values, _SET, F.lit(False).alias(_GONE))

    # upkeep

    def compact(self, deltas: int = DELTAS) -> list[str]:
        """Gives each bucket with so many layers above its base one new base, and returns these buckets; they alone are read and written."""
        before = self.version()
        due = {b for b, layers in before.buckets.items() if len(layers) > deltas}
        if not due:
            return []
        columns = [f["name"] for f in json.loads(before.schema)["fields"]]
        layer, touched = self._write(self._merged(self._layers(before, due), columns).withColumn("bucket", self._bucket()))
        while True:
            now = self.version()
            # what was put together is still below what has come since, or another compaction has been first
            if any(now.buckets.get(b, [])[: len(before.buckets[b])] != before.buckets[b] for b in due):
                return []
            buckets = dict(now.buckets)
            for b in due:
                buckets[b] = ([layer] if b in touched else []) + now.buckets[b][len(before.buckets[b]) :]
            try:
                self._commit(Version(now.number + 1, {b: x for b, x in buckets.items() if x}, now.applied, now.schema), now.number)
                return sorted(due)
            except Overtaken:
                continue

    def vacuum(self, keep: int = 2) -> int:
        """Drops all versions but the newest ones, and the layers that none of these names and that are older than they; the number of layers dropped.

        A writer that began before the oldest kept version must not be running still: its layer isn't named yet.
        """
        known = self.versions()
        for number in known[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/versions/v{number:08d}"), False)
        named = {layer for n in known[-keep:] for layers in self.version(n).buckets.values() for layer in layers}
        oldest = min((self._fs.getFileStatus(self._hadoop.Path(f"{self.path}/versions/v{n:08d}")).getModificationTime() for n in known[-keep:]), default=0)
        dropped = 0
        for layer in self._names("layers"):
            where = self._hadoop.Path(f"{self.path}/layers/{layer}")
            if layer not in named and self._fs.getFileStatus(where).getModificationTime() < oldest:
                self._fs.delete(where, True)
                dropped += 1
        return dropped


def _widened(known: str | None, more: T.StructType) -> str:
    """The columns of both schemas as JSON."""
    held = T.StructType.fromJson(json.loads(known)) if known else T.StructType()
    names = {f.name for f in held}
    return T.StructType([*held, *(T.StructField(f.name, f.dataType) for f in more if f.name not in names)]).json()
