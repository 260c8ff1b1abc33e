"""Counts that a plan tells, tables kept by day, counters taken while writing, exports as SQL, and functions that make rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Analyzed:
    """A table whose row count and column histograms are stored, so that plans over it know how many rows they make."""

    def __init__(self, rows: DataFrame, columns: list[str]) -> None:
        """Saves rows as a table of the session's catalog and analyses the columns that filters will be on."""
        self.spark, self.name = rows.sparkSession, f"analyzed_{uuid.uuid4().hex}"
        rows.write.format("parquet").saveAsTable(self.name)
        with _set(self.spark, {"spark.sql.statistics.histogram.enabled": "true"}):
            self.spark.sql(f"analyze table {self.name} compute statistics for columns {', '.join(columns)}")

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


class _set:
    """Settings for a while."""

    def __init__(self, spark: SparkSession, values: dict[str, str]) -> None:
        self.spark, self.values = spark, values

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def planned_count(rows: DataFrame) -> int | None:
    """The rows that the optimised plan expects, without running it; None if the plan doesn't say (its tables aren't analysed)."""
    with _set(rows.sparkSession, {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.planStats.enabled": "true"}):
        again = DataFrame(rows.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(rows.sparkSession._jsparkSession, rows._jdf.queryExecution().logical()), rows.sparkSession)
        said = again._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(said.get())) if said.isDefined() else None


def keep_by_day(messages: DataFrame, path: str, time: str = "created_at") -> None:
    """Appends messages to a table of one folder for each day."""
    messages.withColumn("day", F.to_date(time)).repartition("day", F.pmod(F.xxhash64(*messages.columns), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def retain(spark: SparkSession, path: str, oldest: str, time: str = "created_at") -> tuple[list[str], list[str]]:
    """Drops what is older than oldest (a timestamp as text): days before its own go as folders, without a look inside, and its own day is written anew.

    (days dropped, days written). Done again, it changes nothing; a job that dies while the one day is written leaves the day as it was, or the new one.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop.Path(path).getFileSystem(conf)
    days = sorted(s.getPath().getName()[4:] for s in files.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("day="))
    edge = oldest[:10]
    gone = [d for d in days if d < edge]
    for d in gone:
        files.delete(hadoop.Path(f"{path}/day={d}"), True)
    if edge not in days:
        return gone, []
    today, aside = f"{path}/day={edge}", f"{path}/_aside-{uuid.uuid4().hex}"
    rows = spark.read.parquet(today)
    late = F.col(time) < F.lit(oldest).cast(rows.schema[time].dataType)
    if not rows.filter(late).limit(1).count():
        return gone, []
    rows.filter(~late | F.col(time).isNull()).write.parquet(aside)
    files.delete(hadoop.Path(today), True)
    files.rename(hadoop.Path(aside), hadoop.Path(today))
    return gone, [edge]


def saved_with_counts(rows: DataFrame, path: str, **counters: Column) -> dict[str, int]:
    """Writes rows and returns counters (of rows for which a condition is true) and n, all rows, taken in the pass that writes; no second scan."""
    seen = Observation(f"run-{uuid.uuid4().hex}")
    taken = [F.count(F.lit(1)).alias("n"), *(F.count(F.when(c, 1)).alias(name) for name, c in counters.items())]
    rows.observe(seen, *taken).write.parquet(path)
    return seen.get


_SQL_TYPES = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "REAL", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.StringType: "VARCHAR"}


def _sql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{_sql_type(kind.elementType)}[]"
    return _SQL_TYPES[type(kind)]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_literal(value: Column, kind: T.DataType) -> Column:
    """A value as SQL text."""
    if isinstance(kind, T.StringType):
        said = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        said = F.concat(F.lit(_sql_type(kind) + " '"), value.cast("string"), F.lit("'"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        said = F.concat(F.lit("'"), value.cast("string"), F.lit(f"'::{_sql_type(kind)}"))  # NaN and infinities too
    elif isinstance(kind, T.ArrayType):
        said = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: sql_literal(x, kind.elementType)), ", "), F.lit(f"]::{_sql_type(kind)}"))
    else:
        said = value.cast("string")
    return F.coalesce(said, F.lit("NULL"))


def sql_export(tables: dict[str, DataFrame], limit: int = 1000) -> DataFrame:
    """place, statement: the statements that make each table and its first rows (10,000 of each at most: the limit is the feature)."""
    out = None
    for n, (name, rows) in enumerate(tables.items()):
        columns = ", ".join(f"{_quoted(f.name)} {_sql_type(f.dataType)}" for f in rows.schema)
        create = rows.sparkSession.createDataFrame([(f"{n:04d}a", f"CREATE TABLE {_quoted(name)} ({columns})")], "place string, statement string")
        values = F.concat_ws(", ", *(sql_literal(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema))
        insert = rows.limit(min(limit, 10_000)).select(F.lit(f"{n:04d}b").alias("place"), F.concat(F.lit(f"INSERT INTO {_quoted(name)} VALUES ("), values, F.lit(")")).alias("statement"))
        both = create.unionByName(insert)
        out = both if out is None else out.unionByName(both)
    return out


@F.udtf(returnType="title string, price string, city string")
class ReadReply:
    """The items of a reply, as rows: a fenced or plain JSON object with properties, or a JSON array; anything else has none."""

    def eval(self, reply: str) -> Iterator[tuple]:
        said = (reply or "").strip()
        if "```json" in said:
            said = said.split("```json", 1)[1].split("```", 1)[0]
        try:
            read = json.loads(said)
        except ValueError:
            return
        items = read.get("properties") if isinstance(read, dict) else read
        for item in items if isinstance(items, list) else ():
            if isinstance(item, dict):
                yield tuple(None if item.get(k) is None else str(item[k]) for k in ("title", "price", "city"))


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to SQL by name: ``select ... from replies, lateral read_reply(reply)``."""
    spark.udtf.register("read_reply", ReadReply)
