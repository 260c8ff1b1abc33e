"""Changes of keyed tables as DataFrames: Parquet has no MERGE, so each returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, on: str, ignore_duplicates: bool = False) -> DataFrame:
    """stored with new rows merged by key: the columns that new has overwrite (with null too), others keep.

    ignore_duplicates: rows of known keys are left as they are. new has one row for each key.
    """
    if ignore_duplicates:
        return stored.unionByName(new.join(stored.select(on), on, "left_anti"), allowMissingColumns=True)
    given = [c for c in new.columns if c != on]
    both = stored.withColumn("_old", F.lit(True)).join(new.select(on, F.struct(*given, F.lit(True).alias("_new")).alias("_n")), on, "full_outer")
    is_new = F.col("_n").isNotNull()
    held = [F.col(on)]
    for c in [c for c in stored.columns if c != on]:
        held.append((F.when(is_new, F.col(f"_n.{c}")).otherwise(F.col(c)) if c in given else F.col(c)).alias(c))
    held += [F.col(f"_n.{c}").alias(c) for c in given if c not in stored.columns]
    return both.select(*held)


def update_where(stored: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns in the rows for which the condition is true (not null)."""
    hit = F.coalesce(condition, F.lit(False))
    return stored.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def update_keys(stored: DataFrame, keys: DataFrame, on: str, values: dict[str, Column]) -> DataFrame:
    """The same for a table of keys of any size."""
    marked = stored.join(keys.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return update_where(marked, F.col("_hit"), values).select(stored.columns)


def patch(stored: DataFrame, patches: DataFrame, on: str, sets: str | None = None) -> DataFrame:
    """Each stored row with the values of its patch, row by row: the columns that patches has overwrite, with null too; unknown keys are ignored.

    sets: a column of patches with the names of the columns that the row's patch sets; the others stay. patches has one row for each key at most.
    """
    given = [c for c in patches.columns if c not in (on, sets)]
    fields = F.struct(*given, *([F.col(sets).alias("_sets")] if sets else []), F.lit(True).alias("_hit"))
    both = stored.join(patches.select(on, fields.alias("_p")), on, "left")
    hit = lambda c: F.coalesce(F.array_contains("_p._sets", c), F.lit(False)) if sets else F.col("_p._hit").isNotNull()
    return both.select([F.when(hit(c), F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in stored.columns])


def patch_latest(stored: DataFrame, order: Sequence[Column], on: str, values: dict[str, Column]) -> DataFrame:
    """Sets columns of the first row by the order (the latest request, say)."""
    return update_keys(stored, stored.orderBy(*order).limit(1), on, values)


def scored_and_saved(stored: DataFrame, found: DataFrame, on: str, score: Column) -> DataFrame:
    """The stored table with the rows found merged in. Their score is overwritten by score, whatever a source gave them."""
    return upsert(stored, found.withColumn("opportunity_score", score), on)


def delete_keys(stored: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return stored.join(keys.select(on), on, "left_anti")


def insert(stored: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """stored and rows under the union of their columns; missing values are null or the default."""
    missing = {c: v for c, v in (defaults or {}).items() if c not in rows.columns}
    return stored.unionByName(rows.withColumns(missing) if missing else rows, allowMissingColumns=True)


def guarded(changed: DataFrame, most: int) -> DataFrame:
    """changed, or ValueError if it has over most rows; the count stops there."""
    if changed.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are affected")
    return changed


def transition(queue: DataFrame, claimed: DataFrame, status: str, now: Column) -> DataFrame:
    """The queue with the claimed rows (id) in a new status; completed ones get processed_at."""
    done = F.lit(status) == "completed"
    return update_keys(queue, claimed, "id", {"status": F.lit(status), "processed_at": F.when(done, now).otherwise(F.col("processed_at"))})


def altered(stored: DataFrame, add: dict[str, str] | None = None, drop: Sequence[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """The table with columns dropped, renamed and added (null, of a type)."""
    out = stored.drop(*drop).withColumnsRenamed(rename or {})
    return out.withColumns({c: F.lit(None).cast(t) for c, t in (add or {}).items()}) if add else out


def check_keys(stored: DataFrame, unique: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """Rules that are broken (rule, rows): Spark enforces neither keys nor nulls."""
    twice = stored.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("unique").alias("rule"), "rows")
    for c in not_null:
        twice = twice.unionByName(stored.filter(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"{c} is not null").alias("rule"), "rows"))
    return twice.filter("rows > 0")


def save(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a table as parquet, orc, json or csv."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def load(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    """Reads json or csv with a given schema; a bulk import is load() and then upsert()."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if form == "csv" else reader).format(form).load(path)


def geojson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Each row as a GeoJSON feature."""
    others = [c for c in df.columns if c not in (x, y)]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))).alias("feature"))


def export(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows as JSON text, 10,000 at most: the limit is the feature."""
    return df.limit(min(limit, 10_000)).select(F.to_json(F.struct(*df.columns)).alias("row"))
