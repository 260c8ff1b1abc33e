"""Joins, duplicates, paging and windows of listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import matches


def lookup(rows: DataFrame, dimension: DataFrame, on: str, first_by: str) -> DataFrame:
    """Left join with the first dimension row of each key; Catalyst broadcasts a small dimension by its size."""
    one = dimension.groupBy(on).agg(*[F.min_by(c, first_by).alias(c) for c in dimension.columns if c != on])
    return rows.join(one, on, "left")


def unprocessed(rows: DataFrame, processed: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't among the processed ones."""
    return rows.join(processed.select(on).distinct(), on, "left_anti")


def existing(rows: DataFrame, stored: DataFrame, on: str) -> DataFrame:
    """Rows whose key is stored."""
    return rows.join(stored.select(on), on, "left_semi")


def keep_first(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key by the order. An aggregate, combined before the shuffle, so a hot key is no hot task."""
    held = rows.withColumn("_key", key)
    first = F.min(F.struct(*order, F.struct(*rows.columns).alias("_row"))).alias("_first")
    return held.groupBy("_key").agg(first).select("_first._row.*")


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """total, distinct and duplicate counts of a key."""
    return rows.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_keys"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def page(rows: DataFrame, number: int, order: Sequence[Column], size: int = 20) -> DataFrame:
    """A page from 1; a top-k with an offset, not a sort of all rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def row_range(rows: DataFrame, first: int, last: int, order: Sequence[Column]) -> DataFrame:
    """Rows first to last of an order, both included, from 0."""
    return rows.orderBy(*order).offset(first).limit(last - first + 1)


def page_count(rows: DataFrame, size: int = 20) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("bigint").alias("pages"))


def page_buttons(page: Column, pages: Column) -> Column:
    """Pages from two before to two after."""
    return F.sequence(F.greatest(F.lit(1), page - 2), F.least(pages, page + 2))


def tail(rows: DataFrame, key: str, order: str, n: int = 4) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def last_items(items: Column, n: int = 4) -> Column:
    """The last n of an array, all of a shorter one."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def latest(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(1)


def single(rows: DataFrame, allow_none: bool = False) -> dict | None:
    """The only row; ValueError for more than one, and for none unless allowed."""
    two = rows.take(2)
    if len(two) > 1 or not two and not allow_none:
        raise ValueError("more than one row" if two else "no row")
    return two[0].asDict() if two else None


def take_quota(rows: DataFrame, quota: int, order: Sequence[Column]) -> DataFrame:
    """At most quota rows over all groups, by group order and row order."""
    return rows.orderBy(*order).limit(quota)


def quota_of(*numbers: int | None) -> int:
    """The first number that is neither missing nor 0 (a request's, the settings', ...)."""
    return next((n for n in numbers if n), 10)


def shown(rows: DataFrame, term: str = "", category: object = None, mode: str = "all", hot: int = 80) -> DataFrame:
    """What a dashboard shows of rows (title, city, category, score, is_individual): those that match the term and, if a category is
    chosen, are of it, whatever the mode; else in mode hot those of a score of hot or more, in mode individual private sellers' ones."""
    kept = rows.filter(matches(term, F.col("title"), F.col("city")))
    if category is not None:
        return kept.filter(F.col("category") == category)
    modes = {"all": F.lit(True), "hot": F.coalesce(F.col("score") >= hot, F.lit(False)), "individual": F.coalesce("is_individual", F.lit(False))}
    return kept.filter(modes[mode])


def next_pending(queue: DataFrame) -> DataFrame:
    """The one row of a queue (id, status, requested_at, ...) to be worked on next: the oldest pending one, the smallest id of several."""
    return queue.filter("status = 'pending'").orderBy(F.asc_nulls_first("requested_at"), F.asc("id")).limit(1)


def within_limits(rows: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """Rows within a user's limits ("min_" or "max_" and a column); a limit that is missing or 0 doesn't count, and a null value is outside."""
    for name, value in limits.items():
        if value:
            kind, _, column = name.partition("_")
            rows = rows.filter(F.col(_LIMITED.get(column, column)) >= value if kind == "min" else F.col(_LIMITED.get(column, column)) <= value)
    return rows


#: Columns that limits call by a shorter name.
_LIMITED = {"size": "size_m2"}


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def with_children(parents: DataFrame, children: DataFrame, on: str, order: str, n: int, name: str = "children") -> DataFrame:
    """Each parent with an array of its first n children; only those n are shuffled into arrays."""
    ranked = children.withColumn("_r", F.row_number().over(W.partitionBy(on).orderBy(order))).filter(F.col("_r") <= n)
    held = [c for c in children.columns if c != on]
    lists = ranked.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("_r", *held))).alias(name))
    return parents.join(lists, on, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def enriched(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (ref, address, city, province if there is one, ...) with the registry's fields (ref, address, city, surface_m2, year_built): by
    reference, else by address and by province or city. Of several registry rows the smallest (surface_m2, year_built) counts."""
    said = F.min(F.struct("surface_m2", "year_built"))
    by_ref = registry.filter("ref is not null").groupBy("ref").agg(said.alias("_a"))
    by_place = registry.groupBy("address", F.col("city").alias("_place")).agg(said.alias("_b"))
    place = F.coalesce(*(c for c in ("province", "city") if c in rows.columns))
    held = rows.withColumn("_place", place).join(by_ref, "ref", "left").join(by_place, ["address", "_place"], "left")
    found = F.coalesce("_a", "_b")
    return held.withColumns({"surface_m2": found["surface_m2"], "year_built": found["year_built"]}).drop("_a", "_b", "_place")


def stale(rows: DataFrame, now: Column, days: int = 10, updated: str = "updated_at") -> DataFrame:
    return rows.filter(F.col(updated) < now - F.expr(f"INTERVAL {days} DAYS"))


def joined_lines(rows: DataFrame, line: Column, order: Column) -> DataFrame:
    """All lines as one text; for a bounded number of rows (a prompt's context)."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def count_of(rows: DataFrame, mode: str = "exact", key: str | None = None) -> DataFrame:
    """Rows by an exact count, or an estimate by a sketch of distinct keys."""
    return rows.agg((F.count(F.lit(1)) if mode == "exact" else F.approx_count_distinct(key)).alias("n"))
