"""Deterministic extraction of listing fields from free text, in place of a language model; another extractor can be given as a pandas UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import prices, text


def extract_fields(post: Column) -> Column:
    """title, price, rooms, size_m2, has_terrace, has_garage, is_real_estate of a post."""
    first_line = text.strip_ws(F.substring_index(text.strip_ws(post), "\n", 1))
    price = prices.parse_price_dot(F.regexp_extract(post, r"([0-9][0-9.]*)\s*(?:€|euro)", 1))
    return F.struct(text.truncate(first_line, 100).alias("title"), price.alias("price"), text.rooms(post).alias("rooms"), text.size_m2(post).alias("size_m2"), text.has_terrace(post).alias("has_terrace"), text.has_garage(post).alias("has_garage"), text.any_keyword(post).alias("is_real_estate"))


def extracted(posts: DataFrame, column: str, extractor: Callable[[Column], Column] = extract_fields) -> DataFrame:
    """posts with the fields of each that is long enough and has a keyword: the cheap filter stands before the extractor."""
    kept = posts.filter(text.long_enough(F.col(column)) & text.any_keyword(F.col(column)))
    return real_estate(kept.withColumn("f", extractor(F.col(column))).select("*", "f.*").drop("f"))


def real_estate(rows: DataFrame) -> DataFrame:
    """Without rows that are said not to be real estate; rows that say nothing of it stay, and so do tables without the column."""
    return rows.filter(F.coalesce("is_real_estate", F.lit(True))) if "is_real_estate" in rows.columns else rows


def bulk(replies: DataFrame, column: str, item: str = "title string, price string, city string") -> DataFrame:
    """One row for each item of a reply: a fenced or plain JSON object with properties, or a JSON array."""
    said = text.strip_fence(F.col(column))
    wrapped = F.from_json(said, f"properties array<struct<{item.replace(' string', ':string')}>>")["properties"]
    plain = F.from_json(said, f"array<struct<{item.replace(' string', ':string')}>>")
    items = F.when(said.startswith("["), plain).otherwise(wrapped)
    return replies.select("*", F.explode(items).alias("item")).select([c for c in replies.columns if c != column] + ["item.*"])
