"""Tables and the listings that are made of them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical listing: one schema that every source is cast to.
LISTING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("external_id", "source", "url", "title")]
    + [T.StructField("price", T.DoubleType()), T.StructField("currency", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("location_raw", "city", "neighborhood", "address")]
    + [T.StructField("coordinates", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])), T.StructField("catastro_ref", T.StringType()), T.StructField("rooms", T.IntegerType()), T.StructField("bathrooms", T.IntegerType()), T.StructField("size_m2", T.DoubleType())]
    + [T.StructField(n, T.BooleanType()) for n in ("has_parking", "has_terrace", "has_pool", "is_individual", "is_agency")]
    + [T.StructField("description", T.StringType()), T.StructField("images", T.ArrayType(T.StringType())), T.StructField("last_seen", T.TimestampType())]
)

#: What a source that has no such field is given.
DEFAULTS = {"currency": "EUR", "has_parking": False, "has_terrace": False, "has_pool": False, "is_individual": False, "is_agency": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_listing(rows: DataFrame) -> DataFrame:
    """rows cast to the canonical schema: missing columns get their default or null, others are dropped."""
    held = set(rows.columns)
    return rows.select([(F.col(f.name) if f.name in held else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in LISTING])


def parse_listings(raw: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Listings of a column of JSON text, and the rows whose JSON couldn't be read (for a table of rejects)."""
    parsed = raw.withColumn("_parsed", F.from_json(F.col(column), LISTING, {"mode": "PERMISSIVE"}))
    bad = F.col(column).isNotNull() & (F.get_json_object(F.col(column), "$").isNull())
    return to_listing(parsed.filter(~bad).select("_parsed.*")), raw.filter(F.get_json_object(F.col(column), "$").isNull() & F.col(column).isNotNull())


def text_or(spark: SparkSession, path: str, sentinel: str) -> str:
    """A small text file's content (a prompt's background), or the sentinel if there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return sentinel
    return row.value if row else sentinel


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings: id, price, created_at, source, is_individual, seller, city.

    The dimension tables are left to Catalyst to broadcast by their sizes.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("source"), (F.col("o_orderpriority") == "1-URGENT").alias("is_individual"))
    sellers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seller"), F.col("c_nationkey").alias("n"))
    cities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("city"))
    return orders.join(sellers.join(cities, "n"), "seller").drop("n")


def with_previous_price(rows: DataFrame) -> DataFrame:
    """previous: the seller's price before, by (created_at, id)."""
    return rows.withColumn("previous", F.lag("price").over(W.partitionBy("seller").orderBy("created_at", "id")))


def with_city_average(rows: DataFrame, value: str = "price") -> DataFrame:
    """city_avg: the city's average. A grouped average is combined before it is shuffled and joined back by city, so a hot city is no hot task."""
    return rows.join(rows.groupBy("city").agg(F.avg(value).alias("city_avg")), "city")
