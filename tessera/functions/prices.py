"""Price parsers. Four sources write prices in ways that contradict each other, so each has a parser of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip_ws


def parse_price_eu(raw: Column) -> Column:
    """Continental prices: "150.000,50 €" is 150000.5. Null if it isn't a number."""
    bare = F.replace(F.replace(F.replace(raw, F.lit("€"), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return strip_ws(bare).try_cast("double")


def parse_price_dot(raw: Column) -> Column:
    """Keeps digits and dots: "150.000€" is 150.0. 0 if that isn't a number."""
    return F.coalesce(F.regexp_replace(raw, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def parse_price_digits(raw: Column) -> Column:
    """Keeps digits only: "1.234,56 €" is 123456. Null without a digit (rows of that kind are skipped by callers)."""
    return F.regexp_replace(raw, "[^0-9]", "").try_cast("bigint")


def valid_price(price: Column) -> Column:
    """A price has to be a number over 0."""
    return F.coalesce(price > 0, F.lit(False))


def price_per_m2(price: Column, size: Column) -> Column:
    """Rounded half up; a null or zero size counts as 1."""
    return F.floor(price / F.coalesce(F.nullif(size.cast("double"), F.lit(0.0)), F.lit(1.0)) + 0.5).cast("bigint")


def format_es(number: Column) -> Column:
    """Spanish grouping: a dot every three digits, but none in numbers of four digits."""
    plain = F.round(number, 0).cast("decimal(18,0)")
    return F.when(F.abs(plain) < 10000, plain.cast("string")).otherwise(F.translate(F.format_number(plain, 0), ",", "."))


def amenity_adjusted(price: Column, parking: Column, terrace: Column) -> Column:
    """The price without what a parking place (12,500) and a terrace (15 %) add."""
    base = price - F.when(F.coalesce(parking, F.lit(False)), 12500.0).otherwise(0.0)
    return F.when(F.coalesce(terrace, F.lit(False)), base / 1.15).otherwise(base)
