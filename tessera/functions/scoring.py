"""Scores of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOT = 80


def weighted_score(price: Column, previous: Column, market_avg: Column, individual: Column) -> Column:
    """score (0 to 100), is_hot, drop_pct, under_pct and reasons.

    Up to 40 points for a drop of 5 % or more from the previous price, up to 40 for 10 % or more
    under the market's average, 20 for a private seller; each part is cut to whole points by itself.
    """
    dropped = F.coalesce((previous != 0) & (price < previous), F.lit(False))
    drop = F.when(dropped, (previous - price) / previous * 100)
    under = F.when(F.coalesce(price < market_avg, F.lit(False)), (market_avg - price) / market_avg * 100)
    whole = lambda pct, least, factor: F.when(pct >= least, F.least(F.lit(40.0), pct * factor).cast("int")).otherwise(0)
    private = F.coalesce(individual, F.lit(False))
    score = F.coalesce(whole(drop, 5, 2.0), F.lit(0)) + F.coalesce(whole(under, 10, 1.5), F.lit(0)) + F.when(private, 20).otherwise(0)
    reasons = F.array_compact(F.array(F.when(drop >= 5, F.format_string("Price dropped by %.1f%%", drop)), F.when(under >= 10, F.format_string("%.1f%% below market", under)), F.when(private, F.lit("Listed by individual"))))
    return F.struct(score.alias("score"), (score >= HOT).alias("is_hot"), drop.alias("drop_pct"), under.alias("under_pct"), reasons.alias("reasons"))


def binary_score(price: Column, market_avg: Column | None = None) -> Column:
    """80 under the market's average (300,000 unless given and not 0), else 50; 50 for a null price."""
    average = F.coalesce(F.nullif(market_avg, F.lit(0)), F.lit(300000)) if market_avg is not None else F.lit(300000)
    return F.when(price < average, 80).otherwise(50)


def amenity_score(terrace: Column, garage: Column) -> Column:
    return F.when(F.coalesce(terrace, F.lit(False)) | F.coalesce(garage, F.lit(False)), 80).otherwise(60)


def amenity_reasons(terrace: Column, garage: Column) -> Column:
    """What the amenity score says of itself."""
    return F.array_compact(F.array(F.when(terrace, F.lit("☀️ Terraza/Exterior")), F.when(garage, F.lit("🚗 Garaje/Parking"))))


def auction_score() -> Column:
    return F.lit(95)
