"""Every query with SQL of its own against DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries without rows over the smallest tables, and why. None is empty over sf0.01.
EMPTY: dict[str, str] = {}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows, order):
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    said = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == sorted(df.columns)
    by = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
    got = norm(df.collect(), by(df.columns))
    assert got == norm(said.fetchall(), by(names))
    assert got or name in EMPTY


def test_user_filters_keeps_every_part_within_the_first_limits(spark, tmp_path):
    prices = [900.0, 910.0, 910.01, 950.0, 950.01, 1500.0, 1500.01, None, 999.9, 999.9, 999.9]
    sizes = [10, 50, 10, 50, 10, 50, 10, 10, 9, None, 10]
    parts = [(k, price, size) for k, (price, size) in enumerate(zip(prices, sizes), start=2)] + [(1, 900.0, 10)]
    spark.createDataFrame(parts, "p_partkey bigint, p_retailprice double, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(r.p_partkey for r in catalog.QUERIES["user_filters"](spark, str(tmp_path)).collect())
    assert got == sorted(k for (k,) in c.execute(catalog.ORACLES["user_filters"]).fetchall()) == [2, 3, 4, 5, 6, 7, 12]


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_user_filters_leaves_no_part_out_for_its_price(spark, sf):
    """The given prices are all under the limit, so size and rooms alone decide."""
    sf_dir = f"/root/testdata/sf{sf}"
    sized = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size >= 10 and p_partkey >= 2").select("p_partkey")
    assert sized.exceptAll(catalog.QUERIES["user_filters"](spark, sf_dir)).count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
