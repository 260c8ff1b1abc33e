from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import merge, relational
from tessera.plans.query import Query, condition
from tessera.sources.tables import LISTING, parse_listings, to_listing
from tessera.streaming import pipelines, state


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_overwrites_exactly_the_given_columns(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, x string")
    assert rows(merge.upsert(old, new, "id")) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    assert rows(merge.upsert(old, new, "id", ignore_duplicates=True)) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    again = merge.upsert(merge.upsert(old, new, "id"), new, "id")
    assert rows(again) == rows(merge.upsert(old, new, "id"))


def test_updates_and_deletes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id int, x string")
    keys = spark.createDataFrame([(1,), (1,)], "id int")
    assert rows(merge.update_keys(t, keys, "id", {"x": F.lit("z")})) == [(1, "z"), (2, None), (None, "c")]
    assert rows(merge.delete_keys(t, keys, "id")) == [(2, None), (None, "c")]
    assert rows(merge.update_where(t, F.col("x") == "a", {"x": F.lit("q")})) == [(1, "q"), (2, None), (None, "c")]
    with pytest.raises(ValueError):
        merge.guarded(t, 2)
    assert merge.altered(t, add={"n": "bigint"}, rename={"x": "y"}).columns == ["id", "y", "n"]
    assert rows(merge.check_keys(t.unionByName(t), ["id"], ["x"])) == [("unique", 3), ("x is not null", 2)]


def test_paging_covers_all_rows_once(spark):
    t = spark.range(45)
    pages = [r.id for p in (1, 2, 3) for r in relational.page(t, p, [F.asc("id")]).collect()]
    assert pages == list(range(45))
    assert relational.page_count(t).first().pages == 3
    assert [r.id for r in relational.row_range(t, 3, 5, [F.asc("id")]).collect()] == [3, 4, 5]
    got = spark.createDataFrame([(1, 9), (5, 5)], "p int, n int").select(relational.page_buttons(F.col("p"), F.col("n")).alias("b")).collect()
    assert [r.b for r in got] == [[1, 2, 3], [3, 4, 5]]


def test_duplicates_keep_first_and_tails(spark):
    t = spark.createDataFrame([(2, "a", None), (1, "a", "x"), (3, "b", None)], "id int, k string, v string")
    assert rows(relational.keep_first(t, F.col("k"), ["id"])) == [(1, "a", "x"), (3, "b", None)]
    assert tuple(relational.duplicates(t, F.col("k")).first()) == (3, 2, 1)
    assert rows(relational.tail(t, "k", "id", 1)) == [(2, "a", None), (3, "b", None)]
    got = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5],), ([],)], "a array<int>").select(relational.last_items(F.col("a")).alias("a")).collect()
    assert [r.a for r in got] == [[1, 2, 3], [2, 3, 4, 5], []]
    assert relational.single(t.filter("id = 1"))["v"] == "x"
    assert relational.single(t.filter("id = 9"), allow_none=True) is None
    with pytest.raises(ValueError):
        relational.single(t)


def test_joins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    dim = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "c string, n int, name string")
    assert rows(relational.lookup(t, dim, "c", "n").select("id", "name")) == [(1, "early"), (2, None), (3, None)]
    done = t.filter("id = 1").select("id")
    assert rows(relational.unprocessed(t, done, "id").select("id")) + rows(relational.existing(t, done, "id").select("id")) == [(2,), (3,), (1,)]
    kids = spark.createDataFrame([(1, 9), (1, 8), (1, 7)], "id int, k int")
    assert [len(r.children) for r in relational.with_children(t, kids, "id", "k", 2).orderBy("id").collect()] == [2, 0, 0]
    reg = spark.createDataFrame([("r1", None, None, 5.0, 1980), ("r2", "st", "x", 6.0, 1990)], "ref string, address string, city string, surface_m2 double, year_built int")
    asked = spark.createDataFrame([("r1", "st", "x"), (None, "st", "x"), (None, "no", "x")], "ref string, address string, city string")
    assert sorted((r.surface_m2 or 0) for r in relational.enriched(asked, reg).collect()) == [0, 5.0, 6.0]


def test_query_builder_nulls_and_order(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, v int")
    ids = lambda q: [r.id for r in q.frame().collect()]
    assert ids(Query(t).where("v", "neq", 5)) == [3]
    assert ids(Query(t).where_not("v", "eq", 5)) == [3]
    assert ids(Query(t).where("v", "is", None)) == [2]
    assert ids(Query(t).order("v")) == [1, 3, 2]
    assert ids(Query(t).order("v", ascending=False)) == [2, 3, 1]
    assert ids(Query(t).order("v", nulls_first=True).range(1, 2)) == [1, 3]
    assert ids(Query(t).where_any(("id", "eq", 1), ("v", "gt", 6)).order("id")) == [1, 3]
    assert Query(t).order("v").limit(1).select("id").single() == {"id": 1}
    assert Query(t).where("id", "eq", 9).maybe_single() is None and Query(t).count() == 3
    words = spark.createDataFrame([("Piso en Málaga sur",), ("nada",)], "t string")
    assert [r.ok for r in words.select(condition("t", "fts", "málaga piso").alias("ok")).collect()] == [True, False]


def test_limits_bind_on_both_sides(spark):
    t = spark.createDataFrame([(1, 910.0, 60.0, 2), (2, 910.5, 60.0, 2), (3, 900.0, 59.5, 2), (4, 900.0, 60.0, 1), (5, None, 60.0, 2), (6, 900.0, None, 2)], "id int, price double, size_m2 double, rooms int")
    ids = lambda limits: [r.id for r in relational.within_limits(t, limits).orderBy("id").collect()]
    assert ids({"max_price": 910}) == [1, 3, 4, 6] and ids({"min_size": 60}) == [1, 2, 4, 5]
    assert ids({"max_price": 910, "min_size": 60, "min_rooms": 2}) == [1]
    assert ids({"max_price": None, "min_size": 0}) == ids({}) == [1, 2, 3, 4, 5, 6]


def test_listings_schema(spark):
    made = to_listing(spark.createDataFrame([("u", "12.5")], "url string, price string"))
    assert made.schema.simpleString() == LISTING.simpleString() and made.first().price == 12.5 and made.first().currency == "EUR" and made.first().is_agency is False
    good, bad = parse_listings(spark.createDataFrame([('{"url":"a","price":3}',), ("{broken",), (None,)], "j string"), "j")
    assert [r.url for r in good.collect()] == ["a", None] and bad.count() == 1


def test_files(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    for form in ("csv", "json", "orc", "parquet"):
        merge.save(t, str(tmp_path / form), form)
        assert rows(merge.load(spark, str(tmp_path / form), form, "id int, x string")) == [(1, "a"), (2, None)]
    assert '"coordinates":[1.0,2.0]' in merge.geojson(spark.createDataFrame([(1.0, 2.0, "n")], "x double, y double, n string"), "x", "y").first().feature
    assert merge.export(t, 1).count() == 1


def test_expired_keys_leave_after_a_later_batch(spark, tmp_path):
    for n, day in enumerate(("01", "02", "20", "21", "22")):
        spark.createDataFrame([("k", f"2024-01-{day} 00:00:00")], "k string, ts string").select("k", F.col("ts").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = pipelines.run(pipelines.distinct_within(pipelines.source(spark, str(tmp_path / "in"), files_per_batch=1), "k", "ts"))
    assert kept.count() == 2
    assert pipelines.run(pipelines.forever_distinct(pipelines.source(spark, str(tmp_path / "in")), "k")).count() == 1


def test_event_lines_and_requeue(spark):
    lines = spark.createDataFrame([('data: {"n": 1}',), (": keep",), ("data: [DONE]",), ("data: {bad",), ('data: {"n":',), ('data: {"n": "x"}',), ("data: 7",), ("data: {}",), (None,)], "text string")
    assert sorted(((r.broken, r.m and r.m.n) for r in state.payloads(lines, "n int").collect()), key=repr) == [(False, 1), (False, None), (True, None), (True, None), (True, None), (True, None)]
    t = spark.createDataFrame([(1, "u", "s", "2024-01-01"), (2, "v", "s", "2024-01-19")], "id int, url string, source string, d string").withColumn("updated_at", F.col("d").cast("timestamp"))
    got = pipelines.requeue(t, F.lit("2024-01-20").cast("timestamp")).collect()
    assert [(r.id, r.status, r.source_name) for r in got] == [(1, "pending", "Monitoring: s")]


def test_rounds_and_text_or(spark, tmp_path):
    from tessera.sources.tables import text_or

    asked = []

    def fetch(number, left):
        asked.append((number, left))
        return spark.range(3).select((F.col("id") + 10 * number).alias("id"))

    assert len(rows(pipelines.rounds(fetch, 7))) == 7 and asked == [(1, 7), (2, 4), (3, 1)]
    assert pipelines.rounds(lambda number, left: spark.range(0), 7, most=2).count() == 0
    assert relational.quota_of(None, 0, 25) == 25 and relational.quota_of(0, None) == 10
    (tmp_path / "known.md").write_text("a\nb")
    assert text_or(spark, str(tmp_path / "known.md"), "nothing") == "a\nb" and text_or(spark, str(tmp_path / "none.md"), "nothing") == "nothing"


def test_searches(spark):
    t = spark.createDataFrame([("Piso, en venta: Málaga",), ("venta de piso",), (None,)], "t string")
    got = lambda q, kind: [r.ok for r in t.select(condition("t", kind, q).alias("ok")).collect()]
    assert got("piso, venta!", "fts") == [True, True, None] and got("en venta", "phfts") == [True, False, None]
    assert got('"venta de" or málaga', "wfts") == [True, True, None] and got("piso -de", "wfts") == [True, False, None]
    assert got("piso & !en | nada", "rfts") == [False, True, None] and got("...", "fts") == [True, True, True]
    j = spark.createDataFrame([('{"a":1,"b":true,"c":"x"}',), ("{}",), (None,)], "j string")
    assert [r.ok for r in j.select(condition("j", "contains", {"a": 1, "b": True, "c": "x"}).alias("ok")).collect()] == [True, False, False]
    assert "Filter" in Query(t).where("t", "eq", "x").explain()


def test_links_of_any_quoting(spark):
    from tessera.functions import cards, text

    html = """<a href="http://one.es/1">x</a><A class=b HREF='http://two.es/2'>y</A><a href=http://three.es/3>z</a><a href="/short">s</a><area href="http://no.es/12"><a data-href="http://no.es/34">n</a>"""
    page = spark.createDataFrame([(html, '<article class="item"><h2> A <b>b</b></h2></article><article class="items">x</article>')], "h string, c string")
    r = page.select(text.links(F.col("h")).alias("l"), F.size(cards.cards(F.col("c"))).alias("n"), F.size(cards.cards(F.col("c"), "item")).alias("m"), cards.by_tag(F.col("c"), "h2").alias("t"), cards.by_class(F.col("c"), "none").alias("none")).first()
    assert r.l == ["http://one.es/1", "http://two.es/2", "http://three.es/3"] and (r.n, r.m, r.t, r.none) == (2, 1, "A b", None)
