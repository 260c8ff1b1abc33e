from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import prices, scoring, text


def values(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_price_parsers_disagree_as_their_sources_do(spark):
    raw = F.col("raw")
    got = values(spark, [("150.000€",), ("1.234,56 €",), ("150.000,50 €",), ("1.234.567€",), ("",), (None,)], "raw string", eu=prices.parse_price_eu(raw), dot=prices.parse_price_dot(raw), digits=prices.parse_price_digits(raw))
    assert [(r["eu"], r["dot"], r["digits"]) for r in got] == [(150000.0, 150.0, 150000), (1234.56, 1.23456, 123456), (150000.5, 150.0005, 15000050), (1234567.0, 0.0, 1234567), (None, 0.0, None), (None, 0.0, None)]


def test_price_per_m2_and_formats(spark):
    got = values(spark, [(100.0, 0), (100.0, None), (250.0, 100), (None, 3)], "p double, s int", v=prices.price_per_m2(F.col("p"), F.col("s")), ok=prices.valid_price(F.col("p")), es=prices.format_es(F.col("p")))
    assert [r["v"] for r in got] == [100, 100, 3, None] and [r["ok"] for r in got] == [True, True, True, False]
    assert [r["v"] for r in values(spark, [(1234.0,), (123456.0,), (1234567.0,)], "p double", v=prices.format_es(F.col("p")))] == ["1234", "123.456", "1.234.567"]


@pytest.mark.parametrize(
    ("price", "previous", "average", "private", "score"),
    [(180000.0, 200000.0, 250000.0, True, 80), (190000.0, 200000.0, 200000.0, False, 10), (190001.0, 200000.0, 190000.0, False, 0), (100000.0, None, 300000.0, True, 60), (100000.0, 0.0, 100000.0, False, 0), (93000.0, 100000.0, 100000.0, False, 14), (71000.0, 100000.0, 90000.0, True, 91), (50000.0, 100000.0, 100000.0, True, 100), (90000.0, 90000.0, 100000.0, False, 15), (90000.0, None, None, None, 0)],
)
def test_weighted_score(spark, price, previous, average, private, score):
    s = scoring.weighted_score(F.col("p"), F.col("q"), F.col("a"), F.col("i"))
    (row,) = values(spark, [(price, previous, average, private)], "p double, q double, a double, i boolean", s=s)
    assert row["s"]["score"] == score and row["s"]["is_hot"] == (score >= 80)


def test_other_scores(spark):
    got = values(spark, [(100.0, None), (400000.0, 0.0), (None, 5.0), (100.0, 200.0)], "p double, a double", s=scoring.binary_score(F.col("p"), F.col("a")))
    assert [r["s"] for r in got] == [80, 50, 50, 80]


def test_text(spark):
    t = F.col("t")
    one = lambda f, *rows: [r["v"] for r in values(spark, [(x,) for x in rows], "t string", v=f(t))]
    assert one(text.size_m2, "Piso 1.200 m² x", "none", None) == [200, 0, 0]
    assert one(text.rooms, "3 HAB", "x", None) == [3, None, None]
    assert one(text.capitalize, "san sebastian", "", None) == ["San sebastian", "", None]
    assert one(text.external_id_before_last, "https://h/inmueble/123/", "x") == ["123", None]
    assert one(text.canonical_url, "u?x#y", "u#y?x") == ["u", "u"]
    assert one(text.canonical_url_bare, "http://a/b//", "http://a/b?c/") == ["http://a/b", "http://a/b"]
    assert one(text.domain, "https://www.a.es:80/x", "nothing") == ["a.es:80", ""]
    assert one(text.strip_ws, "\n\t a b \n", None) == ["a b", None]
    assert one(text.any_keyword, "Vendo PISO", "nada", None) == [True, False, False]
    assert one(text.is_portal_listing, "https://www.pisos.com/comprar/x", "https://www.pisos.com/comprar/l", "https://o.com/comprar/x", None) == [True, False, False, False]
    assert one(text.group_url, "123", "name", "https://www.facebook.com/groups/1") == ["https://m.facebook.com/groups/123", "https://m.facebook.com/groups/name", "https://m.facebook.com/groups/1"]
    assert one(text.clean_group_id, "https://www.facebook.com/groups/77/x?y") == ["77"]
    assert one(text.strip_fence, 'a ```json\n{"a":1}\n``` b', '{"b":2}') == ['{"a":1}', '{"b":2}']
    assert one(text.split_csv, " a, ,b ", "") == [["a", "b"], []]
    assert one(text.split_ws, " a  b ") == [["a", "b"]]
    assert one(text.registry_ref, "<pc1>A</pc1>\n<pc2>B</pc2>", "<pc1>A</pc1>") == ["AB", None]
    assert [tuple(x) for x in one(text.registry_fields, "<sfc>12,5</sfc><ant>1980</ant><uso>X</uso>", "")] == [(12.5, 1980, "X"), (0.0, 0, "Residencial")]
    assert one(text.urgency_signals, "piso URGENTE por herencia") == [["Urgente", "Herencia"]]
    assert one(text.normalise_city, "Málaga") == ["Malaga"]
    assert one(lambda c: text.is_verified(c), "x", "", None) == [True, False, False]


def test_structured(spark):
    got = values(spark, [("Casa", 150000.0)], "t string, p double", v=text.fragment_hash(F.col("t"), F.col("p")))
    assert got[0]["v"] == "a15e7f81f8cb"
    got = values(spark, [(True, None), (True, False), (True, True), (False, None)], "h boolean, i boolean", v=text.is_agency(F.col("h"), F.col("i")))
    assert [r["v"] for r in got] == [True, True, False, False]
    got = values(spark, [(["a", "Discrepancia x"],), ([],), (None,)], "r array<string>", v=text.has_discrepancy(F.col("r")), img=text.first_image(F.col("r"), "none"))
    assert [(r["v"], r["img"]) for r in got] == [(True, "a"), (False, "none"), (False, "none")]
    got = values(spark, [("", None, True), ("None", "X", True), ("t", None, True), (None, None, False)], "t string, c string, p boolean", v=text.default_title(F.col("t"), F.col("c"), F.col("p")))
    assert [r["v"] for r in got] == ["Propiedad en None", "Propiedad en X", "t", "Propiedad en Málaga"]


def test_extraction_of_posts(spark):
    from tessera.functions import extract

    post = "Vendo piso en Málaga\nreformado, 3 hab, 80 m² con terraza y garaje, precio 150.000 €, llamar por la tarde."
    rows = extract.extracted(spark.createDataFrame([(1, post), (2, "casa"), (3, "x" * 60), (4, None)], "id int, t string"), "t").collect()
    assert [(r.id, r.title, r.price, r.rooms, r.size_m2, r.has_terrace, r.has_garage) for r in rows] == [(1, "Vendo piso en Málaga", 150.0, 3, 80, True, True)]
    replies = [(1, '```json\n{"properties":[{"title":"a","price":"1","city":null},{"title":"b"}]}\n```'), (2, '[{"title":"c"}]'), (3, "nothing"), (4, None)]
    assert sorted((r.id, r.title) for r in extract.bulk(spark.createDataFrame(replies, "id int, t string"), "t").collect()) == [(1, "a"), (1, "b"), (2, "c")]
