"""Keyed tables, the queue, and streams with state."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import cards
from tessera.operators import merge
from tessera.operators.keyed import KeyedTable, Overtaken
from tessera.operators.queue import Queue, worked
from tessera.streaming import pipelines, state

AT = "timestamp_ntz'2024-01-01 {}'"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keyed_table_merges_columns(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    with pytest.raises(ValueError):
        t.read()
    t.merge(spark.createDataFrame([(i, f"a{i}", i) for i in range(6)] + [(None, "null", 0)], "k long, a string, b int"))
    t.merge(spark.createDataFrame([(1, None), (2, "x"), (9, "n")], "k long, a string"))
    t.merge(spark.createDataFrame([(2, 7.0)], "k long, c double"))
    t.merge(spark.createDataFrame([(3,), (9,), (77,)], "k long"), gone=F.lit(True))
    t.merge(spark.createDataFrame([(3, 9), (None, 1)], "k long, b int"))
    t.merge(spark.createDataFrame([], "k long, b int"))
    want = sorted([(0, "a0", 0, None), (1, None, 1, None), (2, "x", 2, 7.0), (3, None, 9, None), (4, "a4", 4, None), (5, "a5", 5, None), (None, "null", 1, None)], key=repr)
    assert rows(t.read()) == want
    assert t.compact(1) and rows(t.read()) == want and t.compact(1) == []
    assert rows(t.read(1)) == sorted([(i, f"a{i}", i, *[]) for i in range(6)] + [(None, "null", 0)], key=repr)
    assert t.vacuum(1) >= 1 and rows(t.read()) == want and t.versions() == [7]


def test_a_batch_writes_its_keys_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", ["at"], buckets=64)
    t.merge(spark.range(2_000).select(F.col("id").alias("k"), F.lit(0).alias("at"), F.lit("old").alias("v")))
    before = t.version()
    for n in range(1, 4):
        t.merge(spark.createDataFrame([(5, n, "new"), (6, -n, "late"), (5, 0, "older")], "k long, at int, v string"), "s", n)
    now = t.version()
    changed = {b for b in now.buckets if now.buckets[b] != before.buckets[b]}
    assert len(changed) <= 2 and {len(now.buckets[b]) for b in changed} == {4}
    files = [f for layer in now.buckets[min(changed)][1:] for f in (tmp_path / "t" / "layers" / layer).rglob("*.parquet")]
    assert len(files) <= 2 * 3
    t.merge(spark.createDataFrame([(5, 99, "again")], "k long, at int, v string"), "s", 3)  # known: nothing changes
    assert t.version() == now and rows(t.read().filter("v <> 'old'")) == [(5, 3, "new")] and t.read().count() == 2_000
    assert set(t.compact(3)) == changed and all(t.version().buckets[b] == before.buckets[b] for b in before.buckets if b not in changed)
    assert rows(t.read().filter("v <> 'old'")) == [(5, 3, "new")]
    t.merge(spark.createDataFrame([(6, -9)], "k long, at int"), gone=F.lit(True))  # older than what is stored
    assert t.read().filter("k = 6").count() == 1
    t.merge(spark.createDataFrame([(6, 9)], "k long, at int"), gone=F.lit(True))
    t.merge(spark.createDataFrame([(6, 8, "late")], "k long, at int, v string"))
    assert t.read().filter("k = 6").count() == 0 and (t.compact(1), t.read().filter("k = 6").count())[1] == 0


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=2)

    def write(i):
        for j in range(3):
            t.merge(spark.createDataFrame([(10 * i + j, str(i))], "k long, a string"), f"s{i}", j)
            t.compact(2)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert rows(t.read()) == sorted([(10 * i + j, str(i)) for i in range(3) for j in range(3)], key=repr) and t.version().applied == {"s0": 2, "s1": 2, "s2": 2}
    with pytest.raises(Overtaken):
        t.merge(spark.createDataFrame([(1, "x")], "k long, a string"), expect=1)


def test_queue_gives_each_request_to_one_worker(spark, tmp_path):
    queue = Queue(KeyedTable(spark, str(tmp_path / "q"), "id", buckets=2), most=2)
    queue.put(spark.range(7).select("id", F.expr(AT.format("00:00:00")).alias("requested_at")))
    clock = lambda t: F.expr(AT.format(t))
    done = lambda mine: mine.select("id", F.when(F.col("id") == 4, "broken").alias("error"))
    threads = [threading.Thread(target=worked, args=(queue, w, 2, done, clock("00:01:00"))) for w in ("a", "b")]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    got = queue.table.read()
    assert rows(got.select("id", "status", "attempts", "error_message")) == [(i, "failed" if i == 4 else "completed", 1, "broken" if i == 4 else None) for i in range(7)]
    queue.put(spark.range(10, 12).select("id", F.expr(AT.format("00:00:00")).alias("requested_at")))
    assert rows(queue.claim("c", 1, clock("01:00:00")).select("id")) == [(10,)]
    queue.finish("other", spark.createDataFrame([(10, None)], "id long, error string"), clock("01:00:30"))  # isn't its own
    assert rows(queue.claim("d", 5, clock("01:05:00")).select("id")) == [(11,)] and queue.claim("d", 5, clock("01:06:00")) is None
    assert rows(queue.claim("e", 1, clock("02:00:00")).select("id", "attempts")) == [(10, 2)]
    queue.claim("f", 5, clock("03:00:00"))
    assert rows(queue.table.read().filter("id >= 10").select("id", "status", "attempts", "error_message")) == [(10, "failed", 2, "given up"), (11, "processing", 2, None)]


def test_lines_of_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SPAN", 3)
    said = {"a": 'data: {"k": 1}\n\ndata: {"k":\n: note\r\ndata: [DONE]\nrest', "b": "\n\n\n", "c": "no end", "d": "x\n" * 40}
    chunks = [(c, i, t[7 * i : 7 * i + 7]) for c, t in said.items() for i in range(-(-len(t) // 7))] + [("e", 0, None), ("e", 1, "one\ntwo\nthr"), (None, 0, "n\n")]
    want = sorted([(c, i, x.removesuffix("\r")) for c, t in (*said.items(), ("e", "one\ntwo\nthr"), (None, "n\n")) for i, x in enumerate(t.split("\n")[:-1])], key=repr)
    df = spark.createDataFrame(chunks, "connection string, place long, chunk string")
    assert rows(state.lines_of(df)) == want
    assert rows(state.lines_of(df.filter("false"))) == []
    for n, part in enumerate((1, 0, 2)):  # micro-batches, out of order
        df.filter(F.pmod("place", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.filter("place = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # comes twice
    got = pipelines.run(state.lines_stream(pipelines.source(spark, str(tmp_path / "in"), files_per_batch=1)))
    assert [r for r in rows(got) if r[0] != "a"] == [r for r in want if r[0] != "a"] and {r for r in want if r[0] == "a"} <= set(rows(got))


def test_keys_are_admitted_again_after_the_span(spark, tmp_path):
    said = [("k", 1), ("k", 5), ("k", 8), ("k", 14), ("k", 15), ("j", 3), (None, 2), (None, 9), ("j", None), ("h", 20), ("k", 29)]
    df = spark.createDataFrame(said, "key string, day int").select("key", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day - 1)").alias("ts"))
    days = lambda d: sorted([(r.key, r.admitted_at.day) for r in d.collect()], key=repr)
    want = sorted([("k", 1), ("k", 8), ("k", 15), ("k", 29), ("j", 3), (None, 2), (None, 9), ("h", 20)], key=repr)
    assert days(state.admitted(df, "key", "ts")) == want
    assert days(state.admitted(df.filter("false"), "key", "ts")) == []
    table = KeyedTable(spark, str(tmp_path / "t"), "key", ["admitted_at"], buckets=2)
    each = state.admit_into(table, str(tmp_path / "out"), "ts", "7 days", "s")
    for n, (a, b) in enumerate(((1, 6), (7, 14), (15, 31))):
        part = df.filter(F.dayofmonth("ts").between(a, b))
        each(part, n)
        each(part, n)  # run again: nothing changes
        state.expire(table, F.expr(f"timestamp_ntz'2024-01-{b:02d} 00:00:00'"))
    out = spark.read.schema("key string, admitted_at timestamp_ntz").option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert days(out) == want and days(table.read()) == [("k", 29)]


def test_harvest_stops_without_news(spark):
    pages = {1: [("a", "x"), ("b", "p"), (None, "n")], 2: [("a", "y"), ("a", "x"), ("b", "p"), (None, "n")], 3: [("a", "x"), ("b", "late")], 4: [("a", "never")]}
    asked = []

    def fetch(number, open_):
        asked.append(number)
        return spark.createDataFrame(pages.get(number, []), "g string, item string").join(open_.withColumnRenamed("g", "_o"), F.col("g").eqNullSafe(F.col("_o")), "left_semi")

    groups = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "g string")
    found, rounds = state.harvest(groups, fetch)
    assert rows(rounds) == sorted([("a", 3, 2), ("b", 2, 1), ("c", 1, 0), (None, 2, 1)], key=repr) and asked == [1, 2, 3]
    assert rows(found) == sorted([("a", "x", 1), ("a", "y", 2), ("b", "p", 1), (None, "n", 1)], key=repr)
    assert rows(state.harvest(groups, fetch, 1)[1]) == sorted([("a", 1, 1), ("b", 1, 1), ("c", 1, 0), (None, 1, 1)], key=repr)


def test_cards_end_by_depth():
    page = "<article class='item'>1<article>2</article>3</article><ARTICLE class=item>4<p class=\"a item b\">5</article>"
    assert cards._elements(page, "article", "item", False) == [page[: page.index("<ARTICLE")], page[page.index("<ARTICLE") :]]
    assert len(cards._elements(page, "article", None, False)) == 3 and cards._elements("", None, "x", True) == []
    assert cards._elements('<div class="x"><div>in</div>out</div>', None, "x", True) == ['<div class="x"><div>in</div>out</div>']
    assert cards._elements('<img class="x"><i class="x">n', None, "x", False) == ['<img class="x">', '<i class="x">n']
    assert cards._elements('</div><a title="<b class=x>">t</a>', "a", None, True) == ['<a title="<b class=x>">t</a>']


def test_patches_tell_absent_from_null(spark):
    stored = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "id int, x string, y string")
    assert rows(merge.patch(stored, spark.createDataFrame([(1, None, "z"), (9, "n", "n")], "id int, x string, y string"), "id")) == [(1, None, "z"), (2, "c", "d"), (3, "e", "f")]
    by_row = spark.createDataFrame([(1, None, "z", ["x"]), (2, "q", None, []), (3, "w", None, None)], "id int, x string, y string, sets array<string>")
    assert rows(merge.patch(stored, by_row, "id", "sets")) == [(1, None, "b"), (2, "c", "d"), (3, "e", "f")]


def test_text_index_is_text_match(spark, tmp_path):
    from tessera.operators.search import TextIndex
    from tessera.plans.query import text_match

    said = ["The cat of the house", "", None, "of the", "the-of THE", "cat  cat dog", "ñandú the", " ".join(["the"] * 300 + ["end"])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(said)] + [(None, "the dog", "x")], "n long, t string, term string")
    index = TextIndex(spark, str(tmp_path / "i"))
    index.build(docs, "n", "t", buckets=4, salts=3)
    searches = [("the of", "plain"), ("of the", "phrase"), ("the of the", "phrase"), ("cat dog", "any"), ('"of the" -cat or dog', "websearch"), ("-the", "websearch"), ("the & !of | dog", "raw"), ("!the", "raw"), ("", "plain"), ("...", "phrase"), ("", "any"), ("ÑANDÚ", "plain"), ("the end", "phrase")]
    for query, kind in searches:
        assert rows(index.search(query, kind)) == rows(docs.filter("t is not null").filter(text_match(F.col("t"), query, kind)).select("n")), (query, kind)
    files = lambda terms: {p.rsplit("bucket=", 1)[1][0] for p in index.postings(terms).inputFiles()}
    read = index.postings(["dog"])
    assert read.select(F.input_file_name().alias("f")).distinct().count() <= 3 and rows(read.select("id", "positions")) == sorted([(5, [2]), (None, [1])], key=repr)
    assert files(["dog"]) and index.search("nowhere").count() == 0
    held = index.postings(["the"]).filter("id = 7").first()
    assert list(held.positions) == list(range(300))


def test_stems(spark):
    from tessera.operators.search import stem, stem_match, stemmed

    golden = {
        "english": {"running": "runn", "listings": "list", "walked": "walk", "quickly": "quick", "houses": "hous", "cats": "cat", "bus": "bus", "ring": "ring", "kindness": "kind", "payments": "payment", "is": "is", "": ""},
        "spanish": {"casas": "cas", "casa": "cas", "pisos": "pis", "alquilando": "alquil", "vendido": "vend", "rápidamente": "rapida", "habitación": "habita", "habitaciones": "habita", "sol": "sol", "la": "la", "pequeños": "pequen"},
    }
    for language, words in golden.items():
        df = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w"), language).alias("s"))
        got = {r.w: r.s for r in df.collect()}
        assert {w: got[w] for w in words} == words
    docs = spark.createDataFrame([(1, "Casas y pisos"), (2, None), (3, ""), (4, "una casa vendida"), (1, "Casas y pisos")], "n long, t string")
    made = stemmed(docs.distinct(), "n", "t", "spanish")
    assert {r.n: r.stems and list(r.stems) for r in made.collect()} == {1: ["cas", "y", "pis"], 2: None, 3: [], 4: ["una", "cas", "vend"]}
    match = lambda q, kind="plain": rows(made.filter(stem_match(F.col("stems"), q, spark, "spanish", kind)).select("n"))
    assert match("CASA") == [(1,), (4,)] and match("casas vendidas", "phrase") == [(4,)] and match("-casa", "websearch") == [(3,)]


def test_stems_lose_the_longest_ending_that_fits(spark):
    from tessera.operators.search import ENDINGS, stem, stemmed

    for language, endings in ENDINGS.items():
        words = sorted({begun + a + b for begun in ("", "x", "xy", "xyz", "wxyz", "\U00010428y", "\U00010428yz") for a in ("", *endings) for b in ("", *endings)} - {""})
        longest = {w: max((e for e, least in endings.items() if w.endswith(e) and len(w) >= least + len(e)), key=len, default="") for w in words}
        expected = {w: w[: len(w) - len(longest[w])] for w in words}
        df = spark.createDataFrame([(w,) for w in words], "w string")
        assert {r.w: r.s for r in df.select("w", stem(F.col("w"), language).alias("s")).collect()} == expected
        line = spark.createDataFrame([(1, " ".join(words))], "n long, t string")
        assert list(stemmed(line, "n", "t", language).first().stems) == [expected[w] for w in words]


def test_stems_are_made_without_a_shuffle(spark):
    from tessera.operators.search import stemmed

    docs = spark.createDataFrame([(1, "Casas y pisos"), (1, "una casa"), (None, "pisos"), (None, None), (2, "...")], "n long, t string")
    made = stemmed(docs, "n", "t", "spanish")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(made.select("n", F.array_join("stems", " "))) == sorted([(1, "cas y pis"), (1, "una cas"), (None, "pis"), (None, None), (2, "")], key=repr)


def test_text_stems_sends_no_words_and_keeps_every_row(spark, tmp_path):
    import duckdb

    from tessera.plans import catalog, stored  # noqa: F401  (adds its queries to the catalog)

    said = ["Enthoues, la casa un", "enthou", "ENTHOUED - las unos", "lá ... ún", "la un la un", "", " ", None, "enthousiast LA\nUN", "\U00010400enthou la", "enthou\u0301 un la", "12 la3 un"]
    docs = [(i, t) for i, t in enumerate(said)] + [(0, "un, la"), (1, "enthou"), (1, "enthou"), (None, "enthous"), (None, "la un"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["text_stems"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(found.select("doc_id", "english", "spanish", "n_words")) == sorted(c.execute(catalog.ORACLES["text_stems"]).fetchall(), key=repr)
    assert found.count() == sum(t is not None for _, t in docs)


def test_planned_counts_come_from_stored_histograms(spark):
    from tessera.operators.upkeep import Analyzed, planned_count

    held = Analyzed(spark.range(10_000).select("id", (F.col("id") % 7).alias("k")), ["id", "k"])
    try:
        for said, exact in (("id < 1000", 1000), ("id >= 9900", 100), ("k = 3", 1429), ("id < 0", 0)):
            assert abs(planned_count(held.frame().filter(said)) - exact) <= max(50, exact // 2)
    finally:
        held.drop()
    assert spark.conf.get("spark.sql.cbo.enabled") == "false"


def test_retention_reads_no_expired_day(spark, tmp_path):
    from tessera.operators.upkeep import keep_by_day, retain

    df = spark.range(24 * 5).select("id", (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at"))
    path = str(tmp_path / "days")
    keep_by_day(df, path)
    for bad in (tmp_path / "days" / "day=2024-01-01").glob("*.parquet"):
        bad.write_bytes(b"not parquet: to read it would fail")
    assert retain(spark, path, "2024-01-03 12:00:00") == (["2024-01-01", "2024-01-02"], ["2024-01-03"])
    assert rows(spark.read.schema("id long").parquet(path).select("id")) == sorted([(i,) for i in range(60, 120)], key=repr)
    assert retain(spark, path, "2024-01-03 12:00:00") == ([], [])


def test_counters_cost_no_second_scan(spark, tmp_path):
    from tessera.operators.upkeep import saved_with_counts

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(counted, "id long")
    assert saved_with_counts(df, str(tmp_path / "out"), low=F.col("id") < 10, none=F.col("id").isNull()) == {"n": 100, "low": 10, "none": 0}
    assert seen.value == 100 and spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_sql_export_runs(spark):
    import duckdb

    from tessera.operators.upkeep import sql_export

    df = spark.createDataFrame([(1, "it's", 1.5, [1, None], True), (2, None, float("nan"), None, None), (3, "a\n\\%", float("inf"), [], False)], 'a int, "b""c" string, d double, e array<int>, f boolean'.replace('"b""c"', "`b\"c`"))
    times = spark.range(2).select(F.expr("date'2024-02-29'").alias("d"), F.expr("timestamp_ntz'2024-01-01 01:02:03.5'").alias("t"), F.lit(None).cast("decimal(9,2)").alias("m"))
    c = duckdb.connect()
    for r in sql_export({"one": df, "two 2": times, "none": df.limit(0)}).orderBy("place").collect():
        c.execute(r.statement)
    assert repr(c.execute("select * from one order by a").fetchall()) == repr([tuple(r) for r in df.collect()])
    assert repr(c.execute('select d, t, m from "two 2"').fetchall()) == repr([tuple(r) for r in times.collect()]) and c.execute("select count(*) from none").fetchone() == (0,)
    assert sql_export({"one": df}, 2).count() == 3


def test_replies_become_rows_in_sql(spark):
    from tessera.operators.upkeep import register_functions

    register_functions(spark)
    said = ['x ```json {"properties": [{"title": "a", "price": 7}]} ``` y', '[{"city": null, "title": "b"}, 3]', "{bad", None, '"text"', '{"properties": 4}']
    df = spark.createDataFrame(list(enumerate(said)), "n long, reply string")
    assert rows(spark.sql("select n, title, price, city from {df}, lateral read_reply(reply)", df=df)) == [(0, "a", "7", None), (1, "b", None, None)]


def test_changes_of_the_builder_need_filters(spark):
    from tessera.plans.query import Query

    t = Query(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string"))
    assert rows(t.where("v", "eq", "a").update(v="z")) == [(1, "z"), (2, None), (3, "b")] and rows(t.where("v", "neq", "a").delete()) == [(1, "a"), (2, None)]
    for wrong in (t.delete, t.limit(1).where("k", "eq", 1).delete, lambda: t.where("k", "gte", 1).delete(most=2), lambda: t.where("k", "gte", 1).update(most=1, v="x")):
        with pytest.raises(ValueError):
            wrong()
