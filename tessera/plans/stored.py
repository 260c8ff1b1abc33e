"""Queries of stored tables that change: merges by micro-batch, the work queue, chunks put together, keys that expire, harvests; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import upkeep
from tessera.operators.keyed import KeyedTable
from tessera.operators.queue import Queue, worked
from tessera.operators.search import ENDINGS, TextIndex, stem_match, stemmed
from tessera.plans.catalog import query
from tessera.plans.query import Query
from tessera.sources.tables import table, text_or
from tessera.streaming import pipelines, state

col, lit = F.col, F.lit


def _files(rows, n, part):
    """rows as n files of a folder (each a micro-batch), by part (0 to n - 1)."""
    where = f"{pipelines.scratch(rows.sparkSession)}/files"
    rows.repartitionById(n, part.cast("int")).write.parquet(where)
    return where


@query("select user_id as id, arg_max(value, (ts, event_id)) as value, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts, 9 as last_batch from events group by 1")
def stream_keyed(spark, sf_dir):
    """Ten micro-batches, in any order of time, merged into a keyed table that is compacted on the way; then the last batch comes again."""
    events = table(spark, sf_dir, "events").select(col("user_id").alias("id"), "ts", "event_id", "value", "event_type")
    where = _files(events, 10, F.pmod(col("event_id"), lit(10)))
    keyed = KeyedTable(spark, f"{pipelines.scratch(spark)}/keyed", "id", ["ts", "event_id"], buckets=8)
    merge, last = keyed.each("events"), {}

    def each(batch, number):
        merge(batch, number)
        last.update({number: batch.count()})
        if number == 5:
            keyed.compact()

    pipelines.drain(pipelines.source(spark, where, files_per_batch=1), each)
    merge(events.filter("id is null"), max(last))
    keyed.compact()
    return keyed.read().select("id", "value", "event_type", "ts", lit(keyed.version().applied["events"]).alias("last_batch"))


_BEGAN = "timestamp_ntz'2024-01-01 00:00:00'"


@query("""with c as (select c_custkey as id, c_acctbal, row_number() over (order by c_custkey) as r, ceil(count(*) over () / 4.0) as n from customer)
select id, case when c_acctbal < 0 then 'failed' else 'completed' end as status, 'second' as worker, case when r <= n then 2 else 1 end as attempts, case when r <= n then timestamp '2024-01-01 01:00:00' else timestamp '2024-01-01 00:01:00' end as processed_at, case when c_acctbal < 0 then 'no credit' end as error_message from c""")
def queue_worked(spark, sf_dir):
    """A quarter of the requests is claimed by a worker that crashes; a second one does the others, and an hour later, when the lease has ended, that quarter too."""
    customers = table(spark, sf_dir, "customer")
    queue = Queue(KeyedTable(spark, f"{pipelines.scratch(spark)}/queue", "id", buckets=4))
    began = F.expr(_BEGAN)
    queue.put(customers.select(col("c_custkey").alias("id"), (began + F.make_dt_interval(mins=col("c_custkey").cast("int"))).alias("requested_at")))
    n = -(-customers.count() // 4)
    poor = customers.filter("c_acctbal < 0").select(col("c_custkey").alias("id"), lit("no credit").alias("error"))
    queue.claim("first", n, began)
    for minutes in (1, 60):
        worked(queue, "second", n, lambda mine: mine.join(poor, "id", "left"), began + F.expr(f"INTERVAL {minutes} MINUTES"))
    return queue.table.read().select("id", "status", "worker", "attempts", "processed_at", "error_message")


_BROKEN = "event_type = 'error' and value < 50"


def _chunks(spark, sf_dir):
    """Every user's events as one stream of "data:" lines with empty lines between, cut into chunks of 7 characters; some payloads are cut short."""
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null")
    said = F.concat(lit("data: "), F.when(F.expr(_BROKEN), '{"k":').otherwise(F.coalesce("props", lit("null"))), lit("\n\n"))
    cut = F.transform(F.sequence(lit(0), F.ceil(F.length("said") / 7).cast("int") - 1), lambda i: F.substr("said", i * 7 + 1, lit(7)))
    pieces = events.withColumn("said", said).select(col("user_id").cast("string").alias("connection"), "event_id", F.posexplode(cut).alias("at", "chunk"))
    return pieces.select("connection", (col("event_id") * 4096 + col("at")).alias("place"), "chunk")


_LINES = f"select user_id::varchar as connection, 2 * (row_number() over (partition by user_id order by event_id) - 1) as line, {_BROKEN} as broken, case when not ({_BROKEN}) then json_extract(props, '$.k')::bigint end as k from events where user_id is not null and event_id is not null"


@query(_LINES)
def chunk_lines(spark, sf_dir):
    """Chunks cut anywhere come back line by line; broken payloads are told apart."""
    return state.payloads(state.lines_of(_chunks(spark, sf_dir)), "k bigint").select("connection", "line", "broken", "m.k")


@query(_LINES)
def stream_lines(spark, sf_dir):
    """The same by a stream of four micro-batches with state; chunks that come before their turn wait."""
    placed = _chunks(spark, sf_dir).withColumn("place", (F.row_number().over(W.partitionBy("connection").orderBy("place")) - 1).cast("bigint"))
    where = _files(placed, 4, F.pmod(F.floor(col("place") / 5), lit(4)))
    lines = pipelines.run(state.lines_stream(pipelines.source(spark, where, files_per_batch=1)))
    return state.payloads(lines, "k bigint").select("connection", "line", "broken", "m.k")


@query("""with recursive e as (select distinct user_id, ts from events where ts is not null),
n as (select e.user_id, e.ts, min(f.ts) as following from e left join e f on e.user_id = f.user_id and e.ts + interval 7 days <= f.ts group by 1, 2),
a as (select user_id, min(ts) as admitted_at from e group by 1 union all select a.user_id, following from a join n on n.user_id = a.user_id and n.ts = admitted_at where following is not null)
select user_id, admitted_at from a""")
def keys_expiring(spark, sf_dir):
    """Events replayed week by week, each a micro-batch of one stream that goes on: a key is admitted anew seven days after it was. Expired keys leave the table."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    first, last = events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    where = pipelines.scratch(spark)
    keyed = KeyedTable(spark, f"{where}/processed", "user_id", ["admitted_at"], buckets=4)
    each = state.admit_into(keyed, f"{where}/admitted", "ts", "7 days", "events")
    for week in range(((last - first).days if first else -1) // 7 + 1):
        events.filter(F.floor(F.datediff(F.to_date("ts"), lit(first)) / 7) == week).write.mode("append").parquet(f"{where}/arrived")
        pipelines.drain(pipelines.source(spark, f"{where}/arrived"), each, f"{where}/stream")
        if keyed.version().schema:
            state.expire(keyed, F.expr(f"timestamp_ntz'{first} 00:00:00'") + F.expr(f"INTERVAL {7 * week + 7} DAYS"))
    if not first:
        return events.withColumnRenamed("ts", "admitted_at").limit(0)
    return spark.read.schema("user_id bigint, admitted_at timestamp_ntz").option("recursiveFileLookup", "true").parquet(f"{where}/admitted")


@query("""with d as (select user_id, event_type, date_diff('day', (select min(ts)::date from events), ts::date) + 1 as day from events),
f as (select user_id, event_type, min(day) as day from d group by all),
u as (select user_id, min(r) as stop from (select distinct user_id from d) d, range(1, 42) t(r) where not exists (select 1 from f where f.user_id = d.user_id and f.day = r) group by 1)
select u.user_id, least(stop, 40) as rounds, count(event_type) filter (where day < stop) as found from u left join f using (user_id) group by 1, 2""")
def harvest_rounds(spark, sf_dir):
    """Each round shows a user's events of one more day; a user is asked until a day brings no new kind of event."""
    events = table(spark, sf_dir, "events")
    first = lit(events.agg(F.min(F.to_date("ts"))).first()[0])
    days = events.select("user_id", col("event_type").alias("item"), (F.datediff(F.to_date("ts"), first) + 1).alias("day"))
    _, rounds = state.harvest(events.select("user_id"), lambda number, open_: days.filter(col("day") == number).join(open_, "user_id", "left_semi"))
    return rounds


@query("select n, poor, rich, nameless from (select count(*) as n, count(*) filter (where c_acctbal < 0) as poor, count(*) filter (where c_acctbal > 5000) as rich, count(*) filter (where c_name is null) as nameless from customer)")
def run_counters(spark, sf_dir):
    """Counters of a run, taken while its rows are written."""
    counts = upkeep.saved_with_counts(table(spark, sf_dir, "customer"), f"{pipelines.scratch(spark)}/run", poor=col("c_acctbal") < 0, rich=col("c_acctbal") > 5000, nameless=col("c_name").isNull())
    return spark.createDataFrame([tuple(counts[k] for k in ("n", "poor", "rich", "nameless"))], "n bigint, poor bigint, rich bigint, nameless bigint")


@query("select p_partkey as id, p_name as title, p_retailprice::varchar as price, p_brand as city from part")
def table_function(spark, sf_dir):
    """A function that makes rows, called laterally in SQL by its name."""
    upkeep.register_functions(spark)
    part = table(spark, sf_dir, "part")
    item = F.to_json(F.struct(col("p_name").alias("title"), col("p_retailprice").cast("string").alias("price"), col("p_brand").alias("city")))
    reply = F.when(col("p_partkey") % 2 == 0, F.concat(lit('Here:\n```json\n{"properties":['), item, lit("]}\n```"))).otherwise(F.concat(lit("["), item, lit("]")))
    return spark.sql("select id, title, price, city from {replies}, lateral read_reply(reply)", replies=part.select(col("p_partkey").alias("id"), reply.alias("reply")))


@query("with m as (select max(ts) - interval 7 days as oldest from events) select event_id, ts, ts::date as day from events, m where ts >= oldest")
def retention_by_day(spark, sf_dir):
    """Messages kept by day: expired days are dropped whole, the day of the edge is written anew; done twice."""
    events = table(spark, sf_dir, "events").select("event_id", "ts").filter("ts is not null")
    where = f"{pipelines.scratch(spark)}/days"
    upkeep.keep_by_day(events, where, "ts")
    oldest = events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).cast("string").alias("t")).first().t
    for _ in range(2):
        upkeep.retain(spark, where, oldest, "ts")
    return spark.read.schema("event_id bigint, ts timestamp_ntz, day date").parquet(where)


@query("""select 'cheap' as asked, count(*) as exact, true as near from orders where o_totalprice < 100000 union all select 'dear', count(*), true from orders where o_totalprice > 300000 union all select 'none', count(*), true from orders where o_totalprice < -1
union all select 'urgent', count(*), true from orders where o_orderpriority = '1-URGENT' union all select 'both', count(*), true from orders where o_totalprice < 200000 and o_orderpriority = '5-LOW'""")
def planned_counts(spark, sf_dir):
    """How many rows the plan expects, by stored histograms, against the rows that are there: near if within a factor of 2 (and 10 rows)."""
    held = upkeep.Analyzed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), ["o_orderkey", "o_totalprice", "o_orderpriority"])
    try:
        rows = held.frame()
        asked = {"cheap": col("o_totalprice") < 100_000, "dear": col("o_totalprice") > 300_000, "none": col("o_totalprice") < -1, "urgent": col("o_orderpriority") == "1-URGENT", "both": (col("o_totalprice") < 200_000) & (col("o_orderpriority") == "5-LOW")}
        made = []
        for name, said in asked.items():
            planned, exact = upkeep.planned_count(rows.filter(said)), rows.filter(said).count()
            made.append((name, exact, planned is not None and exact <= 2 * planned + 10 and planned <= 2 * exact + 10))
    finally:
        held.drop()
    return spark.createDataFrame(made, "asked string, exact bigint, near boolean")


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_LINE = f"' ' || array_to_string({_WORDS}, ' ') || ' '"


@query(f"""with w as (select doc_id, {_LINE} as w from documents where text is not null)
select 'plain' as kind, doc_id from w where contains(w, ' the ') and contains(w, ' of ') union all select 'phrase', doc_id from w where contains(w, ' of the ') union all
select 'any', doc_id from w where contains(w, ' una ') or contains(w, ' ado ') union all select 'websearch', doc_id from w where (contains(w, ' of the ') and not contains(w, ' was ')) or contains(w, ' una ') union all
select 'raw', doc_id from w where (contains(w, ' the ') and not contains(w, ' of ')) or contains(w, ' ado ') union all select 'without', doc_id from w where not contains(w, ' the ')""")
def text_index(spark, sf_dir):
    """All kinds of searches by a stored index; its postings of the terms asked for are what is read."""
    index = TextIndex(spark, f"{pipelines.scratch(spark)}/index")
    index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = {"plain": "the, of", "phrase": "of the", "any": "una ado", "websearch": '"Of the" -was OR una', "raw": "the & !of | ado"}
    found = [index.search(said, kind).select(lit(kind).alias("kind"), col("id").alias("doc_id")) for kind, said in asked.items()]
    found.append(index.search("-the", "websearch").select(lit("without").alias("kind"), col("id").alias("doc_id")))
    return reduce(lambda a, b: a.unionByName(b), found)


def _sql_stem(word, language):
    word = f"translate({word}, 'áéíóúüñ', 'aeiouun')" if language == "spanish" else word
    ways = " ".join(f"when ends_with({word}, '{e}') and length({word}) >= {n + len(e)} then {word}[:-{len(e) + 1}]" for e, n in sorted(ENDINGS[language].items(), key=lambda x: -len(x[0])))
    return f"case {ways} else {word} end"


def _sql_stems(language):
    return f"' ' || array_to_string(list_transform({_WORDS}, lambda x: {_sql_stem('x', language)}), ' ') || ' '"


@query(f"select doc_id, contains({_sql_stems('english')}, ' enthou ') as english, contains({_sql_stems('spanish')}, ' la ') and contains({_sql_stems('spanish')}, ' un ') as spanish, len({_WORDS}) as n_words from documents where text is not null")
def text_stems(spark, sf_dir):
    """Searches over stems, by two languages' endings; both are made in one pass over the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    english = stemmed(docs, "doc_id", "text", "english").withColumnRenamed("stems", "english_stems")
    both = stemmed(english, "doc_id", "text", "spanish")
    found = {"english": stem_match(col("english_stems"), "enthoues", spark, "english"), "n_words": F.size("english_stems").cast("bigint"), "spanish": stem_match(col("stems"), "la, un", spark, "spanish")}
    return both.select("doc_id", *(c.alias(name) for name, c in found.items()))


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer order by c_custkey limit 200")
def sql_exported(spark, sf_dir):
    """Rows as INSERT statements, and those read back: values between the brackets."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").orderBy("c_custkey")
    said = upkeep.sql_export({"customer": rows}, 200).filter("place like '%b'")
    part = lambda n: F.regexp_extract("statement", r"VALUES \((.*?), '(.*?)', '(.*?)'::DOUBLE, '(.*?)'\)$", n)
    return said.select(part(1).cast("bigint").alias("c_custkey"), part(2).alias("c_name"), part(3).cast("double").alias("c_acctbal"), part(4).alias("c_mktsegment"))


@query("select n_nationkey, n_name, 1 as found, 'no file' as missing, (select count(*) from nation) as lines from nation where n_nationkey = 3")
def single_row(spark, sf_dir):
    """One row by its key, none by a key that isn't there; a file's text, and the words for a file that isn't there."""
    nation = Query(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    one, none = nation.where("n_nationkey", "eq", 3).single(), nation.where("n_nationkey", "eq", -1).maybe_single()
    where = f"{pipelines.scratch(spark)}/names"
    nation.select("n_name").frame().coalesce(1).write.text(where)
    said, missing = text_or(spark, where, "no file"), text_or(spark, f"{where}/none", "no file")
    return spark.createDataFrame([(one["n_nationkey"], one["n_name"], 1 if none is None else 2, missing, len(said.split()))], "n_nationkey int, n_name string, found int, missing string, lines bigint")


@query("""select 'update' as change, c_custkey, case when c_mktsegment = 'BUILDING' and c_acctbal < 0 then 'poor' else c_mktsegment end as segment, c_acctbal from customer union all
select 'delete', c_custkey, c_mktsegment, c_acctbal from customer where not (c_acctbal < 0 or c_mktsegment like 'M%') union all
select 'insert', c_custkey, c_mktsegment, c_acctbal from customer union all select 'insert', -1 - c_custkey, 'new', null from customer where c_acctbal > 9000 union all
select 'upsert', c_custkey, c_mktsegment, case when c_custkey % 3 = 0 then 0 else c_acctbal end from customer""")
def qb_changes(spark, sf_dir):
    """The builder's changes: rows that pass the filters are updated or deleted, others are inserted or merged by key."""
    t = Query(table(spark, sf_dir, "customer").select("c_custkey", col("c_mktsegment").alias("segment"), "c_acctbal"))
    new = t.where("c_acctbal", "gt", 9000).frame().select((-1 - col("c_custkey")).alias("c_custkey"))
    made = {
        "update": t.match(segment="BUILDING").where("c_acctbal", "lt", 0).update(segment="poor"),
        "delete": t.where_any(("c_acctbal", "lt", 0), ("segment", "like", "M%")).delete(),
        "insert": t.insert(new, {"segment": lit("new")}),
        "upsert": t.upsert(t.whole.filter("c_custkey % 3 = 0").select("c_custkey", lit(0.0).alias("c_acctbal")), "c_custkey"),
    }
    return reduce(lambda a, b: a.unionByName(b), [rows.withColumn("change", lit(name)) for name, rows in made.items()])
