"""The registered queries: each a plan over the given tables, with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import prices, scoring, text
from tessera.operators import merge, relational
from tessera.operators.keyed import KeyedTable
from tessera.plans.query import Query, condition
from tessera.sources.tables import listings, table, with_city_average, with_previous_price
from tessera.streaming import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LISTINGS = "l as (select o_orderkey as id, o_custkey as seller, o_totalprice as price, o_orderdate as created_at, o_orderpriority as source, o_orderpriority = '1-URGENT' as is_individual, n_name as city from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"
SCORED = f"""with {LISTINGS}, p as (select *, lag(price) over (partition by seller order by created_at, id) as previous, avg(price) over (partition by city) as city_avg from l),
d as (select *, case when previous <> 0 and price < previous then (previous - price) / previous * 100 end as drop_pct, case when price < city_avg then (city_avg - price) / city_avg * 100 end as under_pct from p),
s as (select id, city, price, drop_pct, under_pct, (case when drop_pct >= 5 then trunc(least(40.0, drop_pct * 2.0)) else 0 end + case when under_pct >= 10 then trunc(least(40.0, under_pct * 1.5)) else 0 end + case when is_individual then 20 else 0 end)::int as score from d)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_city_average(with_previous_price(listings(spark, sf_dir)))
    return rows.withColumn("s", scoring.weighted_score(col("price"), col("previous"), col("city_avg"), col("is_individual")))


@query(SCORED + " select id, city, score, score >= 80 as is_hot, round(drop_pct, 6) as drop_pct, round(under_pct, 6) as under_pct from s")
def score_weighted(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "city", col("s.score").alias("score"), col("s.is_hot").alias("is_hot"), F.round("s.drop_pct", 6).alias("drop_pct"), F.round("s.under_pct", 6).alias("under_pct"))


@query(SCORED + " select id, score from s where score >= 80 order by score desc, id limit 50")
def hot_listings(spark, sf_dir):
    return scored(spark, sf_dir).select("id", col("s.score").alias("score")).filter(col("score") >= scoring.HOT).orderBy(F.desc("score"), "id").limit(50)


@query("select o_orderkey as id, case when o_totalprice < 150000 then 80 else 50 end as score from orders")
def score_binary(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), scoring.binary_score(col("o_totalprice"), lit(150000)).alias("score"))


@query("select p_partkey as id, case when p_type ilike '%brass%' or p_name ilike '%a%' then 80 else 60 end as score, 95 as auction from part")
def score_amenity(spark, sf_dir):
    return table(spark, sf_dir, "part").select(col("p_partkey").alias("id"), scoring.amenity_score(col("p_type").ilike("%brass%"), col("p_name").ilike("%a%")).alias("score"), scoring.auction_score().alias("auction"))


@query(f"with {LISTINGS}, c as (select distinct o_orderpriority as source, lower(o_orderpriority) as label from orders) select id, price, label from (select l.id, l.price, c.label, l.created_at from l left join c using (source) where contains(lower(city), 'nation_1') order by created_at desc nulls first, id limit 20 offset 20)")
def dashboard_page(spark, sf_dir):
    rows = listings(spark, sf_dir).filter(text.matches("Nation_1", col("city")))
    dimension = rows.groupBy("source").agg(F.min(F.lower("source")).alias("label"))
    return relational.lookup(relational.page(rows, 2, [F.desc_nulls_first("created_at"), F.asc("id")]), dimension, "source", "label").select("id", "price", "label")


@query("select p_partkey from part where contains(lower(p_name), 'red') or contains(lower(p_brand), 'red') or contains(lower(p_type), 'ec')")
def search_multi(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.filter(text.matches("Red", col("p_name"), col("p_brand")) | text.matches("EC", col("p_type"))).select("p_partkey")


@query("select count(*) as total, ceil(count(*) / 20.0)::bigint as pages from orders where o_totalprice > 10000")
def page_count(spark, sf_dir):
    return relational.page_count(table(spark, sf_dir, "orders").filter(col("o_totalprice") > 10000))


@query("with n as (select o_custkey, count(*) as k, ceil(count(*) / 3.0)::bigint as pages from orders group by all) select o_custkey, list_aggregate(generate_series(greatest(1, 2 - 2), least(pages, 2 + 2)), 'string_agg', ',') as buttons from n")
def page_buttons(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.ceil(F.count(lit(1)) / 3).cast("bigint").alias("pages"))
    return n.select("o_custkey", F.array_join(relational.page_buttons(lit(2).cast("bigint"), col("pages")), ",").alias("buttons"))


def raw_prices(spark, sf_dir):
    """Prices as sources write them: with a space or a no-break space before the euro sign, none at all, empty, with two dots, without digits."""
    whole, k = F.round("o_totalprice").cast("bigint"), col("o_orderkey") % 8
    usual = F.concat((whole / 1000).cast("bigint").cast("string"), lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), lit(",50 €"))
    raw = F.when(k == 0, None).when(k == 1, "").when(k == 2, F.concat(lit("1."), usual)).when(k == 3, F.replace(usual, lit(" "), lit("\u00a0"))).when(k == 4, "a consultar").otherwise(usual)
    return table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), raw.alias("raw"))


@query("with r as (select o_orderkey as id, round(o_totalprice)::bigint as w from orders), u as (select id, (w // 1000)::varchar || '.' || lpad((w % 1000)::varchar, 3, '0') || ',50 €' as x from r), t as (select id, case id % 8 when 0 then null when 1 then '' when 2 then '1.' || x when 3 then replace(x, ' ', chr(160)) when 4 then 'a consultar' else x end as raw from u) select id, try_cast(trim(replace(replace(replace(replace(raw, '€', ''), '.', ''), ',', '.'), chr(160), ' ')) as double) as eu, coalesce(try_cast(regexp_replace(raw, '[^0-9.]', '', 'g') as double), 0) as dot, try_cast(regexp_replace(raw, '[^0-9]', '', 'g') as bigint) as digits from t")
def price_parse(spark, sf_dir):
    raw = col("raw")
    return raw_prices(spark, sf_dir).select("id", prices.parse_price_eu(raw).alias("eu"), prices.parse_price_dot(raw).alias("dot"), prices.parse_price_digits(raw).alias("digits"))


@query("select p_partkey as id, floor(p_retailprice / coalesce(nullif(p_size::double, 0), 1) + 0.5)::bigint as per_m2, p_retailprice > 0 as valid from part")
def price_per_m2(spark, sf_dir):
    return table(spark, sf_dir, "part").select(col("p_partkey").alias("id"), prices.price_per_m2(col("p_retailprice"), col("p_size")).alias("per_m2"), prices.valid_price(col("p_retailprice")).alias("valid"))


@query("select id, city from (select p_partkey as id, p_brand as city, p_retailprice / p_size as v, avg(p_retailprice / p_size) over (partition by p_brand) as a from part) where v <= a * 0.8")
def below_city_avg(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(col("p_partkey").alias("id"), col("p_brand").alias("city"), (col("p_retailprice") / col("p_size")).alias("v"))
    return with_city_average(parts, "v").filter(col("v") <= col("city_avg") * 0.8).select("id", "city")


@query("select page_id, split_part(split_part(url, '?', 1), '#', 1) as canonical, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') as bare, replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '') as domain from pages")
def canonical_urls(spark, sf_dir):
    url = col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(url).alias("canonical"), text.canonical_url_bare(url).alias("bare"), text.domain(url).alias("domain"))


@query("select page_id, split_part(split_part(url, '/', -1), '.', 1) as last_id, split_part(url, '/', -2) as before_last, replace(split_part(url, '/', -1), '.htm', '') as htm from pages")
def external_ids(spark, sf_dir):
    url = col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.external_id(url).alias("last_id"), text.external_id_before_last(url).alias("before_last"), text.external_id_htm(url).alias("htm"))


@query("with k as (select page_id, url, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') as key from pages) select page_id, url from (select *, row_number() over (partition by key order by page_id) as r from k) where r = 1")
def dedup_first(spark, sf_dir):
    return relational.keep_first(table(spark, sf_dir, "pages").select("page_id", "url"), text.canonical_url_bare(col("url")), ["page_id"])


@query("select count(*) as total, count(distinct regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')) as distinct_keys, count(*) - count(distinct regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')) as duplicates from pages")
def dup_count(spark, sf_dir):
    return relational.duplicates(table(spark, sf_dir, "pages"), text.canonical_url_bare(col("url")))


@query(r"""with h as (select page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]+"|''[^'']+''|[^\s>"'']+)', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')), lambda x: length(x) >= 10)) as href from pages) select page_id, href, count(*) as n from h group by all""")
def link_discovery(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(lit(1)).alias("n"))


@query("select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, length(html) as chars from pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.length("html").cast("bigint").alias("chars"))


@query("select doc_id from documents where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50 and (contains(lower(text), 'casa') or contains(lower(text), 'hab') or contains(lower(text), 'euro') or contains(lower(text), 'piso') or contains(lower(text), 'loft'))".replace("\\\\", "\\"))
def keyword_shield(spark, sf_dir):
    words = ("casa", "hab", "euro", "piso", "loft")
    return table(spark, sf_dir, "documents").filter(text.long_enough(col("text")) & text.any_keyword(col("text"), words)).select("doc_id")


@query("select o_orderkey as id, substring(md5(o_orderpriority || round(o_totalprice)::bigint::varchar || '.0'), 1, 12) as hash, 'http://g?post_id=' || substring(md5(o_orderpriority || round(o_totalprice)::bigint::varchar || '.0'), 1, 12) as url from orders")
def fragment_hash(spark, sf_dir):
    h = text.fragment_hash(col("o_orderpriority"), F.round("o_totalprice"))
    return table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), h.alias("hash"), text.post_url(lit("http://g"), h).alias("url"))


@query("select distinct text as fragment from documents where length(text) > 50")
def distinct_fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") > 50).select(col("text").alias("fragment")).distinct()


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def anti_join_processed(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(col("c_custkey").alias("o_custkey"))
    return relational.unprocessed(table(spark, sf_dir, "orders"), done, "o_custkey").select("o_orderkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def exists_probe(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(col("o_custkey").alias("c_custkey"))
    return relational.existing(table(spark, sf_dir, "customer"), stored, "c_custkey").select("c_custkey")


@query("with n as (select max(o_orderdate) as now from orders) select o_orderkey as id, 'pending' as status, 'Monitoring: ' || o_orderpriority as source_name, 'o/' || o_orderkey as url from orders, n where o_orderdate < now - interval 10 days")
def stale_requeue(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), F.concat(lit("o/"), col("o_orderkey").cast("string")).alias("url"), col("o_orderpriority").alias("source"), col("o_orderdate").alias("updated_at"))
    now = lit(orders.agg(F.max("updated_at")).first()[0])
    return pipelines.requeue(orders, now).select("id", "status", "source_name", "url")


@query("select page_id, substring(coalesce(url, 'null') || ' ' || 'x' || ' ' || coalesce(html, ''), 1, 1000) as embed_text from pages")
def embed_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.embed_text(col("url"), lit("x"), col("html")).alias("embed_text"))


@query("select vec_id from embeddings e left join (select vec_id, 1 as done from embeddings where label < 5) d using (vec_id) where done is null order by vec_id limit 10")
def vector_backfill_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    missing = merge.update_where(vectors, col("label") >= 5, {"embedding": lit(None)})
    return missing.filter(col("embedding").isNull()).orderBy("vec_id").limit(10).select("vec_id")


@query(f"with {LISTINGS}, t as (select * from l order by created_at desc nulls first, id limit 30) select string_agg('- ' || source || ' en ' || city || ': ' || round(price)::bigint || '€', chr(10) order by id) as text from t")
def advisor_context(spark, sf_dir):
    top = listings(spark, sf_dir).orderBy(F.desc_nulls_first("created_at"), "id").limit(30)
    return relational.joined_lines(top, text.context_line(col("source"), col("city"), F.round("price").cast("bigint")), col("id"))


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 4")
def chat_tail(spark, sf_dir):
    return relational.tail(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("select o_orderkey, o_orderstatus = 'P' as blocked from orders order by o_orderdate desc nulls first, o_orderkey limit 1")
def latest_request(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "orders"), [F.desc_nulls_first("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", (col("o_orderstatus") == "P").alias("blocked"))


@query("with n as (select c_custkey + 100 as k, -c_acctbal as bal from customer) select coalesce(c.c_custkey, n.k) as c_custkey, c.c_name, case when n.k is not null then n.bal else c.c_acctbal end as c_acctbal from customer c full outer join n on c.c_custkey = n.k")
def upsert_merge(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return merge.upsert(stored, stored.select((col("c_custkey") + 100).alias("c_custkey"), (-col("c_acctbal")).alias("c_acctbal")), "c_custkey")


@query("select c_custkey, c_name, c_acctbal from customer union all select c_custkey + 100, null, -c_acctbal from customer where c_custkey + 100 not in (select c_custkey from customer)")
def upsert_ignore(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return merge.upsert(stored, stored.select((col("c_custkey") + 100).alias("c_custkey"), (-col("c_acctbal")).alias("c_acctbal")), "c_custkey", ignore_duplicates=True)


@query("select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'cat' else c_mktsegment end as c_mktsegment from customer")
def update_batch(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(col("o_custkey").alias("c_custkey"))
    return merge.update_keys(table(spark, sf_dir, "customer"), keys, "c_custkey", {"c_mktsegment": lit("cat")}).select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def delete_batch(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(col("o_custkey").alias("c_custkey"))
    return merge.delete_keys(table(spark, sf_dir, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query("select r_regionkey as k, r_name as name, null::bigint as nation from region union all select null, n_name, n_nationkey from nation")
def insert_union(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(col("r_regionkey").alias("k"), col("r_name").alias("name"))
    return merge.insert(a, table(spark, sf_dir, "nation").select(col("n_name").alias("name"), col("n_nationkey").cast("bigint").alias("nation")))


@query("select o_orderkey as id, case when o_orderstatus = 'P' then 'completed' else o_orderstatus end as status, case when o_orderstatus = 'P' then timestamp '2024-01-01 00:00:00' end as processed_at from orders")
def queue_transition(spark, sf_dir):
    queue = table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), col("o_orderstatus").alias("status"), lit(None).cast("timestamp_ntz").alias("processed_at"))
    return merge.transition(queue, queue.filter("status = 'P'"), "completed", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


@query("select 'unique' as rule, count(*) as rows from (select o_custkey from orders group by 1 having count(*) > 1)")
def key_check(spark, sf_dir):
    return merge.check_keys(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"])


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority <> '5-LOW' and o_totalprice > 1000 and o_totalprice >= 1000.5 and o_totalprice < 250000.5 and o_orderdate <= timestamp '1998-01-01 00:00:00'")
def qb_compare(spark, sf_dir):
    q = Query(table(spark, sf_dir, "orders")).match(o_orderstatus="O").where("o_orderpriority", "neq", "5-LOW").where("o_totalprice", "gt", 1000)
    return q.where("o_totalprice", "gte", 1000.5).where("o_totalprice", "lt", 250000.5).where("o_orderdate", "lte", datetime(1998, 1, 1)).select("o_orderkey").frame()


@query("select p_partkey from part where p_type like '%O%' and (p_name like '%i%' or p_name like '%o%') and p_brand ilike 'BRAND%' and (p_type ilike '%e%' and p_type ilike '%o%') and (p_name ilike '%R%' or p_name ilike '%B%')")
def qb_like(spark, sf_dir):
    q = Query(table(spark, sf_dir, "part")).where("p_type", "like", "%O%").where("p_name", "like_any", ["%i%", "%o%"]).where("p_brand", "ilike", "BRAND%")
    return q.where("p_type", "ilike_all", ["%e%", "%o%"]).where("p_name", "ilike_any", ["%R%", "%B%"]).select("p_partkey").frame()


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus is not null")
def qb_in(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).where("o_orderpriority", "in", ["1-URGENT", "2-HIGH", "1-URGENT"]).where_not("o_orderstatus", "is", None).select("o_orderkey").frame()


@query("with a as (select o_custkey, list(distinct o_orderstatus) as s from orders group by 1) select o_custkey, list_has_all(s, ['O']) as has, list_has_all(['O', 'F'], s) as within, list_has_any(s, ['P', 'X']) as meets from a")
def qb_array(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return a.select("o_custkey", condition("s", "contains", ["O"]).alias("has"), condition("s", "contained_by", ["O", "F"]).alias("within"), condition("s", "overlaps", ["P", "X"]).alias("meets"))


@query("with r as (select o_custkey, floor(min(o_totalprice))::bigint as lo, floor(max(o_totalprice))::bigint + 1 as hi from orders group by 1) select o_custkey, lo >= 100000 as a, lo >= 50000 as b, hi <= 150000 as c, hi <= 200000 as d, hi = 50000 or lo = 200000 as e from r")
def qb_range_ops(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.struct(F.floor(F.min("o_totalprice")).alias("lo"), (F.floor(F.max("o_totalprice")) + 1).alias("hi")).alias("r"))
    return r.select("o_custkey", condition("r", "range_gt", (50000, 100000)).alias("a"), condition("r", "range_gte", (50000, 100000)).alias("b"), condition("r", "range_lt", (150000, 200000)).alias("c"), condition("r", "range_lte", (150000, 200000)).alias("d"), condition("r", "range_adjacent", (50000, 200000)).alias("e"))


@query("with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents) select doc_id, list_has_all(w, ['the', 'was']) as plain, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') as phrase, list_has_all(w, ['the']) and not list_has_any(w, ['was']) as web from w".replace("\\\\", "\\"))
def qb_text_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", condition("text", "fts", "the was").alias("plain"), condition("text", "phfts", "of the").alias("phrase"), condition("text", "wfts", "the -was").alias("web"))


@query("select o_orderkey from orders where not (o_orderstatus = 'O') and (o_totalprice < 50000 or o_orderpriority = '5-LOW')")
def qb_or_not(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).where_not("o_orderstatus", "eq", "O").where_any(("o_totalprice", "lt", 50000), ("o_orderpriority", "eq", "5-LOW")).select("o_orderkey").frame()


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 20 offset 40")
def qb_range_page(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).order("o_totalprice", ascending=False).order("o_orderkey").range(40, 59).select("o_orderkey", "o_totalprice").frame()


@query("with r as (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by r), '') as orders from customer left join (select * from r where r <= 3) using (c_custkey) group by 1")
def embed_children(spark, sf_dir):
    kids = table(spark, sf_dir, "orders").select(col("o_custkey").alias("c_custkey"), "o_orderkey")
    made = relational.with_children(table(spark, sf_dir, "customer").select("c_custkey"), kids, "c_custkey", "o_orderkey", 3)
    return made.select("c_custkey", F.array_join(F.transform("children", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("select o_orderkey from orders order by o_orderpriority, o_orderkey limit 25")
def quota_limit(spark, sf_dir):
    return relational.take_quota(table(spark, sf_dir, "orders"), 25, [F.asc("o_orderpriority"), F.asc("o_orderkey")]).select("o_orderkey")


@query("with p as (select p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> '') as a from part) select p_partkey, array_to_string(a, ', ') as joined, len(a) as n, list_contains(a, 'SMALL') as small from p")
def csv_list_normalise(spark, sf_dir):
    raw = F.replace(col("p_type"), lit(" "), lit(" , "))
    return table(spark, sf_dir, "part").select("p_partkey", text.join_csv(text.split_csv(raw)).alias("joined"), F.size(text.split_csv(raw)).cast("bigint").alias("n"), text.source_enabled(raw, lit("SMALL")).alias("small"))


@query("with x as (select p_partkey, '<r><pc1>' || p_size || '</pc1>' || chr(10) || '<pc2>B</pc2><sfc>' || p_size || ',5</sfc><ant>19' || (p_size + 40) || '</ant></r>' as xml from part) select p_partkey, regexp_extract(xml, '(?s)<pc1>(.*?)</pc1>.*?<pc2>(.*?)</pc2>', 1) || regexp_extract(xml, '(?s)<pc1>(.*?)</pc1>.*?<pc2>(.*?)</pc2>', 2) as ref, replace(regexp_extract(xml, '<sfc>(.*?)</sfc>', 1), ',', '.')::double as surface_m2, regexp_extract(xml, '<ant>(.*?)</ant>', 1)::int as year_built, 'Residencial' as use from x")
def xml_registry(spark, sf_dir):
    size = col("p_size").cast("string")
    xml = F.concat(lit("<r><pc1>"), size, lit("</pc1>\n<pc2>B</pc2><sfc>"), size, lit(",5</sfc><ant>19"), (col("p_size") + 40).cast("string"), lit("</ant></r>"))
    return table(spark, sf_dir, "part").withColumn("xml", xml).select("p_partkey", text.registry_ref(col("xml")).alias("ref"), text.registry_fields(col("xml")).alias("f")).select("p_partkey", "ref", "f.*")


@query("select event_id, json_extract(props, '$.k')::bigint as k from events where json_extract(props, '$.k') is not null")
def bulk_explode(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.from_json("props", "k bigint"))).alias("p"))
    return parsed.filter("p.k is not null").select("event_id", col("p.k").alias("k"))


@query("select n_nationkey, upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2)) as capital, upper(n_name) as upper_name, substring(n_name, 1, 3) as cut from nation")
def text_basics(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.capitalize(col("n_name")).alias("capital"), F.upper("n_name").alias("upper_name"), text.truncate(col("n_name"), 3).alias("cut"))


@query("select p_partkey, coalesce(nullif(p_size, 1)::varchar, '-') as shown, case when p_size % 2 = 0 then (p_retailprice - 12500.0) else p_retailprice end as base, coalesce(nullif(p_size - p_size, 0), nullif(p_size, 0)) as truthy from part")
def display_values(spark, sf_dir):
    even = col("p_size") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", text.display_default(F.nullif(col("p_size"), lit(1)), "-").alias("shown"), prices.amenity_adjusted(col("p_retailprice"), even, lit(False)).alias("base"), text.first_truthy(col("p_size") - col("p_size"), col("p_size")).alias("truthy"))


@query("with d as (select o_custkey as seller, count(*) as listings, count(*) filter (where o_totalprice > 100000) as dear, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by 1) select seller, listings, dear, cents from d")
def seller_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(col("o_custkey").alias("seller")).agg(F.count(lit(1)).alias("listings"), F.count(F.when(col("o_totalprice") > 100000, 1)).alias("dear"), F.sum(F.round(col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("select user_id from events group by 1")
def stream_dedup(spark, sf_dir):
    return pipelines.run(pipelines.forever_distinct(pipelines.source(spark, f"{sf_dir}/events.parquet"), "user_id").select("user_id"))


@query("select user_id from events group by 1")
def stream_dedup_ttl(spark, sf_dir):
    """All events are one batch here, so no key expires (tests have several batches); which row of a key comes first isn't said, only its key."""
    return pipelines.run(pipelines.distinct_within(pipelines.source(spark, f"{sf_dir}/events.parquet"), "user_id", "ts").select("user_id"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def stream_daily(spark, sf_dir):
    made = pipelines.windowed(pipelines.source(spark, f"{sf_dir}/events.parquet"), "ts", "1 day", "1 day", ["event_type"])
    return pipelines.run(made, "complete").withColumn("start", col("start").cast("timestamp_ntz"))


@query("select user_id as id, arg_max(value, (ts, event_id)) as value from events where event_type is not null group by 1")
def stream_merge(spark, sf_dir):
    """Two streams merged into one keyed table, where each key's newest row counts; the second one also comes under another name."""
    keyed = KeyedTable(spark, f"{pipelines.scratch(spark)}/merged", "id", ["ts", "event_id"], buckets=4)
    stream = pipelines.source(spark, f"{sf_dir}/events.parquet").select(col("user_id").alias("id"), "ts", "event_id", "value", "event_type").filter("event_type is not null")
    for name, part in (("errors", col("event_type") == "error"), ("others", col("event_type") != "error"), ("others again", col("event_type") != "error")):
        pipelines.drain(stream.filter(part), keyed.each(name))
    return keyed.read().select("id", "value")


@query("select count(*) as exact from orders where o_orderstatus = 'O'")
def count_exact(spark, sf_dir):
    return relational.count_of(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")).select(col("n").alias("exact"))
