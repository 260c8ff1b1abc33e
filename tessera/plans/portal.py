"""Queries of list pages, dashboard filters, patches, quotas and refreshed state, with their SQL.

List pages and settings aren't among the tables, so they are composed by Spark from part, orders and customer, in every form that a branch is for.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.functions import cards, extract, prices, scoring, text
from tessera.operators import merge, relational
from tessera.plans.catalog import SCORED, query, scored
from tessera.plans.query import Functions, Query, condition
from tessera.sources.tables import listings, parse_listings, table
from tessera.streaming import pipelines

col, lit = F.col, F.lit
K = "p_partkey"


def _pages(spark, sf_dir, card):
    """Pages of at most 50 parts of a brand, each part a card."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.floor(col(K) / 50).alias("page"), F.struct(K, card.alias("card")).alias("c"))
    made = rows.groupBy("p_brand", "page").agg(F.sort_array(F.collect_list("c")).alias("cards"))
    html = F.concat(lit('<html><body><article class="banner">1 m² 9€</article>'), F.array_join(F.transform("cards", lambda c: c["card"]), "\n"), lit("</body></html>"))
    return made.select("p_brand", html.alias("html"))


def _part(name):
    return col(name).cast("string")


_PRICED = "select p_partkey as k, p_name, p_brand, p_size, round(p_retailprice)::bigint * 25 as price, case when p_partkey % 3 = 0 then 'Particular ' || p_name else p_name end as title from part"


@query(f"with t as ({_PRICED}) select k::varchar as external_id, 'https://www.idealista.com/inmueble/' || k || '/' as url, title, price, upper(p_brand[1]) || lower(p_brand[2:]) as city, p_size as size_m2, case when k % 2 = 0 then '/i/' || k || '.jpg' else '' end as image, k % 3 = 0 as is_individual from t where k % 7 <> 0 and k % 11 <> 0 and p_size % 5 <> 0 and p_size > 0 and price > 0")
def portal_items(spark, sf_dir):
    """Items with classes: some without price, title or size."""
    k, price = col(K), (F.round("p_retailprice").cast("bigint") * 25).cast("string")
    title = F.concat(F.when(k % 3 == 0, "Particular ").otherwise(""), "p_name")
    link = F.concat(lit('<a class="link item-link" href="/inmueble/'), _part(K), lit('/"><b>'), title, lit("</b>\n</a>"))
    said = F.concat(lit('<span class="item-price"><span>'), price, lit("</span><span>€</span></span>"))
    card = F.concat(F.when(k % 2 == 0, '<article class="item big"><div><article>seen</article></div>').otherwise("<article class='big item'>"), F.when(k % 11 == 0, "<p>sold</p>").otherwise(link), F.when(k % 7 == 0, "").otherwise(said), F.when(col("p_size") % 5 == 0, "<p>grande</p>").otherwise(F.concat(lit('<p class="item-detail-char">'), _part("p_size"), lit(" m²</p>"))), F.when(k % 2 == 0, F.concat(lit('<img alt="" src="/i/'), _part(K), lit('.jpg">'))).otherwise(""), lit("</article>"))
    made = cards.list_items(_pages(spark, sf_dir, card), "html", "https://www.idealista.com", col("p_brand"))
    return made.withColumn("image", F.array_join("images", ",")).drop("images")


@query(f"with t as ({_PRICED}), f as (select *, k % 4 = 0 as terrace, k % 6 = 0 as garage from t) select k::varchar as external_id, case when k % 2 = 0 then 'https://www.milanuncios.com/pisos/' || k || '.htm' else 'https://m.example/' || k || '.htm' end as url, p_name as title, price, upper(p_brand[1]) || lower(p_brand[2:]) as city, upper(p_brand[1]) || lower(p_brand[2:]) as neighborhood, p_size as size_m2, case when k % 5 <> 0 then k % 8 end::int as rooms, case when terrace or garage then 80 else 60 end as opportunity_score, concat_ws(',', case when terrace then '☀️ Terraza/Exterior' end, case when garage then '🚗 Garaje/Parking' end) as reasons, p_name || ' ' || price || ' € ' || p_size || ' m²' || case when k % 5 <> 0 then ' ' || k % 8 || ' HAB.' else '' end || case when terrace then ' con Balcón' else '' end || case when garage then ' y cochera' else '' end as description from f where k % 7 <> 0 and price > 22700")
def portal_adverts(spark, sf_dir):
    """Plain cards: rooms, terrace and garage are told by their text only."""
    k, price = col(K), (F.round("p_retailprice").cast("bigint") * 25).cast("string")
    href = F.concat(F.when(k % 2 == 0, "/pisos/").otherwise("https://m.example/"), _part(K), lit(".htm"))
    more = F.concat(F.when(k % 5 != 0, F.concat(lit(" "), (k % 8).cast("string"), lit(" HAB."))).otherwise(""), F.when(k % 4 == 0, " con Balcón").otherwise(""), F.when(k % 6 == 0, " y cochera").otherwise(""))
    card = F.concat(lit('<article data-x="1"><a href="'), href, lit('"><h2 class="t">'), col("p_name"), lit("</h2></a>"), F.when(k % 7 == 0, "").otherwise(F.concat(lit('<div class="ma-AdPrice-value">'), price, lit(" €</div>"))), lit("<p>"), _part("p_size"), lit(" m²"), more, lit("</p></article>"))
    made = cards.adverts(_pages(spark, sf_dir, card), "html", "https://www.milanuncios.com", col("p_brand"), 22_700)
    return made.withColumn("reasons", F.array_join("opportunity_reasons", ",")).drop("opportunity_reasons")


@query(SCORED + ", d2 as (select s.id, s.score, s.city, l.source, l.is_individual from s join l using (id)), n as (select * from d2 where contains(lower(city), 'nation_1')) select 'category' as shown, id from n where source = '5-LOW' union all select 'hot', id from n where score >= 70 union all select 'individual', id from n where is_individual union all select 'all', id from n")
def dashboard_filters(spark, sf_dir):
    """Term, then category before hot (of an older build's 70) before individual."""
    rows = scored(spark, sf_dir).select("id", "city", lit(None).cast("string").alias("title"), col("source").alias("category"), col("s.score").alias("score"), "is_individual")
    ways = {"category": ("5-LOW", "hot"), "hot": (None, "hot"), "individual": (None, "individual"), "all": (None, "all")}
    out = [relational.shown(rows, "NATION_1", category, mode, 70).select(lit(name).alias("shown"), "id") for name, (category, mode) in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("select p_partkey as id, case when p_partkey % 2 = 0 then 'new ' || p_name else p_name end as title, case when p_partkey % 2 = 0 then (case when p_retailprice < 910 then 80 else 50 end) when p_partkey % 3 = 0 then 95 else 60 end as opportunity_score from part")
def score_and_save(spark, sf_dir):
    """Rows found again are scored anew before they are merged: the score that their source gave them is overwritten."""
    part = table(spark, sf_dir, "part").select(col(K).alias("id"), col("p_name").alias("title"), col("p_retailprice").alias("price"), F.when(col(K) % 3 == 0, scoring.auction_score()).otherwise(scoring.amenity_score(lit(False), lit(False))).alias("opportunity_score"))
    found = part.filter("id % 2 = 0").withColumn("title", F.concat(lit("new "), "title"))
    return merge.scored_and_saved(part, found, "id", scoring.binary_score(col("price"), lit(910))).select("id", "title", "opportunity_score")


@query("select c_custkey, case when c_custkey % 2 = 0 then -c_acctbal else c_acctbal end as c_acctbal, case when c_custkey % 4 = 0 then (case when c_custkey % 8 <> 0 then 'seg ' || c_custkey end) else c_mktsegment end as c_mktsegment from customer")
def row_patches(spark, sf_dir):
    """Each row has a patch of its own, with a list of what it sets: a null that is set is stored, what a patch doesn't set stays."""
    stored, k = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), col("c_custkey")
    sets = F.when(k % 4 == 0, F.array(lit("c_acctbal"), lit("c_mktsegment"))).otherwise(F.array(lit("c_acctbal")))
    patches = stored.filter("c_custkey % 2 = 0").select("c_custkey", (-col("c_acctbal")).alias("c_acctbal"), F.when(k % 8 != 0, F.concat(lit("seg "), k.cast("string"))).alias("c_mktsegment"), sets.alias("sets"))
    return merge.patch(stored, patches, "c_custkey", "sets")


@query("with t as (select o_orderkey as id from orders order by o_orderdate desc nulls first, o_orderkey limit 1) select o_orderkey as id, case when t.id is not null then 'error' else o_orderstatus end as status, case when t.id is not null then 'blocked' end as error_message from orders left join t on id = o_orderkey")
def latest_patched(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), col("o_orderstatus").alias("status"), lit(None).cast("string").alias("error_message"), "o_orderdate")
    return merge.patch_latest(rows, [F.desc_nulls_first("o_orderdate"), F.asc("id")], "id", {"status": lit("error"), "error_message": lit("blocked")}).drop("o_orderdate")


@query("select o_orderkey as id, o_orderdate as requested_at from orders where o_orderstatus = 'P' order by o_orderdate nulls first, o_orderkey limit 1")
def queue_next(spark, sf_dir):
    queue = table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), F.when(col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), col("o_orderdate").alias("requested_at"))
    return relational.next_pending(queue).select("id", "requested_at")


@query("with n as (select max(o_orderdate) as now from orders) select o_orderkey as id, o_orderstatus as status, 'o/' || o_orderkey as url from orders union all select o_orderkey, 'pending', 'o/' || o_orderkey from orders, n where o_orderdate < now - interval 10 days")
def requeue_appended(spark, sf_dir):
    """Stale rows put into the queue that already has rows."""
    orders = table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), F.concat(lit("o/"), col("o_orderkey").cast("string")).alias("url"), col("o_orderpriority").alias("source"), col("o_orderdate").alias("updated_at"), col("o_orderstatus").alias("status"))
    now = lit(orders.agg(F.max("updated_at")).first()[0])
    return merge.insert(orders.select("id", "status", "url"), pipelines.requeue(orders, now).select("id", "status", "url"))


@query("select r_regionkey as id, case when r_regionkey = 0 then 25 else 10 end as target_leads, case when r_regionkey = 0 then timestamp '2024-01-01 00:00:00' end as updated_at, r_name as name from region")
def settings_saved(spark, sf_dir):
    stored = table(spark, sf_dir, "region").select(col("r_regionkey").alias("id"), lit(10).alias("target_leads"), lit(None).cast("timestamp_ntz").alias("updated_at"), col("r_name").alias("name"))
    return merge.upsert(stored, stored.filter("id = 0").select("id", lit(25).alias("target_leads"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("updated_at")), "id")


@query("select md5(text) as hash, min(doc_id) as doc_id from documents where md5(text) not in (select md5(text) from documents where lang = 'en') group by 1")
def anti_join_hash(spark, sf_dir):
    """Fragments whose content hash isn't processed; then they are added to those that are."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("hash"))
    processed = rows.filter("lang = 'en'").select("hash").distinct()
    fresh = relational.unprocessed(rows, processed, "hash").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    known = merge.insert(processed, fresh.select("hash"))
    return fresh.join(known.groupBy("hash").agg(F.count(lit(1)).alias("n")).filter("n = 1"), "hash").select("hash", "doc_id")


@query("with m as (select max(p_partkey) as top from part) select p_partkey as id, case when p_partkey % 2 = 0 then 'file ' || p_name else p_name end as name from part union all select p_partkey + top + 1, 'file ' || p_name from part, m where p_partkey % 2 = 1")
def bulk_import(spark, sf_dir):
    """A CSV file that another job has written, merged by key."""
    part = table(spark, sf_dir, "part").select(col(K).alias("id"), col("p_name").alias("name"))
    top = part.agg(F.max("id")).first()[0]
    path = f"{pipelines.scratch(spark)}/import"
    merge.save(part.select(F.when(col("id") % 2 == 0, col("id")).otherwise(col("id") + top + 1).alias("id"), F.concat(lit("file "), "name").alias("name")), path, "csv")
    return merge.upsert(part, merge.load(spark, path, "csv", "id bigint, name string"), "id")


@query("select n_nationkey, n_name, n_regionkey as region, null::varchar as note from nation")
def altered_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("extra", lit(1))
    return merge.guarded(merge.altered(nation, add={"note": "string"}, drop=["extra"], rename={"n_regionkey": "region"}), 1_000).select("n_nationkey", "n_name", "region", "note")


@query("select r_name, row_number() over (order by r_name nulls last) as place from region")
def dimension_by_name(spark, sf_dir):
    """A small dimension in order of its names; places tell the order."""
    frame = Query(table(spark, sf_dir, "region")).order("r_name").select("r_name").frame()
    return frame.withColumn("place", F.row_number().over(relational.W.orderBy(F.asc_nulls_last("r_name"))))


@query("select p_partkey, p_partkey % 3 = 0 as discrepancy, p_size % 2 = 0 as verified, case when p_partkey % 4 = 0 then p_name else 'none.png' end as image, contains(p_name, 'wid') as listed, len(string_split(p_type, ' ')) as words, case when p_partkey % 5 = 0 then p_brand else p_name end as said, case when p_partkey % 4 = 0 then p_name else p_type end as first_of, p_partkey % 6 = 1 as agency from part")
def listing_flags(spark, sf_dir):
    k = col(K)
    reasons = F.when(k % 3 == 0, F.array(lit("x"), lit("Discrepancia de 10 m2"))).when(k % 3 == 1, F.array(lit("x")))
    images = F.when(k % 4 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    said = F.when(k % 5 == 0, "").otherwise(col("p_name"))
    field = F.when(k % 6 == 0, '{"i":true}').when(k % 6 == 1, '{"i":false}').otherwise("{}")
    agency = text.is_agency(F.array_contains(F.json_object_keys(field), "i"), F.get_json_object(field, "$.i").cast("boolean"))
    return table(spark, sf_dir, "part").select(K, text.has_discrepancy(reasons).alias("discrepancy"), text.is_verified(F.when(col("p_size") % 2 == 0, "R1").when(col("p_size") % 4 == 1, "")).alias("verified"), text.first_image(images, "none.png").alias("image"), text.source_shown(col("p_name"), lit("wid")).alias("listed"), F.size(text.split_ws(F.concat(lit(" "), F.replace("p_type", lit(" "), lit(" \t "))))).cast("bigint").alias("words"), text.first_truthy(said, col("p_brand"), kind="text").alias("said"), F.get(text.first_truthy(images, F.array("p_type"), kind="array"), 0).alias("first_of"), agency.alias("agency"))


@query("with u as (select p_partkey, case p_partkey % 6 when 0 then 'https://www.pisos.com/comprar/' || p_partkey when 1 then 'https://www.Fotocasa.es/vivienda/' || p_partkey when 2 then 'https://www.habitaclia.com/comprar/x/l' when 3 then 'https://other.es/vivienda/' || p_partkey when 4 then 'https://www.pisos.com/venta/listado.htm' end as url from part) select p_partkey, url, coalesce(p_partkey % 6 in (1, 3), false) as listing, coalesce(p_partkey % 6 in (0, 1), false) as portal from u")
def portal_urls(spark, sf_dir):
    """URLs found by a search: which are of a listing, and which of a listing on a known portal."""
    k, key = col(K) % 6, _part(K)
    url = F.when(k == 0, F.concat(lit("https://www.pisos.com/comprar/"), key)).when(k == 1, F.concat(lit("https://www.Fotocasa.es/vivienda/"), key)).when(k == 2, "https://www.habitaclia.com/comprar/x/l").when(k == 3, F.concat(lit("https://other.es/vivienda/"), key)).when(k == 4, "https://www.pisos.com/venta/listado.htm")
    return table(spark, sf_dir, "part").select(K, url.alias("url"), text.is_listing_url(url).alias("listing"), text.is_portal_listing(url).alias("portal"))


@query("select page_id, url from pages where contains(url, '/') order by page_id limit 20")
def discovered(spark, sf_dir):
    """The first 20 URLs of a search: the limit is the feature."""
    return relational.take_quota(table(spark, sf_dir, "pages").filter(text.any_of(col("url"), ("/",))), 20, [F.asc("page_id")]).select("page_id", "url")


@query("select 'good' as kind, 'u/' || p_partkey as url, p_retailprice as price, p_partkey % 2 = 0 as terrace from part where p_partkey % 5 <> 0 union all select 'bad', '{broken ' || p_partkey, null, null from part where p_partkey % 5 = 0")
def listing_json(spark, sf_dir):
    """Structured answers read by the canonical schema, and a table of those that can't be read."""
    k = col(K)
    said = F.to_json(F.struct(F.concat(lit("u/"), _part(K)).alias("url"), col("p_retailprice").alias("price"), (k % 2 == 0).alias("has_terrace")))
    good, bad = parse_listings(table(spark, sf_dir, "part").select(F.when(k % 5 == 0, F.concat(lit("{broken "), _part(K))).otherwise(said).alias("j")), "j")
    return good.select(lit("good").alias("kind"), "url", "price", col("has_terrace").alias("terrace")).unionByName(bad.select(lit("bad").alias("kind"), col("j").alias("url"), lit(None).cast("double").alias("price"), lit(None).cast("boolean").alias("terrace")))


@query("select p_partkey, 'Piso ' || p_name as title, p_size::double as price, (p_partkey % 9)::int as rooms, p_size as size_m2, p_partkey % 2 = 0 as has_terrace, p_partkey % 3 = 0 as has_garage from part")
def posts_read(spark, sf_dir):
    """The fields of posts, by the library's own extractor; posts that are too short or say nothing of homes are not asked for."""
    k, key = col(K), _part(K)
    post = F.concat(lit("  Piso "), col("p_name"), lit("\nlarga descripción de un inmueble en venta\n"), (k % 9).cast("string"), lit(" hab, "), _part("p_size"), lit(" m², precio "), _part("p_size"), lit(" €"), F.when(k % 2 == 0, ", terraza").otherwise(""), F.when(k % 3 == 0, ", garaje").otherwise(""))
    short = F.concat(lit("piso "), key)
    posts = table(spark, sf_dir, "part").select(K, F.explode(F.array(post, short, lit("nothing that is said in here is about the things looked for"))).alias("post"))
    made = extract.extracted(posts, "post")
    return made.select(K, "title", "price", "rooms", "size_m2", "has_terrace", "has_garage")


@query("select p_partkey from part where p_partkey % 3 <> 0")
def real_estate_only(spark, sf_dir):
    """False drops a row; true and null keep it."""
    said = F.when(col(K) % 3 == 0, False).when(col(K) % 3 == 1, True)
    return extract.real_estate(table(spark, sf_dir, "part").select(K, said.alias("is_real_estate"))).select(K)


@query("select p_partkey, (p_retailprice * 100 - case when p_partkey % 2 = 0 then 12500.0 else 0 end) / case when p_partkey % 3 = 0 then 1.15 else 1 end as base from part")
def amenity_values(spark, sf_dir):
    k = col(K)
    return table(spark, sf_dir, "part").select(K, prices.amenity_adjusted(col("p_retailprice") * 100, F.when(k % 2 == 0, True), k % 3 == 0).alias("base"))


@query(SCORED + " select id, len(list_filter([drop_pct >= 5, under_pct >= 10], lambda x: x)) as n, coalesce(drop_pct >= 5, false) as dropped, coalesce(under_pct >= 10, false) as under from s")
def score_reasons(spark, sf_dir):
    reasons = col("s.reasons")
    said = F.filter(reasons, lambda r: ~r.contains("individual"))
    return scored(spark, sf_dir).select("id", F.size(said).cast("bigint").alias("n"), F.exists(reasons, lambda r: r.rlike(r"^Price dropped by [0-9]+\.[0-9]%$")).alias("dropped"), F.exists(reasons, lambda r: r.rlike(r"^[0-9]+\.[0-9]% below market$")).alias("under"))


@query("select c_custkey, 'Propiedad en ' || case c_custkey % 3 when 0 then 'Málaga' when 1 then 'None' else c_mktsegment end as title from customer")
def titles_without_city(spark, sf_dir):
    """An absent city, a null one, and one that is there."""
    k = col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", text.default_title(lit(""), F.when(k == 2, col("c_mktsegment")), k != 0).alias("title"))


@query("select o_orderkey from orders where o_orderpriority like '%-%' and o_orderpriority like '%I%' and (o_totalprice > 100000) is true and (o_totalprice > 200000) is not true")
def qb_like_all(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("dear", col("o_totalprice") > 100000).withColumn("dearest", col("o_totalprice") > 200000)
    return Query(rows).where("o_orderpriority", "like_all", ["%-%", "%I%"]).where("dear", "is", True).where_not("dearest", "is", True).select("o_orderkey").frame()


@query("select event_id, json_extract(props, '$.k')::bigint = 7 as json, contains(event_type, 'err') as text, list_has_all([event_type, 'x'], ['x', 'error']) as list from events")
def qb_contains(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("both", F.array("event_type", lit("x")))
    return rows.select("event_id", condition("props", "contains", {"k": 7}).alias("json"), condition("event_type", "contains", "err").alias("text"), condition("both", "contains", ["x", "error"]).alias("list"))


_LINE = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' '".replace("\\\\", "\\")


@query(f"with w as (select doc_id, {_LINE} as w from documents) select doc_id, (contains(w, ' of the ') and not contains(w, ' was ')) or contains(w, ' una ') as web, (contains(w, ' the ') and not contains(w, ' of ')) or contains(w, ' ado ') as raw, contains(w, ' the ') as plain from w")
def qb_text_ways(spark, sf_dir):
    """Quoted phrases, or, minus; the operators of raw searches; and a search with marks between its words."""
    line = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line.select("doc_id", condition("text", "wfts", '"Of the" -was OR una').alias("web"), condition("text", "rfts", "the & !of | ado").alias("raw"), condition("text", "fts", "the, ...").alias("plain"))


@query("select o_orderkey from orders where (o_orderstatus = 'O' and not (o_totalprice < 50000 or o_orderpriority = '5-LOW')) or o_orderpriority = '1-URGENT'")
def qb_nested(spark, sf_dir):
    kept = ("and", ("o_orderstatus", "eq", "O"), ("not", ("or", ("o_totalprice", "lt", 50000), ("o_orderpriority", "eq", "5-LOW"))))
    return Query(table(spark, sf_dir, "orders")).where_any(kept, ("o_orderpriority", "eq", "1-URGENT")).select("o_orderkey").frame()


@query("select o_custkey as seller, count(*) as n from orders where o_totalprice > 150000 group by 1 having count(*) >= 2")
def rpc(spark, sf_dir):
    """A function called by its name and arguments; its result is filtered further."""
    functions = Functions()
    functions.register("sellers_over", lambda least: table(spark, sf_dir, "orders").filter(col("o_totalprice") > least).groupBy(col("o_custkey").alias("seller")).agg(F.count(lit(1)).alias("n")))
    return functions.call("sellers_over", least=150000).where("n", "gte", 2).frame()


@query("with r as (select c_custkey, c_nationkey, row_number() over (order by c_nationkey, c_custkey) as r from customer where c_nationkey between 1 and 5) select c_custkey, c_nationkey from r where r <= 40")
def quota_rounds(spark, sf_dir):
    """Up to five rounds, one group each, until the quota (of the settings, since the request has none) is met."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    quota = relational.quota_of(0, 40)
    return pipelines.rounds(lambda number, left: relational.take_quota(customers.filter(col("c_nationkey") == number), left, [F.asc("c_custkey")]), quota)


def _vector(said: str) -> list[float]:
    return [int(hashlib.md5(f"{said}{i}".encode()).hexdigest()[:4], 16) / 65536 for i in range(4)]


@query("select p_partkey, case when p_partkey % 3 = 0 then '1,2,3,4' else list_aggregate(list_transform(range(4), lambda i: (('0x' || md5(p_name || i)[:4])::int * 4)), 'string_agg', ',') end as vector from part")
def vector_backfill(spark, sf_dir):
    """Every row without a vector gets one, by calls of ten texts, until none is left."""
    rows = table(spark, sf_dir, "part").select(K, "p_name", F.when(col(K) % 3 == 0, F.transform(F.array(*map(lit, (1.0, 2.0, 3.0, 4.0))), lambda x: x / 262144)).alias("vector"))
    made = pipelines.backfill(rows, "p_name", "vector", lambda texts: [_vector(t) for t in texts])
    return made.select(K, F.array_join(F.transform("vector", lambda x: (x * 262144).cast("bigint").cast("string")), ",").alias("vector"))


@query("select ts, event_id, event_type from events order by ts desc, event_id desc limit 1")
def stream_latest(spark, sf_dir):
    """The newest row of a stream, as a page that polls it sees it."""
    stream = pipelines.source(spark, f"{sf_dir}/events.parquet")
    return pipelines.run(pipelines.latest_of(stream, "ts", "event_id", "event_type"), "complete")


@query("select o_orderkey as id, o_totalprice as price from orders order by o_orderkey limit 1000")
def exported(spark, sf_dir):
    """Rows as JSON text, with the export's own limit."""
    made = merge.export(listings(spark, sf_dir).select("id", "price").orderBy("id"))
    return made.select(F.get_json_object("row", "$.id").cast("bigint").alias("id"), F.get_json_object("row", "$.price").cast("double").alias("price"))
