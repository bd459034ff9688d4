"""Registered queries: sources and upserts, scalar forms, resolution, repair and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedstream.functions import exprs as ex
from heedstream.operators import events as ev
from heedstream.operators import logs as lg
from heedstream.operators import repair as rp
from heedstream.operators import resolve as rs
from heedstream.operators import upsert as up
from heedstream.plans._book import Book, r6, rounded
from heedstream.plans.queries_stats import CLASS, classes
from heedstream.sources import adapters as ad
from heedstream.sources import feeds as fd
from heedstream.sources.shared import stage

book = Book()
NTZ = "timestamp_ntz"


# ---- sources and upserts ----

def snapshots(s: SparkSession, d: str) -> DataFrame:
    """Orders as feed snapshots, one a month, with their lines' parts as news; every eleventh item has no date, every thirteenth no keyword."""
    o = ad.bursts(s, d)
    n = ad.news(s, d).groupBy("burst_id").agg(F.sort_array(F.collect_list(F.struct("news_id", "news_title"))).alias("n"))
    day = F.date_format("published_at", "d MMM yyyy HH:mm:ss")
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    news = F.array_join(F.transform(F.coalesce("n", F.array().cast("array<struct<news_id:bigint,news_title:string>>")), lambda x: tag("news_item", F.concat(tag("news_item_title", x["news_title"]), tag("news_item_url", F.concat(F.lit("http://n/"), x["news_id"].cast("string")))))), "")
    item = tag("item", F.concat(tag("title", F.when(F.col("burst_id") % 13 == 0, F.lit("")).otherwise(F.col("keyword"))), tag("approx_traffic", F.col("approx_traffic")), F.when(F.col("burst_id") % 11 == 0, F.lit("")).otherwise(tag("pubDate", F.concat(F.lit("Mon, "), day, F.lit(" -0800")))), news))
    rows = o.join(n, "burst_id", "left").select(F.date_format("published_at", "yyyyMM").alias("batch"), item.alias("item"))
    return rows.groupBy("batch").agg(F.concat(F.lit("<channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel>")).alias("xml")).withColumn("fetched_at", F.to_timestamp("batch", "yyyyMM"))


@book.add(ad.sql("bursts", "SELECT strftime(published_at, '%Y%m') AS batch, count(*) AS items, count(*) FILTER (burst_id % 13 = 0 OR burst_id % 11 = 0) AS skipped, count(DISTINCT CASE WHEN burst_id % 13 <> 0 AND burst_id % 11 <> 0 THEN keyword END) AS keywords, min(CASE WHEN burst_id % 13 <> 0 AND burst_id % 11 <> 0 THEN published_at + INTERVAL 8 HOUR END) AS first_published FROM bursts GROUP BY 1"))
def s1_feed_items(s: SparkSession, d: str) -> DataFrame:
    items = fd.parse_feed(snapshots(s, d))
    ok = lambda c: F.when(F.col("usable"), F.col(c))
    return items.groupBy("batch").agg(F.count("*").alias("items"), F.count_if(~F.col("usable")).alias("skipped"), F.count_distinct(ok("keyword")).alias("keywords"), F.min(ok("published_at")).cast(NTZ).alias("first_published"))


@book.add(ad.sql("bursts news", "SELECT strftime(t.published_at, '%Y%m') AS batch, count(*) AS news, count(DISTINCT n.news_title) AS titles FROM news n JOIN bursts t USING (burst_id) WHERE burst_id % 13 <> 0 AND burst_id % 11 <> 0 GROUP BY 1"))
def s1_feed_news(s: SparkSession, d: str) -> DataFrame:
    return fd.feed_news(fd.parse_feed(snapshots(s, d))).groupBy("batch").agg(F.count("*").alias("news"), F.count_distinct("news_title").alias("titles"))


def polls(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two polls of keyword and segment: events of even days as the table, all of them again and newer as the batch."""
    e = ad.table(s, d, "events").select(F.col("user_id").cast("string").alias("keyword"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("published_at"), F.col("ts").cast("timestamp").alias("fetched_at"), F.concat(F.floor("value").cast("string"), F.lit("+")).alias("approx_traffic"))
    return e.where("day(published_at) % 2 = 0"), e.where("day(published_at) % 3 = 0")


POLLS = "e AS (SELECT CAST(user_id AS VARCHAR) AS keyword, date_trunc('day', ts)::TIMESTAMP AS published_at, ts AS fetched_at, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '+' AS approx_traffic FROM events), o AS (SELECT * FROM e WHERE day(published_at) % 2 = 0), n AS (SELECT * FROM e WHERE day(published_at) % 3 = 0)"


@book.add(f"WITH {POLLS} SELECT keyword, published_at, min(fetched_at) AS fetched_at, arg_max(approx_traffic, row(fetched_at, approx_traffic)) AS approx_traffic FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2")
def s2_trend_upsert(s: SparkSession, d: str) -> DataFrame:
    out = up.upsert_bursts(*polls(s, d))
    return out.select("keyword", F.col("published_at").cast(NTZ).alias("published_at"), F.col("fetched_at").cast(NTZ).alias("fetched_at"), "approx_traffic")


@book.add(ad.sql("news", """x AS (SELECT *, row_number() OVER (PARTITION BY burst_id, news_title ORDER BY news_id) AS k FROM news_raw WHERE news_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM news o WHERE o.news_id % 2 = 0 AND o.burst_id = news_raw.burst_id AND o.news_title = news_raw.news_title))
SELECT burst_id, news_title, news_id FROM news WHERE news_id % 2 = 0 UNION ALL SELECT burst_id, news_title, news_id FROM x WHERE k = 1"""))
def s3_news_insert(s: SparkSession, d: str) -> DataFrame:
    old = ad.news(s, d).where("news_id % 2 = 0").select("burst_id", "news_title", "news_id")
    new = ad.news_raw(s, d).where("news_id % 2 = 1").select("burst_id", "news_title", "news_id")
    return up.insert_or_ignore(old, new, ["burst_id", "news_title"], [F.col("news_id")])


@book.add(ad.sql("observations", "SELECT DISTINCT burst_id, date_trunc('hour', observed_at) AS observed_at FROM observations"))
def s4_observation_log(s: SparkSession, d: str) -> DataFrame:
    rows = ad.observations(s, d).select("burst_id", F.date_trunc("hour", "observed_at").cast(NTZ).alias("observed_at"))
    return up.insert_or_ignore(rows.limit(0), rows, ["burst_id", "observed_at"], [F.col("observed_at")])


def feed_items(s: SparkSession, d: str) -> DataFrame:
    """Events as feed items, a batch a day: some keys come again on other days, some items have no keyword or can't be stored, news differ by kind and day."""
    e, k = ad.table(s, d, "events"), F.col("event_id")
    url = F.concat(F.lit("http://"), "event_type", F.lit("/"), (k % 3).cast("string"))
    item = lambda u: F.struct(F.lit("title").alias("news_item_title"), u.alias("news_item_url"), F.lit("source").alias("news_item_source"))
    news = F.when(k % 4 == 0, F.array().cast("array<struct<news_item_title:string,news_item_url:string,news_item_source:string>>")).otherwise(F.array(item(url), item(F.concat(url, F.lit("#")))))
    return e.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("batch"), F.col("ts").cast("timestamp").alias("fetched_at"), (F.col("user_id") % 40).cast("string").alias("keyword"), F.date_trunc("month", F.col("ts").cast("timestamp")).alias("published_at"),
                    F.lit("1+").alias("approx_traffic"), (k % 11 != 0).alias("usable"), (k % 13 == 0).alias("broken"), news.alias("news"))


FEED_COUNTS = """it AS (SELECT CAST(ts AS DATE) - DATE '2024-01-01' AS batch, ts, user_id % 40 AS kw, date_trunc('month', ts) AS pub, event_id % 11 <> 0 AS usable, event_id % 13 = 0 AS broken, CASE WHEN event_id % 4 = 0 THEN [] ELSE ['http://' || event_type || '/' || (event_id % 3), 'http://' || event_type || '/' || (event_id % 3) || '#'] END AS urls FROM events),
gd AS (SELECT *, row_number() OVER (PARTITION BY kw, pub ORDER BY ts) = 1 AS fresh FROM it WHERE usable AND NOT broken), nb AS (SELECT batch, count(*) AS new_news FROM (SELECT kw, pub, u, min(batch) AS batch FROM (SELECT batch, kw, pub, unnest(urls) AS u FROM gd) GROUP BY 1, 2, 3) GROUP BY 1),
fc AS (SELECT batch, count(*) FILTER (usable) AS items, count(*) FILTER (NOT usable) AS skipped_items, count(*) FILTER (usable AND broken) AS failed_items FROM it GROUP BY 1), fs AS (SELECT batch, count(*) FILTER (fresh) AS new_trends, count(*) FILTER (NOT fresh) AS updated_trends FROM gd GROUP BY 1)"""


@book.add(f"WITH {FEED_COUNTS} SELECT fc.batch, items, coalesce(new_trends, 0) AS new_trends, coalesce(updated_trends, 0) AS updated_trends, coalesce(new_news, 0) AS new_news, skipped_items, failed_items FROM fc LEFT JOIN fs ON fs.batch = fc.batch LEFT JOIN nb ON nb.batch = fc.batch")
def s5_collect_counts(s: SparkSession, d: str) -> DataFrame:
    """Six counters a batch, nothing known before."""
    items = feed_items(s, d)
    none = items.select("keyword", "published_at").limit(0)
    return up.collect_counts(none, none.withColumn("news_url", F.lit("")), items)


@book.add(ad.sql("prices", f"SELECT date, stock_id || 'A' AS stock_id, {r6('open')}, {r6('high')}, {r6('low')}, {r6('close')}, {r6('CASE WHEN day(date) % 2 = 0 THEN adj_close ELSE close END', 'adj_close')}, volume FROM prices"))
def s6_normalise_prices(s: SparkSession, d: str) -> DataFrame:
    p = ad.prices(s, d)
    raw = p.select(F.col("date").cast("timestamp").alias("Date"), F.concat(F.lit(" "), "stock_id", F.lit("a ")).alias("Stock ID"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.when(F.day("date") % 2 == 0, F.col("adj_close")).alias("Adj Close"), F.col("volume").alias("Volume"))
    return rounded(up.normalise_prices(raw), "open", "high", "low", "close", "adj_close")


@book.add(ad.sql("prices", f"SELECT date, stock_id, {r6('CASE WHEN year(date) >= 1997 THEN close * 2 ELSE close END', 'close')} FROM prices WHERE year(date) >= 1997 OR month(date) <> 3"))
def s7_price_upsert(s: SparkSession, d: str) -> DataFrame:
    p = ad.prices(s, d).select("date", "stock_id", "close")
    old, new = p.where("month(date) <> 3"), p.where("year(date) >= 1997").withColumn("close", F.col("close") * 2)
    once = up.upsert(old, new, ["date", "stock_id"])
    return rounded(up.upsert(once, new, ["date", "stock_id"]), "close")


@book.add(ad.sql("prices", "p AS (SELECT CAST(s_suppkey + 1000 AS VARCHAR) AS stock_id FROM supplier UNION SELECT 'NEW') SELECT p.stock_id, max(date) - 14 AS fetch_from FROM p LEFT JOIN prices USING (stock_id) GROUP BY 1"))
def s8_low_watermark(s: SparkSession, d: str) -> DataFrame:
    pool = ad.table(s, d, "supplier").select(ad.stock_code(F.col("s_suppkey")).alias("stock_id")).union(s.range(1).select(F.lit("NEW")))
    return up.low_watermark(pool, ad.prices(s, d))


@book.add(ad.sql("links", "SELECT DISTINCT stock_id, CASE WHEN stock_id LIKE '1%' THEN stock_id || '.TW' ELSE stock_id END AS ticker FROM (SELECT stock_id FROM links UNION SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier)"))
def s9_stock_pool(s: SparkSession, d: str) -> DataFrame:
    """S9, S10."""
    csv = ad.table(s, d, "supplier").select(F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("stock_id"))
    return up.stock_pool(csv, ad.links(s, d)).select("stock_id", ex.ticker(F.col("stock_id")).alias("ticker"))


@book.add(ad.sql("heat", "SELECT keyword, theme_name, date AS burst_date, CASE WHEN burst_score = 40 THEN 0 ELSE burst_score END AS burst_score FROM heat WHERE day(date) <> 5"))
def s11_heat_rows(s: SparkSession, d: str) -> DataFrame:
    h = ad.heat(s, d).select("keyword", "theme_name", F.col("date").alias("burst_date"), F.when(F.col("burst_score") == 40, "bad").otherwise(F.col("burst_score").cast("string")).alias("burst_score"), (F.day("date") == 5).alias("is_partial"))
    rows = up.heat_rows(h)
    return up.upsert(rows, rows, ["keyword", "theme_name", "burst_date"])


@book.add(ad.sql("links bursts", "p AS (SELECT theme_name, keyword, max(CASE WHEN link_type = 'direct' THEN 2 ELSE 1 END) AS rank FROM links GROUP BY 1, 2), l AS (SELECT keyword, max(CAST(published_at AS DATE)) AS last FROM bursts GROUP BY 1) SELECT theme_name, keyword, rank, last FROM p LEFT JOIN l USING (keyword) WHERE last IS NULL OR last < DATE '1998-06-14'"))
def s12_heat_queue(s: SparkSession, d: str) -> DataFrame:
    links = ad.links(s, d)
    history = ad.bursts(s, d).join(links.select("keyword", "theme_name").distinct(), "keyword").select("theme_name", "keyword", F.to_date("published_at").alias("burst_date"))
    return up.heat_queue(links, history, F.lit("1998-06-15").cast("date"))


@book.add("""SELECT DISTINCT replace(p_type, ' ', '') AS theme_name, CASE WHEN p_size % 3 = 0 THEN 'own' WHEN p_brand LIKE '%1' THEN 'dictionary' ELSE '其他' END AS sub_theme, p_brand AS keyword, '' AS stock_id, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS active, replace(p_type, ' ', '') AS category FROM part""")
def s13_theme_rows(s: SparkSession, d: str) -> DataFrame:
    p = ad.table(s, d, "part")
    raw = p.select(F.concat(F.lit(" "), "p_type").alias("theme_name"), F.when(F.col("p_size") % 3 == 0, " own ").alias("sub_theme"), F.concat("p_brand", F.lit(" ")).alias("keyword"), F.lit(None).cast("string").alias("stock_id"), F.when(F.col("p_size") % 2 == 0, "0").otherwise("").alias("active"), F.lit("").alias("category"))
    sub = p.where("p_brand like '%1'").select(ex.theme_form(F.col("p_type")).alias("theme_name"), F.col("p_brand").alias("keyword"), F.lit("dictionary").alias("sub")).distinct()
    return fd.theme_rows(raw, sub)


@book.add("SELECT DISTINCT c_name AS keyword, CASE c_custkey % 3 WHEN 0 THEN 'company' ELSE 'industry' END AS type, 'X' || CAST(c_nationkey AS VARCHAR) AS stock_id FROM customer WHERE c_custkey % 3 < 2")
def s14_alias_rows(s: SparkSession, d: str) -> DataFrame:
    raw = ad.table(s, d, "customer").select(F.concat("c_name", F.lit(" ")).alias("keyword"), F.element_at(F.array(F.lit("Company"), F.lit(" INDUSTRY "), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("stock_id"))
    return fd.alias_rows(raw)


@book.add("WITH r AS (SELECT s_suppkey AS o, s_name AS n, s_name || '|' || 'N' || CAST(s_nationkey AS VARCHAR) AS a, CAST(s_suppkey AS VARCHAR) AS c FROM supplier), x AS (SELECT o, n, c, unnest(string_split(a, '|')) AS alias FROM r) SELECT alias, arg_max(n, o) AS entity_name, arg_max(c, o) AS stock_id FROM x GROUP BY 1")
def s15_seed_aliases(s: SparkSession, d: str) -> DataFrame:
    raw = ad.table(s, d, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("entity_name"), F.col("s_suppkey").cast("string").alias("stock_id"), F.concat(F.lit(" N"), F.col("s_nationkey").cast("string"), F.lit(" |")).alias("aliases"))
    return fd.seed_aliases(raw)


@book.add("""WITH t AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN '綠能環保類' ELSE p_type END AS theme_name, p_brand AS keyword, CAST(p_size % 5 AS VARCHAR) AS stock_id, replace(p_type, ' ', '') AS category FROM part WHERE p_size % 3 = 0),
o AS (SELECT CASE WHEN theme_name = '綠能環保類' THEN theme_name ELSE replace(theme_name, ' ', '') END AS theme_name, keyword, stock_id, category FROM t), n AS (SELECT DISTINCT '綠能環保類' AS theme_name, p_brand AS keyword, CAST(p_size % 5 AS VARCHAR) AS stock_id, replace(p_type, ' ', '') AS category FROM part)
SELECT *, CAST(NULL AS VARCHAR) AS link_type FROM o UNION ALL SELECT *, 'theme' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def s16_sync_themes(s: SparkSession, d: str) -> DataFrame:
    p = ad.table(s, d, "part")
    code = (F.col("p_size") % 5).cast("string").alias("stock_id")
    old = p.where("p_size % 3 = 0").select(F.when(F.col("p_size") % 2 == 0, "綠能環保").otherwise(F.col("p_type")).alias("theme_name"), F.col("p_brand").alias("keyword"), code, F.col("p_type").alias("category")).distinct()
    csv = p.select(F.lit("綠能環保類").alias("theme_name"), F.col("p_brand").alias("keyword"), code, ex.theme_form(F.col("p_type")).alias("category")).distinct()
    return up.sync_themes(old, csv)


@book.add(ad.sql("links", "o AS (SELECT keyword, stock_id, theme_name, theme_name AS category, link_type, 'old' AS sub_theme, CASE WHEN keyword >= 'Customer#000000050' THEN 1 ELSE 0 END AS active FROM links WHERE link_type = 'direct'), n AS (SELECT keyword, stock_id, theme_name, CASE WHEN keyword LIKE '%07' THEN 'other' ELSE theme_name END AS category, keyword LIKE '%07' AS fresh FROM o WHERE keyword LIKE '%7') SELECT o.keyword, o.stock_id, o.theme_name, o.category, CASE WHEN n.keyword IS NULL THEN o.link_type ELSE 'theme' END AS link_type, CASE WHEN n.keyword IS NULL THEN o.sub_theme ELSE 'new' END AS sub_theme, 'kept' AS note, CASE WHEN n.keyword IS NULL THEN o.active ELSE 1 END AS active FROM o LEFT JOIN n ON n.keyword = o.keyword AND n.stock_id = o.stock_id AND NOT n.fresh UNION ALL SELECT keyword, stock_id, theme_name, category, 'theme', 'new', 'lost', 1 FROM n WHERE fresh"))
def s17_reactivate(s: SparkSession, d: str) -> DataFrame:
    """By theme, keyword, stock and category; of a known link only activity, type and sub-theme are set."""
    l = ad.links(s, d).where("link_type = 'direct'").select("keyword", "stock_id", "theme_name", F.col("theme_name").alias("category"), "link_type", F.lit("old").alias("sub_theme"), F.lit("kept").alias("note"), (F.col("keyword") >= "Customer#000000050").cast("int").alias("active"))
    new = l.where("keyword like '%7'").withColumns({"link_type": F.lit("theme"), "active": F.lit(1), "sub_theme": F.lit("new"), "note": F.lit("lost"), "category": F.when(F.col("keyword").like("%07"), "other").otherwise(F.col("category"))})
    return up.upsert_columns(l, new, ["theme_name", "keyword", "stock_id", "category"], ["active", "link_type", "sub_theme"])


@book.add(f"WITH {CLASS}, n AS (SELECT c_name AS keyword, 'new' AS theme_name, 'model' AS source FROM customer WHERE c_custkey % 2 = 0) SELECT keyword, CASE WHEN c.keyword IS NULL OR (c.source = 'fallback' AND n.keyword IS NOT NULL) THEN n.theme_name ELSE c.theme_name END AS theme_name, CASE WHEN c.keyword IS NULL OR (c.source = 'fallback' AND n.keyword IS NOT NULL) THEN n.source ELSE c.source END AS source FROM cl c FULL JOIN n USING (keyword)")
def s18_guarded_upsert(s: SparkSession, d: str) -> DataFrame:
    new = ad.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("keyword"), F.lit("new").alias("theme_name"), F.lit("model").alias("source"))
    return up.guarded_classification(classes(s, d).select("keyword", "theme_name", "source"), new)


@book.add(f"""WITH {CLASS}, o AS (SELECT keyword, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE theme_name END AS theme_name, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 = 0 THEN 'rule' ELSE source END AS source, canonical_keyword FROM cl JOIN customer ON c_name = keyword),
n AS (SELECT c_name AS keyword, 'Entity ' || c_name AS canonical_keyword FROM customer WHERE c_custkey % 2 = 0), m AS (SELECT coalesce(o.keyword, n.keyword) AS keyword, n.keyword IS NOT NULL AND (o.keyword IS NULL OR o.source = 'fallback' OR coalesce(o.theme_name, '其他') = '其他') AS take, n.canonical_keyword AS nc, o.* EXCLUDE (keyword) FROM o FULL JOIN n ON n.keyword = o.keyword)
SELECT keyword, CASE WHEN take THEN '新' ELSE theme_name END AS theme_name, CASE WHEN take THEN 'entity_resolution' ELSE source END AS source, CASE WHEN take THEN nc ELSE canonical_keyword END AS canonical_keyword FROM m""")
def s18_entity_upsert(s: SparkSession, d: str) -> DataFrame:
    """S18 with the entity guard: rows under the other theme or under none give way too, whatever their source."""
    k = F.col("c_custkey")
    old = classes(s, d).join(ad.table(s, d, "customer").select(k, F.col("c_name").alias("keyword")), "keyword")
    old = old.select("keyword", F.when(k % 11 != 0, F.col("theme_name")).alias("theme_name"), F.when(k % 8 == 0, "rule").otherwise(F.col("source")).alias("source"), "canonical_keyword")
    new = ad.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("keyword"), F.concat(F.lit("Entity "), "c_name").alias("canonical_keyword"), F.lit("新").alias("theme_name"), F.lit("entity_resolution").alias("source"))
    return up.guarded_classification(old, new, entity=True)


@book.add("""SELECT c_name AS keyword, '{"nation":' || CAST(c_nationkey AS VARCHAR) || ',"segment":"' || c_mktsegment || '"}' AS result FROM customer""")
def s19_classification_log(s: SparkSession, d: str) -> DataFrame:
    return up.classification_log(ad.table(s, d, "customer").select(F.col("c_name").alias("keyword"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")))


@book.add(ad.sql("news", "SELECT news_id, CASE WHEN news_sentiment IS NULL AND news_id % 3 = 0 THEN 'Neutral' ELSE news_sentiment END AS news_sentiment, CASE WHEN news_sentiment IS NULL AND news_id % 3 = 0 THEN CAST(0.25 AS DOUBLE) WHEN news_sentiment IS NOT NULL THEN CAST(0.5 AS DOUBLE) END AS sentiment_score, CASE WHEN news_sentiment IS NULL AND news_id % 3 = 0 THEN 'model' WHEN news_sentiment IS NOT NULL THEN 'kept' END AS event_type FROM news"))
def s20_enrich_news(s: SparkSession, d: str) -> DataFrame:
    n = ad.news(s, d).select("news_id", "news_sentiment", F.when(F.col("news_sentiment").isNotNull(), 0.5).alias("sentiment_score"), F.when(F.col("news_sentiment").isNotNull(), "kept").alias("event_type"))
    p = n.where("news_id % 3 = 0").select("news_id", F.lit("Neutral").alias("news_sentiment"), F.lit(0.25).alias("sentiment_score"), F.lit("model").alias("event_type"))
    return up.enrich_news(n, p)


@book.add(ad.sql("prices", f"k AS (SELECT DISTINCT CAST(s_suppkey + 1000 AS VARCHAR) AS stock_id FROM supplier WHERE s_nationkey < 5) SELECT stock_id, date, {r6('close')} FROM prices JOIN k USING (stock_id) WHERE date >= DATE '1997-06-01'"))
def s23_filtered_prices(s: SparkSession, d: str) -> DataFrame:
    wanted = ad.table(s, d, "supplier").where("s_nationkey < 5").select(ad.stock_code(F.col("s_suppkey")).alias("stock_id"))
    return rounded(fd.prices_of(ad.prices(s, d), wanted, F.lit("1997-06-01").cast("date")).select("stock_id", "date", "close"), "close")


@book.add("""SELECT 'M.' || CAST(epoch(o_orderdate)::BIGINT + o_orderkey % 1000 AS VARCHAR) || '.A.X' || CAST(o_orderkey AS VARCHAR) AS post_id, CASE WHEN o_orderkey % 3 = 0 THEN '標的' END AS category, CASE o_orderkey % 4 WHEN 0 THEN 100 WHEN 1 THEN -30 WHEN 2 THEN 17 ELSE 0 END AS push_score, (o_orderdate + to_seconds(CAST(o_orderkey % 1000 AS BIGINT))) AS posted_at FROM orders WHERE o_orderkey % 7 <> 0""")
def s24_posts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    secs = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 1000
    rows = ad.table(s, d, "orders").select(F.when(k % 7 != 0, F.concat(F.lit("/bbs/M."), secs.cast("string"), F.lit(".A.X"), k.cast("string"), F.lit(".html"))).alias("href"), F.when(k % 3 == 0, F.concat(F.lit("Re: [標的] "), k.cast("string"))).otherwise("plain").alias("title"), F.element_at(F.array(F.lit("爆"), F.lit("X3"), F.lit("17"), F.lit("")), (k % 4 + 1).cast("int")).alias("label"), F.lit("a").alias("author"))
    return fd.posts(rows).select("post_id", "category", "push_score", F.col("posted_at").cast(NTZ).alias("posted_at"))


@book.add("""WITH c AS (SELECT conv_id, turn, text, TIMESTAMP '2026-11-20 03:00:00' + to_days(CAST(conv_id % 60 AS INTEGER)) AS posted, (conv_id + turn) % 12 + 1 AS mo FROM conversations), l AS (SELECT *, posted + INTERVAL 8 HOUR AS loc FROM c)
SELECT conv_id AS post_id, turn AS seq, make_timestamp(year(loc) + CASE WHEN mo < month(loc) - 6 THEN 1 ELSE 0 END, mo, 15, 9, 30, 0) - INTERVAL 8 HOUR AS commented_at, length(text) AS chars FROM l""")
def s24_comments(s: SparkSession, d: str) -> DataFrame:
    c = ad.table(s, d, "conversations")
    month = (F.col("conv_id") + F.col("turn")) % 12 + 1
    rows = c.select(F.col("conv_id").alias("post_id"), F.col("turn").alias("seq"), F.expr("timestamp '2026-11-20 03:00:00' + make_dt_interval(cast(conv_id % 60 as int))").alias("posted_at"), F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("/15 09:30")).alias("stamp"), F.lit("u").alias("user"), F.concat(F.lit(": "), "text").alias("text"))
    return fd.comments(rows).select("post_id", "seq", F.col("commented_at").cast(NTZ).alias("commented_at"), F.length("text").alias("chars"))


POSTS = "p AS (SELECT conv_id AS post_id, min(role) AS title, count(*) AS turns FROM conversations GROUP BY 1)"


@book.add(f"WITH {POSTS} SELECT post_id, title, CASE WHEN post_id % 2 = 0 THEN '爆' ELSE '' END AS label, CASE WHEN post_id % 2 = 0 THEN 100 ELSE 0 END AS score FROM p UNION ALL SELECT -1 - post_id, 'new', '爆', 100 FROM p WHERE post_id % 4 = 0")
def s25_post_upsert(s: SparkSession, d: str) -> DataFrame:
    """Known posts take only label and score, unknown ones come in whole."""
    c = ad.table(s, d, "conversations").groupBy(F.col("conv_id").alias("post_id")).agg(F.min("role").alias("title")).select("post_id", "title", F.lit("").alias("label"), F.lit(0).alias("score"))
    new = c.where("post_id % 2 = 0").select("post_id", F.lit("changed").alias("title"), F.lit("爆").alias("label"), F.lit(100).alias("score"))
    new = new.union(c.where("post_id % 4 = 0").select(-1 - F.col("post_id"), F.lit("new"), F.lit("爆"), F.lit(100)))
    return up.upsert_columns(c, new, ["post_id"], ["label", "score"])


@book.add("SELECT conv_id AS post_id, turn AS seq, length(text) + CASE WHEN conv_id % 3 = 0 OR turn % 2 = 0 THEN 0 ELSE 1 END AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(text) DESC) = 1")
def s25_comment_replace(s: SparkSession, d: str) -> DataFrame:
    """Threads that have comments are left out; comments of the others replace those of their post and place."""
    c = ad.table(s, d, "conversations").groupBy(F.col("conv_id").alias("post_id"), F.col("turn").alias("seq")).agg(F.max(F.length("text")).alias("chars"))
    loaded = c.where("post_id % 3 = 0")
    waiting = up.unloaded(c.select("post_id").distinct(), loaded)
    read = c.withColumn("chars", F.col("chars") + F.when(F.col("seq") % 2 == 0, 0).otherwise(1)).join(waiting, "post_id", "left_semi")
    before = read.withColumn("chars", F.lit(0))
    return up.upsert(loaded.union(before.where("seq = 0")), read, ["post_id", "seq"])


@book.add("""WITH a AS (SELECT p_partkey AS article_id, p_name AS title, CASE p_size % 4 WHEN 0 THEN 100 WHEN 1 THEN -10 WHEN 2 THEN p_size ELSE 0 END AS engagement FROM part WHERE p_size % 6 <> 0), k AS (SELECT DISTINCT 'k' || CAST(l_suppkey AS VARCHAR) AS keyword, l_partkey FROM lineitem) SELECT keyword, article_id, title, engagement FROM k JOIN a ON article_id = l_partkey""")
def s26_board_keywords(s: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size")
    rows = ad.table(s, d, "part").select(F.col("p_partkey").alias("article_id"), F.when(z % 6 == 0, F.concat(F.lit("[公告] "), "p_name")).otherwise(F.col("p_name")).alias("title"), F.when(z % 4 == 0, "爆").when(z % 4 == 1, "X2").when(z % 4 == 2, z.cast("string")).otherwise("").alias("label"))
    k = ad.table(s, d, "lineitem").groupBy(F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("keyword")).agg(F.collect_set("l_partkey").alias("matched_ids"))
    return fd.keyword_articles(k, fd.board_articles(rows))


@book.add("""SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN '匿名' ELSE c_mktsegment END AS author, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS engagement, TIMESTAMP '2024-05-01 10:20:30' AS created_at, '["' || c_mktsegment || '"]' AS topics FROM customer""")
def s27_social_posts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("title"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("author"), F.col("c_nationkey").alias("likes"), F.when(k % 3 != 0, 2).alias("comments"), F.lit("2024-05-01T10:20:30").alias("created_at"), F.array("c_mktsegment").alias("topics")))
    rows = fd.social_posts(ad.table(s, d, "customer").select(value.alias("value")))
    return up.upsert(rows, rows, ["id"]).withColumn("created_at", F.col("created_at").cast(NTZ))


@book.add(ad.sql("prices", f"SELECT stock_id AS ticker, date, {r6('close')}, volume, month(date) AS month, quarter(date) AS quarter FROM prices"))
def s28_star_prices(s: SparkSession, d: str) -> DataFrame:
    rows = fd.star_prices(ad.prices(s, d))
    return rounded(up.upsert(rows, rows, ["ticker", "date"]), "close")


@book.add("SELECT stock_id, arg_min(name, row(p, name)) AS name FROM (SELECT CAST(s_suppkey AS VARCHAR) AS stock_id, s_name AS name, 0 AS p FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 1 FROM customer WHERE c_custkey % 5 <> 0) GROUP BY 1")
def s29_official_codes(s: SparkSession, d: str) -> DataFrame:
    a = ad.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("code"), F.concat("s_name", F.lit(" ")).alias("name"))
    b = ad.table(s, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("name"))
    return fd.official_codes(a, b)


# ---- scalar forms ----

@book.add("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN k * 1000 WHEN 1 THEN (k + 0.5) * 1000000 WHEN 2 THEN k ELSE 0 END AS f1, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(k AS DOUBLE) END AS f2 FROM (SELECT *, floor(o_totalprice / 1000) AS k FROM orders)")
def f1_traffic(s: SparkSession, d: str) -> DataFrame:
    """F1, F2."""
    k = F.floor(F.col("o_totalprice") / 1000).cast("string")
    text = F.element_at(F.array(F.concat(k, F.lit("k+")), F.concat(k, F.lit(".5M")), F.concat(k, F.lit("+")), F.lit("none")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return ad.table(s, d, "orders").select("o_orderkey", ex.traffic_number(text).alias("f1"), ex.traffic_digits(text).alias("f2"))


@book.add(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2330 ' || p_name || '股價' WHEN 1 THEN '飆股' || upper(p_name) || '股票走勢' ELSE p_brand || '_' || p_type END AS x, CASE WHEN p_size % 2 = 0 THEN p_type || ' 電子' ELSE p_type || '銀行' END AS ind FROM part)
SELECT p_partkey, regexp_replace(lower(x), '[^\pL\pN]+', '', 'g') AS f3, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(x, '^\d{4,6}\s*', ''), '^飆股', ''), '(股價分析|股票走勢|股價|股票|股市)$', '')), '[^\pL\pN]+', '', 'g') AS f4, CASE WHEN ind LIKE '%銀行' THEN '金融類' ELSE '科技類' END AS f6 FROM t""")
def f3_forms(s: SparkSession, d: str) -> DataFrame:
    """F3-F6."""
    k = F.col("p_partkey")
    x = F.when(k % 3 == 0, F.concat(F.lit("2330 "), "p_name", F.lit("股價"))).when(k % 3 == 1, F.concat(F.lit("飆股"), F.upper("p_name"), F.lit("股票走勢"))).otherwise(F.concat("p_brand", F.lit("_"), "p_type"))
    ind = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" 電子"))).otherwise(F.concat("p_type", F.lit("銀行")))
    return ad.table(s, d, "part").select("p_partkey", ex.keyword_form(x).alias("f3"), ex.entity_form(x).alias("f4"), ex.industry_theme(ind).alias("f6"))


@book.add("SELECT o_orderkey, CAST(o_orderdate + to_seconds(CAST(o_orderkey * 977 % 86400 AS BIGINT)) + INTERVAL 8 HOUR AS DATE) AS f9, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 8 HOUR AS f10, o_orderdate + to_seconds(CAST(o_orderkey * 977 % 86400 AS BIGINT)) AS f12 FROM orders")
def f9_times(s: SparkSession, d: str) -> DataFrame:
    """UTC to Taipei days and back, and the strict layouts."""
    t = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 977 % 86400)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return ad.table(s, d, "orders").select("o_orderkey", ex.taipei_day(t).alias("f9"), ex.day_start_utc(F.to_date("o_orderdate")).cast(NTZ).alias("f10"), ex.strict_time(text).cast(NTZ).alias("f12"))


@book.add("""WITH t AS (SELECT event_id, ts, CAST(strftime(ts, '%w') AS INTEGER) AS w, hour(ts) * 60 + minute(ts) AS m FROM events), x AS (SELECT *, CAST(ts AS DATE) - CASE WHEN m >= 1110 THEN 0 ELSE 1 END AS e FROM t)
SELECT event_id, e - greatest(CAST((isodow(e) - 5) AS INTEGER), 0) AS expected, CAST(ts AS DATE) + CASE WHEN w BETWEEN 1 AND 5 AND m < 810 THEN 0 ELSE 1 END AS effective, CASE WHEN w IN (0, 6) THEN 'weekend' WHEN m < 540 THEN 'pre' WHEN m < 810 THEN 'in' ELSE 'after' END AS session, CAST(ts - INTERVAL 8 HOUR AS DATE) AS quota FROM x""")
def f18_days(s: SparkSession, d: str) -> DataFrame:
    """F18-F20."""
    t = F.col("ts").cast("timestamp")
    return ad.table(s, d, "events").select("event_id", ex.expected_trading_day(t).alias("expected"), ex.effective_day(t).alias("effective"), ex.market_session(t).alias("session"), ex.quota_day(t, 8).alias("quota"))


@book.add("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'Unanalyzed' END AS tone, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, c_acctbal / 5000)) END AS confidence, CASE WHEN c_nationkey = 0 THEN 'Day0' WHEN c_nationkey < 5 THEN 'N/A' ELSE CAST(c_nationkey AS VARCHAR) END AS breakout, CASE WHEN c_custkey % 3 = 0 THEN 'short' WHEN c_custkey % 3 = 1 THEN 'long' ELSE 'other' END AS side, c_custkey % 2 = 0 AS same_name FROM customer")
def f13_labels(s: SparkSession, d: str) -> DataFrame:
    """F8, F13, F14, F17, F21."""
    k = F.col("c_custkey")
    tone = F.element_at(F.array(F.lit(" positive "), F.lit("NEGATIVE"), F.lit("mixed"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    side = F.element_at(F.array(F.lit("看空"), F.lit("做多"), F.lit("盤整")), (k % 3 + 1).cast("int"))
    name = F.when(k % 2 == 0, "中信金").otherwise("台積電")
    return ad.table(s, d, "customer").select("c_custkey", ex.sentiment_form(tone).alias("tone"), ex.clamp_confidence(F.when(k % 5 == 0, "x").otherwise((F.col("c_acctbal") / 5000).cast("string"))).alias("confidence"), ex.breakout_label(F.when(F.col("c_nationkey") == 0, 0).when(F.col("c_nationkey") >= 5, F.col("c_nationkey"))).alias("breakout"), ex.post_side(side).alias("side"), ex.names_match(name, F.lit("中國信託金融控股股份有限公司")).alias("same_name"))


# ---- resolution ----

def dictionary(s: SparkSession, d: str) -> DataFrame:
    """Supplier names as companies, nations as industries."""
    a = ad.table(s, d, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("keyword"), F.lit("company").alias("type"), ad.stock_code(F.col("s_suppkey")).alias("stock_id"))
    n = ad.table(s, d, "nation").join(ad.table(s, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select((F.col("s_suppkey") + 1_000_000).alias("ordinal"), F.col("n_name").alias("keyword"), F.lit("industry").alias("type"), ad.stock_code(F.col("s_suppkey")).alias("stock_id"))
    return a.union(n)


def asked(s: SparkSession, d: str) -> DataFrame:
    """Part brands, nations, and of each supplier its name, the name with a small change or the bare code, as keywords."""
    sup = ad.table(s, d, "supplier")
    return (sup.select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.upper("s_name"), F.lit("x"))).otherwise(ad.stock_code(F.col("s_suppkey"))).alias("keyword"))
            .union(ad.table(s, d, "nation").select("n_name")).union(ad.table(s, d, "part").select("p_brand")).distinct())


def all_asked(s: SparkSession, d: str) -> DataFrame:
    """Each supplier's name, the name with a small change and its bare code, all nations, and all part brands and types, as keywords."""
    k = ad.table(s, d, "supplier").select(F.explode(F.array(F.col("s_name"), F.concat(F.upper("s_name"), F.lit("x")), ad.stock_code(F.col("s_suppkey")))).alias("keyword"))
    p = ad.table(s, d, "part")
    return k.union(ad.table(s, d, "nation").select("n_name")).union(p.select("p_brand")).union(p.select("p_type")).distinct()


@book.add()
def j3_fuzzy_match(s: SparkSession, d: str) -> DataFrame:
    return rs.fuzzy_match(all_asked(s, d), dictionary(s, d)).withColumn("stock_ids", F.array_join("stock_ids", ","))


def _entity(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seeds = ad.table(s, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("alias"), F.concat(F.lit("Seed "), "s_name").alias("entity_name"), F.lit("上市公司").alias("entity_type"), ad.stock_code(F.col("s_suppkey")).alias("stock_id"), F.lit("半導體").alias("industry"), F.lit("科技類").alias("theme_name"))
    official = ad.table(s, d, "supplier").select(ad.stock_code(F.col("s_suppkey")).alias("stock_id"), F.concat(F.lit("Official "), F.col("s_suppkey").cast("string")).alias("name"))
    return rs.known_companies(dictionary(s, d), seeds), official, ad.table(s, d, "nation").select(F.col("n_name").alias("keyword"))


FORM = "regexp_replace(lower({x}), '[^\\pL\\pN]+', '', 'g')"
ENT = rf"""sup AS (SELECT s_suppkey AS k, s_name AS nm, CAST(s_suppkey + 1000 AS VARCHAR) AS code, s_nationkey FROM supplier), ak AS (SELECT DISTINCT kw FROM (SELECT CASE k % 3 WHEN 0 THEN nm WHEN 1 THEN upper(nm) || 'x' ELSE code END AS kw FROM sup UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_brand FROM part)),
sf AS (SELECT {FORM.format(x='nm')} AS form, * FROM sup), ind AS (SELECT k, n_name AS industry FROM sup JOIN nation ON n_nationkey = s_nationkey),
r AS (SELECT kw AS keyword, CASE WHEN c.k % 9 = 0 THEN 'Seed ' || c.nm WHEN c.k IS NOT NULL THEN c.nm WHEN o.k IS NOT NULL AND NOT regexp_matches(kw, '^20[23]\d$') THEN 'Official ' || o.k WHEN n.n_name IS NOT NULL THEN n.n_name END AS canonical,
  CASE WHEN c.k IS NOT NULL OR (o.k IS NOT NULL AND NOT regexp_matches(kw, '^20[23]\d$')) THEN '上市公司' WHEN n.n_name IS NOT NULL THEN '產業' END AS entity_type, CASE WHEN c.k IS NOT NULL THEN c.code WHEN o.k IS NOT NULL AND NOT regexp_matches(kw, '^20[23]\d$') THEN o.code WHEN n.n_name IS NOT NULL THEN '' END AS stock_id,
  CASE WHEN c.k % 9 = 0 THEN 'seed' WHEN c.k IS NOT NULL THEN 'alias' WHEN o.k IS NOT NULL AND NOT regexp_matches(kw, '^20[23]\d$') THEN 'code' WHEN n.n_name IS NOT NULL THEN 'industry' END AS source
  FROM ak LEFT JOIN sf c ON c.form = {FORM.format(x='kw')} LEFT JOIN sup o ON o.code = kw LEFT JOIN nation n ON n.n_name = kw)"""


@book.add(f"WITH {ENT} SELECT * FROM r")
def j7_resolution_cascade(s: SparkSession, d: str) -> DataFrame:
    """Seed, alias, code and industry in turn."""
    known, official, industries = _entity(s, d)
    return rs.resolve(asked(s, d), known, official, industries).select("keyword", "canonical", "entity_type", "stock_id", "source")


@book.add("""SELECT s_name AS keyword, 'Official' AS canonical, CASE WHEN s_suppkey % 4 = 3 THEN '產業' ELSE '上市公司' END AS entity_type, CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE CAST(s_suppkey + 1000 AS VARCHAR) END AS stock_id, CASE WHEN s_suppkey % 4 = 3 THEN '金融類' ELSE '科技類' END AS theme_name, CAST(0.75 AS DOUBLE) AS confidence_score FROM supplier WHERE s_suppkey % 4 IN (0, 3)""")
def j8_prediction_gate(s: SparkSession, d: str) -> DataFrame:
    """Predictions with low confidence, without a code, or with another company's code are refused."""
    k = F.col("s_suppkey")
    p = ad.table(s, d, "supplier").select(F.col("s_name").alias("keyword"), F.when(k % 4 == 1, "Stranger").otherwise("Official").alias("canonical_entity"), F.when(k % 4 == 3, "產業").otherwise("上市公司").alias("entity_type"), ad.stock_code(k).alias("stock_id"), F.lit("電子").alias("industry"), F.lit("金融類").alias("theme_name"), F.when(k % 4 == 2, "0.3").otherwise("0.75").alias("confidence_score"))
    return rs.gate_predictions(p, _entity(s, d)[1], ["上市公司", "ETF", "產業"], ["金融類", "科技類"]).drop("industry")


#: What entity resolution saves: companies by their canonical names, everything else as fallbacks; needs ENT.
SAVE = """sv AS (SELECT r.*, entity_type IN ('上市公司', 'ETF') AS company, CASE WHEN source = 'seed' THEN '科技類' ELSE '其他' END AS theme_name, CASE source WHEN 'seed' THEN '半導體' WHEN 'alias' THEN ind.industry WHEN 'industry' THEN canonical ELSE '' END AS industry, CASE WHEN source = 'industry' THEN 0.95 ELSE 1.0 END AS confidence_score FROM r LEFT JOIN ind ON CAST(ind.k + 1000 AS VARCHAR) = r.stock_id WHERE source IS NOT NULL),
old_names AS (SELECT keyword, CASE WHEN length(keyword) % 2 = 0 THEN 'Old ' || keyword END AS name FROM r),
lk AS (SELECT '其他' AS theme_name, keyword, 'old' AS stock_id FROM r UNION ALL SELECT '其他', 'Old ' || keyword, 'older' FROM r UNION ALL SELECT 'kept', keyword, 'old' FROM r),
gone AS (SELECT keyword AS k FROM sv WHERE company UNION SELECT name FROM sv JOIN old_names USING (keyword) WHERE company AND name IS NOT NULL)"""


def _saved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J9 over resolved keywords, their earlier canonical names, and links under both old names, of which one kind is of another theme."""
    known, official, industries = _entity(s, d)
    resolved = stage(rs.resolve(asked(s, d), known, official, industries), "resolved")
    before = asked(s, d).select("keyword", F.when(F.length("keyword") % 2 == 0, F.concat(F.lit("Old "), "keyword")).alias("canonical_keyword"))
    link = lambda theme, name, stock: asked(s, d).select(F.lit(theme).alias("theme_name"), name.alias("keyword"), F.lit(stock).alias("stock_id"), F.lit(None).cast("string").alias("link_type"), F.lit(1).alias("active"))
    links = link("其他", F.col("keyword"), "old").union(link("其他", F.concat(F.lit("Old "), "keyword"), "older")).union(link("kept", F.col("keyword"), "old"))
    return rs.entity_save(resolved, links, before)


@book.add(f"WITH {ENT}, {SAVE} SELECT theme_name, keyword, stock_id, CAST(NULL AS VARCHAR) AS link_type, CASE WHEN theme_name = '其他' AND keyword IN (SELECT k FROM gone) THEN 0 ELSE 1 END AS active FROM lk UNION ALL SELECT DISTINCT theme_name, canonical, stock_id, 'direct', 1 FROM sv WHERE company")
def j9_entity_save(s: SparkSession, d: str) -> DataFrame:
    """Links after companies came in under their canonical names."""
    return _saved(s, d)[2]


@book.add(f"WITH {ENT}, {SAVE} SELECT keyword, canonical AS canonical_keyword, entity_type, CASE WHEN company THEN theme_name ELSE '其他' END AS theme_name, coalesce(nullif(industry, ''), '未分類') AS sub_theme, CAST(company AS INTEGER) AS stock_related, confidence_score, CASE WHEN company THEN 'entity_resolution' ELSE 'fallback' END AS source, CAST(confidence_score < 0.85 AS INTEGER) AS need_review FROM sv")
def j9_classifications(s: SparkSession, d: str) -> DataFrame:
    return _saved(s, d)[1]


@book.add(f"WITH {ENT}, {SAVE} SELECT canonical AS entity_name, arg_max(entity_type, keyword) AS entity_type, arg_max(stock_id, keyword) FILTER (stock_id <> '') AS stock_id, arg_max(industry, keyword) FILTER (industry <> '') AS industry, arg_max(CASE WHEN source = 'industry' THEN '其他' ELSE theme_name END, keyword) AS theme_name, arg_max(confidence_score, keyword) AS confidence_score, arg_max(source, keyword) AS source FROM sv GROUP BY 1")
def j9_entities(s: SparkSession, d: str) -> DataFrame:
    return _saved(s, d)[0]


#: Companies with names in two scripts, theme words, and words that hold one; for exact company hits only, as likeness isn't SQL's.
RULES = rf"""cn AS (SELECT s_suppkey AS k, s_suppkey * 10 + o AS ordinal, CASE o WHEN 0 THEN s_name WHEN 1 THEN '公司' || s_suppkey || '長名' WHEN 2 THEN '公司' || s_suppkey ELSE 'S' || s_suppkey END AS name FROM supplier, (SELECT unnest(range(0, 4)) AS o) WHERE o = 0 OR s_suppkey % 4 > 4 - o - 1),
t AS (SELECT p_brand AS kw, {FORM.format(x='p_brand')} AS form, min(p_partkey) AS o FROM part GROUP BY 1, 2),
w AS (SELECT DISTINCT x AS keyword, {FORM.format(x='x')} AS whole FROM (SELECT upper(s_name) AS x FROM supplier UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'best ' || p_brand || ' parts' FROM part UNION ALL SELECT 'offer ' || p_name FROM part UNION ALL SELECT '!!!')),
e AS (SELECT w.keyword, t.kw FROM w JOIN t ON t.form = w.whole), h AS (SELECT w.keyword, cn.k FROM w JOIN cn ON {FORM.format(x='cn.name')} = w.whole WHERE w.keyword NOT IN (SELECT keyword FROM e)),
c AS (SELECT h.keyword, h.k, arg_min(cn.name, row(CASE WHEN regexp_full_match(cn.name, '[\x00-\x7F]*') THEN 1 ELSE 0 END, length(cn.name), cn.ordinal)) AS name FROM h JOIN cn USING (k) GROUP BY 1, 2),
i AS (SELECT w.keyword, arg_max(t.kw, row(length(t.form), -t.o)) AS kw FROM w JOIN t ON contains(w.whole, t.form) WHERE length(t.form) > 1 GROUP BY 1)"""


@book.add(f"""WITH {RULES} SELECT w.keyword, coalesce(e.kw, c.name, i.kw, trim(w.keyword)) AS canonical_keyword, CASE WHEN e.kw IS NOT NULL THEN '科技類' WHEN c.k IS NOT NULL THEN CASE WHEN c.k % 2 = 0 THEN '科技類' ELSE '其他' END WHEN i.kw IS NOT NULL THEN '科技類' ELSE '其他' END AS theme_name, CASE WHEN e.kw IS NOT NULL THEN '零件' WHEN c.k IS NOT NULL THEN '公司與股票' WHEN i.kw IS NOT NULL THEN '零件' ELSE '未分類' END AS sub_theme,
CASE WHEN e.kw IS NOT NULL THEN 'industry' WHEN c.k IS NOT NULL THEN 'company' WHEN i.kw IS NOT NULL THEN 'industry' ELSE 'none' END AS link_type, CASE WHEN e.kw IS NOT NULL THEN 1.0 WHEN c.k IS NOT NULL THEN 0.7 WHEN i.kw IS NOT NULL THEN 0.5 ELSE 0.0 END AS confidence_score,
CASE WHEN e.kw IS NOT NULL THEN 'theme_mapping' WHEN c.k IS NOT NULL OR i.kw IS NOT NULL THEN 'mapping_normalizer' ELSE 'fallback' END AS classification_source, CASE WHEN e.kw IS NULL AND c.k IS NOT NULL THEN CAST(c.k + 1000 AS VARCHAR) ELSE '' END AS stocks FROM w LEFT JOIN e USING (keyword) LEFT JOIN c USING (keyword) LEFT JOIN i USING (keyword)""")
def j10_rule_classify(s: SparkSession, d: str) -> DataFrame:
    """The whole cascade; every second company is of the technology theme."""
    p, sup, k = ad.table(s, d, "part"), ad.table(s, d, "supplier"), F.col("s_suppkey")
    themes = p.groupBy(F.col("p_brand").alias("keyword")).agg(F.min("p_partkey").alias("ordinal"), F.first(F.lit("科技類")).alias("theme_name"), F.first(F.lit("零件")).alias("sub_theme"), F.first(F.lit("1001")).alias("stock_id"))
    text = k.cast("string")
    names = F.array(F.col("s_name"), F.concat(F.lit("公司"), text, F.lit("長名")), F.concat(F.lit("公司"), text), F.concat(F.lit("S"), text))
    companies = sup.select(k, F.posexplode(names).alias("o", "keyword")).where("o = 0 or s_suppkey % 4 > 4 - o - 1").select((k * 10 + F.col("o")).alias("ordinal"), "keyword", F.lit("company").alias("type"), ad.stock_code(k).alias("stock_id"))
    words = sup.select(F.upper("s_name").alias("keyword")).union(p.select("p_brand")).union(p.select(F.concat(F.lit("best "), "p_brand", F.lit(" parts")))).union(p.select(F.concat(F.lit("offer "), "p_name"))).union(s.range(1).select(F.lit("!!!")))
    out = rs.rule_classify(words, themes, companies, sup.where("s_suppkey % 2 = 0").select(ad.stock_code(k).alias("stock_id")))
    return out.withColumn("stocks", F.array_join("stock_ids", ",")).drop("stock_ids")


@book.add(f"""WITH t AS (SELECT p_brand AS kw, {FORM.format(x='p_brand')} AS form, min(p_partkey) AS o FROM part GROUP BY 1, 2), w AS (SELECT DISTINCT x AS keyword, {FORM.format(x='x')} AS whole FROM (SELECT 'best ' || p_brand || ' parts' AS x FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'offer ' || p_name FROM part)),
e AS (SELECT w.keyword, t.kw FROM w JOIN t ON t.form = w.whole), i AS (SELECT w.keyword, arg_max(t.kw, row(length(t.form), -t.o)) AS kw FROM w JOIN t ON contains(w.whole, t.form) GROUP BY 1)
SELECT w.keyword, coalesce(e.kw, i.kw, w.keyword) AS canonical_keyword, CASE WHEN e.kw IS NOT NULL THEN 'theme_mapping' WHEN i.kw IS NOT NULL THEN 'mapping_normalizer' ELSE 'fallback' END AS classification_source, CASE WHEN i.kw IS NOT NULL THEN 'industry' ELSE 'none' END AS link_type FROM w LEFT JOIN e USING (keyword) LEFT JOIN i USING (keyword)""")
def j10_theme_words(s: SparkSession, d: str) -> DataFrame:
    """J10 without a company dictionary: exact theme words, the longest theme word inside, fallback."""
    p = ad.table(s, d, "part")
    themes = p.groupBy(F.col("p_brand").alias("keyword")).agg(F.min("p_partkey").alias("ordinal"), F.first(F.lit("科技類")).alias("theme_name"), F.first(F.lit("零件")).alias("sub_theme"), F.first(F.lit("1001")).alias("stock_id"))
    words = p.select(F.concat(F.lit("best "), "p_brand", F.lit(" parts")).alias("keyword")).union(p.select("p_brand")).union(p.select(F.concat(F.lit("offer "), "p_name")))
    return rs.rule_classify(words, themes, dictionary(s, d).where("type = 'none'"), s.createDataFrame([], "stock_id string")).select("keyword", "canonical_keyword", "classification_source", "link_type")


@book.add("""SELECT c_name AS keyword, CASE WHEN c_custkey % 3 = 0 THEN '科技類' ELSE '其他' END AS theme_name, CASE WHEN c_custkey % 5 = 0 THEN 'company' WHEN c_custkey % 3 = 0 THEN 'industry' ELSE 'none' END AS link_type, CAST(c_custkey % 5 = 0 OR c_custkey % 3 = 0 AS INTEGER) AS stock_related FROM customer""")
def j11_validate(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    p = ad.table(s, d, "customer").select(F.col("c_name").alias("keyword"), F.col("c_name").alias("canonical_keyword"), F.when(k % 3 == 0, " 科技 類").otherwise("unknown").alias("theme_name"), F.lit(" Industry ").alias("link_type"), F.when(k % 5 == 0, F.array(F.lit("1001"))).alias("stock_ids"), F.lit("0.5").alias("confidence_score"))
    return up.classification_rows(p, ["科技類"]).select("keyword", "theme_name", "link_type", "stock_related")


@book.add(ad.sql("links", """b AS (SELECT DISTINCT theme_name, stock_id FROM links WHERE link_type = 'theme'), tn AS (SELECT DISTINCT keyword, theme_name FROM links WHERE link_type = 'theme'), c AS (SELECT c_custkey AS k, c_name AS keyword, theme_name FROM customer JOIN tn ON keyword = c_name)
SELECT keyword, theme_name, CAST((k + 1000) AS VARCHAR) AS stock_id, 'direct' AS link_type FROM c WHERE k % 3 = 0 UNION ALL SELECT c.keyword, c.theme_name, b.stock_id, 'theme' FROM c JOIN b USING (theme_name) WHERE k % 3 = 1 UNION ALL SELECT keyword, theme_name, NULL, NULL FROM c WHERE k % 3 = 2"""))
def j12_generate_links(s: SparkSession, d: str) -> DataFrame:
    """J12, J13."""
    k = F.col("c_custkey")
    themes = ad.links(s, d).where("link_type = 'theme'")
    c = ad.table(s, d, "customer").select(k.alias("k"), F.col("c_name").alias("keyword"), F.element_at(F.array(F.lit("company"), F.lit("industry"), F.lit("none")), (k % 3 + 1).cast("int")).alias("link_type"))
    c = c.join(themes.select("keyword", "theme_name").distinct(), "keyword")
    own = c.select("keyword", F.array((F.col("k") + 1000).cast("string")).alias("stock_ids"))
    return rs.generate_links(c.drop("k"), own, rs.basket(themes.select("theme_name", "stock_id", "active", F.col("stock_id").cast("long").alias("ordinal")))).drop("active")


@book.add(f"WITH {CLASS} SELECT coalesce(c.canonical_keyword, c.keyword) AS keyword, '其他' AS theme_name, '1' AS stock_id, CASE WHEN c.source = 'fallback' AND c_custkey % 2 = 0 THEN 0 ELSE 1 END AS active FROM cl c JOIN customer ON c_name = c.keyword")
def j12_retire_fallbacks(s: SparkSession, d: str) -> DataFrame:
    """Links of fallback classes go off once their keyword has a class."""
    c = classes(s, d)
    links = c.select(F.coalesce("canonical_keyword", "keyword").alias("keyword"), F.lit("其他").alias("theme_name"), F.lit("1").alias("stock_id"), F.lit(1).alias("active"))
    now = ad.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("keyword"))
    return rs.retire_fallbacks(links, c, now)


@book.add(ad.sql("links", "t AS (SELECT theme_name, list_sort(list(DISTINCT keyword)) AS k, list_sort(list(DISTINCT stock_id)) AS s FROM links WHERE link_type = 'theme' GROUP BY 1) SELECT theme_name, len(list_distinct(list_concat(k, ['legacy']))) AS keywords, array_to_string(list_sort(list_distinct(list_concat(s, ['9999']))), ',') AS stock_ids FROM t"))
def j14_definitions(s: SparkSession, d: str) -> DataFrame:
    themes = ad.links(s, d).where("link_type = 'theme'")
    legacy = themes.select("theme_name").distinct().select("theme_name", F.array(F.lit("legacy")).alias("keywords"), F.array(F.lit("9999")).alias("stock_ids"))
    return rs.definitions(themes, legacy).select("theme_name", F.size("keywords").alias("keywords"), F.array_join("stock_ids", ",").alias("stock_ids"))


@book.add(ad.sql("bursts news", f"{CLASS} SELECT n.news_id, t.keyword, coalesce(theme_name, '其他') AS theme_name, coalesce(news_sentiment, 'Neutral') AS sentiment, greatest(0, least(1, coalesce(confidence_score, 0))) AS confidence FROM news n JOIN bursts t USING (burst_id) LEFT JOIN cl USING (keyword) WHERE n.news_id % 4 <> 0"))
def j16_news_rolldown(s: SparkSession, d: str) -> DataFrame:
    n = ad.news(s, d)
    return rs.news_rolldown(n, ad.bursts(s, d), classes(s, d), n.where("news_id % 4 = 0"))


@book.add(ad.sql("bursts", f"{CLASS}, o AS (SELECT t.burst_id, t.keyword, coalesce(c.canonical_keyword, t.keyword) AS canonical FROM bursts t LEFT JOIN cl c USING (keyword)), nm AS (SELECT DISTINCT c_name AS k FROM customer WHERE c_custkey % 2 = 0 UNION SELECT upper(c_name) FROM customer WHERE c_custkey % 4 = 1) SELECT burst_id, keyword, canonical, CASE WHEN canonical IN (SELECT k FROM nm) THEN canonical ELSE keyword END AS matched FROM o WHERE canonical IN (SELECT k FROM nm) OR keyword IN (SELECT k FROM nm)"))
def j17_match_canonical(s: SparkSession, d: str) -> DataFrame:
    """J2, J17, J22."""
    t = ad.bursts(s, d).select("burst_id", "keyword")
    c = rs.canonical(t, classes(s, d)).withColumnRenamed("keyword", "canonical")
    c0 = ad.table(s, d, "customer")
    names = c0.where("c_custkey % 2 = 0").select(F.col("c_name").alias("keyword")).union(c0.where("c_custkey % 4 = 1").select(F.upper("c_name"))).distinct()
    return rs.match_canonical(t.join(c, "burst_id"), names).select("burst_id", "keyword", "canonical", "matched")


WORDS = "pw AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), al AS (SELECT w AS alias, 'W' || w AS stock_id FROM pw UNION ALL SELECT CAST(s_suppkey + 1000 AS VARCHAR), CAST(s_suppkey + 1000 AS VARCHAR) FROM supplier)"


@book.add(f"""WITH {WORDS}, pt AS (SELECT '(' || string_agg(w, '|' ORDER BY length(w) DESC, w) || ')' AS p FROM pw), f AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, p, 1)) AS alias FROM documents, pt WHERE text IS NOT NULL UNION SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT id, stock_id FROM f JOIN al USING (alias)""")
def j18_mentions(s: SparkSession, d: str) -> DataFrame:
    """The words of part names, and stock codes between non-digits."""
    words = ad.table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("alias")).distinct().withColumn("stock_id", F.concat(F.lit("W"), "alias"))
    code = ad.stock_code(F.col("s_suppkey"))
    aliases = words.union(ad.table(s, d, "supplier").select(code.alias("alias"), code.alias("stock_id")))
    return rs.mentions(ad.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), aliases)


@book.add("SELECT event_type, count(*) AS mentions, " + ", ".join(f"avg(CASE WHEN s = '{k}' THEN 1.0 ELSE 0.0 END) AS {k}_share" for k in ("pre", "in", "after", "weekend")) + " FROM (SELECT event_type, CASE WHEN isodow(ts) > 5 THEN 'weekend' WHEN hour(ts) * 60 + minute(ts) < 540 THEN 'pre' WHEN hour(ts) * 60 + minute(ts) < 810 THEN 'in' ELSE 'after' END AS s FROM events) GROUP BY 1")
def g31_session_shares(s: SparkSession, d: str) -> DataFrame:
    return ev.session_shares(ad.table(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("when")), ["event_type"])


@book.add("SELECT CAST(user_id % 200 AS VARCHAR) AS stock_id, count(*) AS mentions FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def g31_most_mentioned(s: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return ev.most_mentioned(ad.table(s, d, "events").select((F.col("user_id") % 200).cast("string").alias("stock_id")))


@book.add(ad.sql("heat", "SELECT keyword, theme_name, date, trend_score FROM (SELECT keyword, theme_name, date, burst_score AS trend_score FROM heat) WHERE CAST(keyword AS BIGINT) % 3 = 0 AND date >= DATE '2024-01-10'").replace("trend_score", "burst_score"))
def s23_filtered_heat(s: SparkSession, d: str) -> DataFrame:
    wanted = ad.table(s, d, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("keyword")).distinct()
    return fd.heat_of(ad.heat(s, d), wanted, F.lit("2024-02-09").cast("date"))


@book.add(ad.sql("bursts news", f"{CLASS} SELECT t.burst_id, t.keyword, n.news_id, cl.canonical_keyword, cl.theme_name AS classification_theme FROM bursts t LEFT JOIN news n USING (burst_id) LEFT JOIN cl ON cl.keyword = t.keyword WHERE t.published_at >= TIMESTAMP '1997-06-30 16:00:00'"))
def s23_observations(s: SparkSession, d: str) -> DataFrame:
    """Bursts since a Taipei midnight with their news and class."""
    out = fd.observations(ad.bursts(s, d).withColumn("fetched_at", F.col("published_at")), ad.news(s, d), classes(s, d), F.lit("1997-07-01").cast("date"))
    return out.select("burst_id", "keyword", "news_id", "canonical_keyword", "classification_theme")


@book.add(ad.sql("links", "SELECT keyword, stock_id, theme_name FROM links WHERE link_type = 'direct' AND keyword NOT LIKE '%3'"))
def s23_active_links(s: SparkSession, d: str) -> DataFrame:
    l = ad.links(s, d).where("link_type = 'direct'").withColumn("active", (~F.col("keyword").like("%3")).cast("int"))
    return fd.active_links(l).select("keyword", "stock_id", "theme_name")


#: Untyped links, a curated list of other themes for some keywords, entities with retired aliases, and classes.
TYPING = f"""{CLASS}, ln AS (SELECT keyword || '/' || coalesce(stock_id, '') || '/' || theme_name AS id, theme_name, keyword, CASE WHEN keyword NOT LIKE '%5' THEN stock_id END AS stock_id, CASE WHEN keyword LIKE '%7' THEN 0 ELSE 1 END AS active, link_type AS was FROM links),
cu AS (SELECT DISTINCT CASE WHEN keyword LIKE '%4' THEN 'another' ELSE theme_name END AS theme_name, keyword, stock_id FROM links WHERE link_type = 'theme' AND keyword NOT LIKE '%2' AND keyword NOT LIKE '%8'), en AS (SELECT DISTINCT keyword, stock_id FROM links WHERE link_type = 'direct' AND keyword NOT LIKE '%8'),
ac AS (SELECT ln.id, ln.keyword, CASE WHEN cu.keyword IS NOT NULL THEN 'theme' WHEN en.keyword IS NOT NULL AND ln.keyword NOT LIKE '%3' AND ln.keyword NOT LIKE '%4' THEN 'direct' ELSE 'deactivate' END AS action FROM ln LEFT JOIN cu ON cu.theme_name = ln.theme_name AND cu.keyword = ln.keyword AND cu.stock_id = ln.stock_id LEFT JOIN en ON en.keyword = ln.keyword AND en.stock_id = ln.stock_id WHERE ln.active = 1 AND ln.stock_id IS NOT NULL),
lost AS (SELECT keyword FROM ac GROUP BY 1 HAVING bool_and(action = 'deactivate')), rq AS (SELECT DISTINCT keyword FROM cl WHERE keyword IN (SELECT keyword FROM lost) OR canonical_keyword IN (SELECT keyword FROM lost))"""


def _typing(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, and what J19 plans for them: (links, actions, requeue)."""
    l, ends = ad.links(s, d), lambda x: F.col("keyword").like(f"%{x}")
    links = l.select(F.concat("keyword", F.lit("/"), "stock_id", F.lit("/"), "theme_name").alias("id"), "theme_name", "keyword", F.when(~ends(5), F.col("stock_id")).alias("stock_id"), F.lit(None).cast("string").alias("link_type"), F.when(ends(7), 0).otherwise(1).alias("active"))
    curated = l.where((F.col("link_type") == "theme") & ~ends(2) & ~ends(8)).select(F.when(ends(4), "another").otherwise(F.col("theme_name")).alias("theme_name"), "keyword", "stock_id")
    entities = l.where((F.col("link_type") == "direct") & ~ends(8)).select(F.col("keyword").alias("entity_name"), "stock_id")
    retired = ad.table(s, d, "customer").select(F.col("c_name").alias("keyword")).where(ends(3) | ends(4))
    actions, requeue = rs.plan_link_types(links, curated, entities, retired, classes(s, d))
    return links, stage(actions, "actions"), requeue


@book.add(ad.sql("links", f"{TYPING} SELECT ln.id, ln.theme_name, ln.keyword, ln.stock_id, CASE WHEN action <> 'deactivate' THEN action END AS link_type, CASE WHEN action = 'deactivate' THEN 0 ELSE active END AS active FROM ln LEFT JOIN ac USING (id)"))
def j19_type_links(s: SparkSession, d: str) -> DataFrame:
    """The plan applied: curated triples, entities' pairs, and what is switched off; inactive links and those without a stock stay."""
    links, actions, _ = _typing(s, d)
    return rs.apply_link_types(links, actions)


@book.add(ad.sql("links", f"{TYPING} SELECT keyword, CASE WHEN q THEN '其他' ELSE theme_name END AS theme_name, CASE WHEN q THEN 'fallback' ELSE source END AS source, CASE WHEN q THEN 0 ELSE confidence_score END AS confidence_score FROM (SELECT *, keyword IN (SELECT keyword FROM rq) AS q FROM cl)"))
def j19_requeue(s: SparkSession, d: str) -> DataFrame:
    """Classes of keywords that lost all their links become fallbacks."""
    return rs.apply_requeue(classes(s, d), _typing(s, d)[2]).select("keyword", "theme_name", "source", "confidence_score")


@book.add(ad.sql("links", f"""{TYPING} SELECT (SELECT count(*) FROM ac) AS active_stock_rows, (SELECT count(*) FROM ac WHERE action = 'theme') AS theme_rows, (SELECT count(*) FROM ac WHERE action = 'direct') AS direct_rows, (SELECT count(*) FROM ac WHERE action = 'deactivate') AS deactivated_rows, (SELECT count(DISTINCT keyword) FROM ac) AS keywords_linked_before,
(SELECT count(DISTINCT keyword) FROM ac WHERE action <> 'deactivate') AS keywords_linked_after, (SELECT count(*) FROM lost) AS keywords_unlinked, (SELECT count(*) FROM rq) AS classifications_requeued, (SELECT string_agg(keyword, ',' ORDER BY keyword) FROM (SELECT keyword FROM lost ORDER BY 1 LIMIT 20)) AS unlinked_sample, 0 AS failures"""))
def j19_summary(s: SparkSession, d: str) -> DataFrame:
    """The plan's counts, and how many checks fail after it is applied."""
    links, actions, requeue = _typing(s, d)
    failed = rs.verify_link_types(rs.apply_link_types(links, actions), actions).agg(F.count("*").alias("failures"))
    return rs.link_type_summary(actions, requeue).withColumn("unlinked_sample", F.array_join("unlinked_sample", ",")).crossJoin(failed)


@book.add("""WITH a AS (SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS stock_id, CAST(ts AS DATE) AS event FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS stock_id, CAST(ts AS DATE) AS other FROM events WHERE event_type = 'purchase'),
p AS (SELECT a.stock_id, event, other - event AS lag, row_number() OVER (PARTITION BY a.stock_id, event ORDER BY abs(other - event), other) AS k FROM a JOIN b ON a.stock_id = b.stock_id AND abs(other - event) <= 7) SELECT stock_id, event, lag FROM p WHERE k = 1""")
def j20_nearest_pairs(s: SparkSession, d: str) -> DataFrame:
    e = ad.table(s, d, "events").select((F.col("user_id") % 40).cast("string").alias("stock_id"), F.to_date("ts").alias("date"), "event_type")
    return rs.nearest_pairs(e.where("event_type = 'signup'").drop("event_type").distinct(), e.where("event_type = 'purchase'").drop("event_type").distinct())


@book.add("""WITH a AS (SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS stock_id, CAST(ts AS DATE) AS event FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS stock_id, CAST(ts AS DATE) AS other FROM events WHERE event_type = 'purchase'),
p AS (SELECT other - event AS lag, row_number() OVER (PARTITION BY a.stock_id, event ORDER BY abs(other - event), other) AS k FROM a JOIN b ON a.stock_id = b.stock_id AND abs(other - event) <= 7)
SELECT count(*) AS pairs, round(avg(CAST(lag < 0 AS INTEGER)), 6) AS earlier, round(avg(CAST(lag = 0 AS INTEGER)), 6) AS same_day, round(avg(CAST(lag > 0 AS INTEGER)), 6) AS later, median(lag) AS median_lag FROM p WHERE k = 1""")
def j20_lead_lag(s: SparkSession, d: str) -> DataFrame:
    """Shares of leading and lagging signals and the median lag."""
    out = rs.lead_lag(j20_nearest_pairs(s, d))
    return out.select("pairs", *[F.round(c, 6).alias(c) for c in ("earlier", "same_day", "later")], "median_lag")


@book.add(ad.sql("listed prices", "e AS (SELECT keyword, CAST(CAST(keyword AS BIGINT) % (SELECT count(*) FROM supplier) + 1000 AS VARCHAR) AS stock_id, date - 9862 AS date FROM listed) SELECT e.keyword, e.stock_id, e.date, p.date AS day0 FROM e ASOF LEFT JOIN prices p ON e.stock_id = p.stock_id AND e.date <= p.date"))
def j21_align(s: SparkSession, d: str) -> DataFrame:
    from heedstream.operators.returns import align

    n = ad.table(s, d, "supplier").agg(F.count("*").alias("n"))
    e = ad.listed(s, d).crossJoin(F.broadcast(n)).select("keyword", ad.stock_code(F.col("keyword").cast("long") % F.col("n")).alias("stock_id"), F.date_sub("date", 9862).alias("date"))
    return align(e, ad.prices(s, d).select("stock_id", "date")).select("keyword", "stock_id", "date", F.col("day0.date").alias("day0"))


@book.add(ad.sql("links", "d AS (SELECT stock_id, arg_min(keyword, row(length(keyword), keyword)) AS short FROM links WHERE link_type = 'direct' GROUP BY 1), o AS (SELECT CAST(s_suppkey + 1000 AS VARCHAR) AS stock_id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) SELECT stock_id, coalesce(name, short) AS name FROM d FULL JOIN o USING (stock_id)"))
def j23_display_names(s: SparkSession, d: str) -> DataFrame:
    official = ad.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(ad.stock_code(F.col("s_suppkey")).alias("stock_id"), F.col("s_name").alias("name"))
    return rs.display_names(ad.links(s, d), official)


# ---- repair ----

#: Bursts that were polled again and again; some have no keyword, a blank one or no time.
DUP = "tr AS (SELECT event_id AS burst_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN ' ' ELSE CAST(user_id % 100 AS VARCHAR) END AS keyword, CASE WHEN event_id % 17 <> 0 THEN CAST(ts AS DATE) END AS published_at, ts AS fetched_at, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS approx_traffic FROM events), tk AS (SELECT *, trim(coalesce(keyword, '')) <> '' AND published_at IS NOT NULL AS keyed FROM tr)"


def repeated(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    keyword = F.when(k % 13 == 1, " ").when(k % 13 != 0, (F.col("user_id") % 100).cast("string"))
    return ad.table(s, d, "events").select(k.alias("burst_id"), keyword.alias("keyword"), F.when(k % 17 != 0, F.to_date("ts")).alias("published_at"), F.col("ts").alias("fetched_at"), F.floor("value").cast("string").alias("approx_traffic"))


@book.add(f"WITH {DUP} SELECT keyword, published_at, min(burst_id) AS burst_id, arg_max(approx_traffic, burst_id) AS approx_traffic, count(*) AS rows, min(fetched_at) = arg_min(fetched_at, burst_id) AS earliest FROM tk WHERE keyed GROUP BY 1, 2 UNION ALL SELECT keyword, published_at, burst_id, approx_traffic, 1, true FROM tk WHERE NOT keyed")
def d1_dedupe_bursts(s: SparkSession, d: str) -> DataFrame:
    return rp.dedupe_bursts(repeated(s, d)).drop("fetched_at")


NEWS_DUP = f"""{DUP}, sv AS (SELECT burst_id, CASE WHEN keyed THEN min(burst_id) OVER (PARTITION BY keyed, keyword, published_at) ELSE burst_id END AS survivor FROM tk),
nw AS (SELECT event_id AS news_id, event_id AS burst_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE event_type END AS news_url, CASE WHEN event_id % 4 = 0 THEN 'Positive' WHEN event_id % 4 = 1 AND user_id % 2 = 0 THEN 'Negative' END AS news_sentiment, event_id % 10 / 10.0::DOUBLE AS sentiment_score, CASE WHEN event_id % 3 > 0 THEN 'type' || CAST(event_id % 3 AS VARCHAR) END AS event_type FROM events),
mv AS (SELECT nw.* EXCLUDE (burst_id), survivor AS burst_id, coalesce(news_url, '') <> '' AS linked FROM nw JOIN sv USING (burst_id)),
rk AS (SELECT *, CASE WHEN linked THEN row_number() OVER g ELSE 1 END AS k, CASE WHEN linked THEN count(*) OVER p ELSE 1 END AS rows, linked AND coalesce(max(news_sentiment) OVER p <> min(news_sentiment) OVER p, false) AS conflict, CASE WHEN linked THEN min(CASE WHEN news_sentiment IS NOT NULL THEN news_id END) OVER p END AS donor FROM mv WINDOW g AS (PARTITION BY linked, burst_id, news_url ORDER BY news_id), p AS (PARTITION BY linked, burst_id, news_url)),
dd AS (SELECT a.news_id, a.burst_id, a.news_url, CASE WHEN take THEN b.news_sentiment ELSE a.news_sentiment END AS news_sentiment, CASE WHEN take THEN b.sentiment_score ELSE a.sentiment_score END AS sentiment_score, CASE WHEN take THEN b.event_type ELSE a.event_type END AS event_type, rows, conflict
  FROM (SELECT *, news_sentiment IS NULL AND NOT conflict AND donor IS NOT NULL AS take FROM rk WHERE k = 1) a LEFT JOIN nw b ON b.news_id = a.donor)"""


def repeated_news(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    url = F.when(k % 7 == 1, "").when(k % 7 != 0, F.col("event_type"))
    tone = F.when(k % 4 == 0, "Positive").when((k % 4 == 1) & (F.col("user_id") % 2 == 0), "Negative")
    return ad.table(s, d, "events").select(k.alias("news_id"), k.alias("burst_id"), url.alias("news_url"), tone.alias("news_sentiment"), ((k % 10).cast("double") / 10).alias("sentiment_score"), F.when(k % 3 > 0, F.concat(F.lit("type"), (k % 3).cast("string"))).alias("event_type"))


@book.add(f"WITH {NEWS_DUP} SELECT * FROM dd")
def d2_dedupe_news(s: SparkSession, d: str) -> DataFrame:
    """Survivors with their own score and type, or all three values of the first row that has a sentiment."""
    return rp.dedupe_news(repeated_news(s, d), rp.survivor_map(repeated(s, d)))


@book.add(f"""WITH {NEWS_DUP} SELECT 'bursts' AS "table", burst_id AS id, 'no key' AS reason FROM tk WHERE NOT keyed UNION ALL SELECT 'news', news_id, 'no url' FROM mv WHERE NOT linked UNION ALL SELECT 'news', news_id, 'sentiments differ' FROM dd WHERE conflict
UNION ALL SELECT 'bursts', min(burst_id), 'survivor not fetched first' FROM tk WHERE keyed GROUP BY keyword, published_at HAVING min(fetched_at) <> arg_min(fetched_at, burst_id)""")
def d2_quarantine(s: SparkSession, d: str) -> DataFrame:
    """Rows that must not be grouped and groups that a repair must not settle."""
    return rp.quarantine(repeated(s, d), repeated_news(s, d))


@book.add(f"WITH {NEWS_DUP} SELECT 'bursts_before' AS \"check\", count(*) AS value FROM tr UNION ALL SELECT 'bursts_after', count(DISTINCT survivor) FROM sv UNION ALL SELECT 'news_before', count(*) FROM nw UNION ALL SELECT 'news_after', count(*) FROM dd UNION ALL SELECT 'repeating_keys', 0 UNION ALL SELECT 'orphans', 0")
def d3_dedupe_report(s: SparkSession, d: str) -> DataFrame:
    t, n = repeated(s, d), repeated_news(s, d)
    return rp.dedupe_report(t, rp.dedupe_bursts(t), n, rp.dedupe_news(n, rp.survivor_map(t)))


#: Texts of two eras: local ones of 26 characters, UTC ones of 19, and some that are neither; published five hours before in Tokyo's time.
ERAS = """er AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'local' ELSE 'utc' END AS era, date_trunc('second', ts) AS ft FROM events), rp AS (SELECT *, CASE WHEN era IS NOT NULL THEN ft END AS fetched_utc, CASE WHEN era IS NOT NULL THEN ft - to_hours(CAST(5 + event_id % 3 AS INTEGER)) END AS published_utc,
  CASE era WHEN 'local' THEN 8 WHEN 'utc' THEN 0 END AS fs, CASE WHEN era IS NOT NULL THEN 5 + event_id % 3 END AS lag FROM er)"""


def eras(s: SparkSession, d: str) -> DataFrame:
    t, k = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id")
    text = lambda x, long: F.concat(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), F.when(long, ".000000").otherwise(""))
    published = F.from_utc_timestamp(t - F.make_interval(hours=(5 + k % 3).cast("int")), "Asia/Tokyo")
    fetched = F.when(k % 5 == 0, "2024-01-01").when(k % 2 == 0, text(F.from_utc_timestamp(t, "Asia/Taipei"), F.lit(True))).otherwise(text(t, F.lit(False)))
    return ad.table(s, d, "events").select("event_id", k.alias("burst_id"), fetched.alias("fetched_at"), text(published, k % 2 == 0).alias("published_at"))


@book.add(f"WITH {ERAS} SELECT event_id, era, fetched_utc, published_utc, CASE WHEN era IS NULL THEN 'layout' END AS problem, 3600 * lag AS lag_seconds, 3600 * (lag + fs - 9) AS lag_before FROM rp")
def d4_repair_times(s: SparkSession, d: str) -> DataFrame:
    """Published times are the feed's in both eras."""
    out = rp.repair_times(eras(s, d), "Asia/Taipei", "Asia/Tokyo")
    good = lambda c: F.when(F.col("problem").isNull(), F.col(c)).cast(NTZ).alias(c)
    return out.select("event_id", "era", good("fetched_utc"), good("published_utc"), "problem", "lag_seconds", "lag_before")


LAG_ROWS = "r AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY v) AS k, count(*) OVER (PARTITION BY era) AS n FROM x) SELECT era, count(*) AS rows, min(v) AS least, max(v) AS most, floor(avg(v) * 1e6 + 0.5) / 1e6 AS mean, max(v) FILTER (k = n // 2 + 1) AS median FROM r GROUP BY 1"


@book.add(f"WITH {ERAS}, x AS (SELECT era, 3600 * lag AS v FROM rp WHERE era IS NOT NULL), {LAG_ROWS}")
def d4_lag_stats(s: SparkSession, d: str) -> DataFrame:
    return rounded(rp.lag_stats(rp.repair_times(eras(s, d), "Asia/Taipei", "Asia/Tokyo")), "mean")


@book.add(f"WITH {ERAS}, x AS (SELECT era, 3600 * (lag + fs - 9) AS v FROM rp WHERE era IS NOT NULL), {LAG_ROWS}")
def d4_lags_before(s: SparkSession, d: str) -> DataFrame:
    return rounded(rp.lag_stats(rp.repair_times(eras(s, d), "Asia/Taipei", "Asia/Tokyo"), "lag_before"), "mean")


@book.add(f"""WITH {ERAS} SELECT '-9h' AS "offset", count(*) AS rows FROM rp WHERE era IS NOT NULL""")
def d4_offsets(s: SparkSession, d: str) -> DataFrame:
    return rp.offset_counts(rp.repair_times(eras(s, d), "Asia/Taipei", "Asia/Tokyo"))


@book.add("""WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CASE WHEN event_id % 2 = 0 THEN 26 ELSE 19 END END AS p, CASE WHEN event_id % 5 = 0 THEN 10 WHEN event_id % 2 = 0 THEN 26 ELSE 19 END AS f, CASE WHEN event_id % 7 = 0 THEN 26 WHEN event_id % 5 = 0 THEN 10 WHEN event_id % 2 = 0 THEN 26 ELSE 19 END AS n FROM events)
SELECT 'null times' AS "check", count(*) FILTER (p IS NULL) AS rows FROM x UNION ALL SELECT 'unknown layout', count(*) FILTER (p IS NOT NULL AND f = 10) FROM x UNION ALL SELECT 'layouts differ', count(*) FILTER (p <> f) FROM x UNION ALL SELECT 'unknown news layout', count(*) FILTER (n = 10) FROM x UNION ALL SELECT 'news of another era', count(*) FILTER (n <> f) FROM x UNION ALL SELECT 'fractions of seconds', count(*) FILTER (event_id % 7 = 0) FROM x""")
def d5_preconditions(s: SparkSession, d: str) -> DataFrame:
    k, e = F.col("event_id"), eras(s, d)
    bursts = e.withColumn("published_at", F.when(k % 11 != 0, F.col("published_at")))
    news = e.select("burst_id", F.when(k % 7 == 0, "2024-01-01 00:00:00.500000").otherwise(F.col("fetched_at")).alias("fetched_at"))
    return rp.precondition_counts(bursts, news)


@book.add(f"""WITH {ERAS} SELECT 'rows changed' AS "check", 0 AS rows UNION ALL SELECT 'not repaired', count(*) FILTER (era IS NULL) FROM rp UNION ALL SELECT 'negative lags', count(*) FILTER (lag - 16 - 9 < 0 AND era IS NOT NULL) FROM rp""")
def d5_verify(s: SparkSession, d: str) -> DataFrame:
    """A repair under the wrong zone for publishing shows in its lags."""
    rows = eras(s, d)
    return rp.verify_times(rows, rp.repair_times(rows, "Asia/Taipei", "America/Los_Angeles"))


# ---- logs ----

def log_lines(s: SparkSession, d: str) -> DataFrame:
    """Orders as runs of five jobs: a start, a stats block, an error in every seventh and an exit of most."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    job = F.concat(F.lit("job"), (k % 5).cast("string"))
    lines = F.array(
        F.concat(F.lit("["), day, F.lit("  8:00:00.12] "), job, F.lit(" start")), F.lit("Gemini Stats"), F.concat(F.lit("Requests: "), (k % 9).cast("string")), F.concat(F.lit("Processed: "), (k % 4).cast("string"), F.lit(" items")),
        F.when(k % 7 == 0, F.concat(F.lit("ERROR code "), (k % 21).cast("string"))).otherwise("fine"), F.concat(F.lit("Theme ETL completed: {'rows': "), (k % 13).cast("string"), F.lit(", 'themes': 3}")),
        F.when(k % 3 != 0, F.concat(F.lit("["), day, F.lit("  9:00:00.00] "), job, F.lit(" exit "), (k % 2).cast("string"))))
    each = ad.table(s, d, "orders").select(job.alias("job"), k.alias("k"), F.posexplode(lines).alias("p", "value")).where("value is not null")
    return each.select("job", (F.col("k") * 10 + F.col("p")).alias("line"), "value")


RUNS = "rn AS (SELECT 'job' || CAST(o_orderkey % 5 AS VARCHAR) AS job, o_orderkey AS k, o_orderdate + INTERVAL 8 HOUR AS started_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 END AS exit_code, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS run FROM orders)"


@book.add(f"WITH {RUNS} SELECT job, run, started_at, exit_code, 5 AS lines FROM rn")
def l1_runs(s: SparkSession, d: str) -> DataFrame:
    return lg.runs(log_lines(s, d)).withColumn("started_at", F.col("started_at").cast(NTZ))


@book.add(f"WITH {RUNS} SELECT job, run, 'gemini' AS block, 'Requests' AS key, CAST(k % 9 AS VARCHAR) AS value, CAST(k % 9 AS DOUBLE) AS number FROM rn UNION ALL SELECT job, run, 'gemini', 'Processed', CAST(k % 4 AS VARCHAR) || ' items', CAST(k % 4 AS DOUBLE) FROM rn")
def l2_blocks(s: SparkSession, d: str) -> DataFrame:
    out = lg.blocks(log_lines(s, d))
    return out.withColumn("number", lg.leading_number(F.col("value")))


@book.add(f"WITH {RUNS} SELECT job, run, CAST(k % 13 AS VARCHAR) AS rows, '3' AS themes FROM rn")
def l2_results(s: SparkSession, d: str) -> DataFrame:
    return lg.result_values(log_lines(s, d), "Theme ETL completed: ").select("job", "run", F.col("result")["rows"].alias("rows"), F.col("result")["themes"].alias("themes"))


@book.add("WITH x AS (SELECT 'job' || CAST(o_orderkey % 5 AS VARCHAR) AS job, min(o_orderkey * 10 + 4) AS line, 'ERROR code ' || CAST(o_orderkey % 21 AS VARCHAR) AS text FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1, 3), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY line DESC) AS k FROM x) SELECT job, line, text FROM r WHERE k <= 5")
def l3_last_errors(s: SparkSession, d: str) -> DataFrame:
    return lg.last_errors(log_lines(s, d))


@book.add("SELECT event_type AS job, count(*) FILTER (event_id % 6 IN (0, 1)) AS warnings, count(*) FILTER (event_id % 6 > 1) AS runs, coalesce(sum(CASE WHEN event_id % 6 > 1 THEN event_id % 4 END), 0) AS failed_items FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 240 HOUR GROUP BY 1")
def l3_recent_counts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(k % 6 == 0, " ERROR broken").when(k % 6 == 1, " WARNING slow").otherwise(F.concat(F.lit(" INFO RSS collected: new=1 failed="), (k % 4).cast("string"))))
    rows = ad.table(s, d, "events").select(F.col("event_type").alias("job"), k.alias("line"), text.alias("value"))
    return lg.recent_counts(rows, F.expr("timestamp '2024-01-20 00:00:00'"), 240)


CUT = "am AS (SELECT CAST(ts AS DATE) AS dy, count(*) FILTER (event_type = 'purchase') AS items, count(*) FILTER (event_type <> 'view') AS requests, count(*) FILTER (event_type = 'error') AS unavailable, count(DISTINCT user_id) AS backlog FROM events GROUP BY 1), sm AS (SELECT CASE WHEN dy < DATE '2024-01-15' THEN 'before' ELSE 'after' END AS period, count(*) AS runs, sum(items) / sum(requests) AS ipr, sum(unavailable) / sum(requests) AS us, avg(CASE WHEN items = 0 THEN 1.0 ELSE 0.0 END) AS es, (arg_max(backlog, dy) - arg_min(backlog, dy)) / nullif(max(dy) - min(dy), 0) AS bpd FROM am GROUP BY 1)"


@book.add(f"WITH {RUNS}, x AS (SELECT job, arg_max(started_at + INTERVAL 1 HOUR, k) AS last_run FROM rn WHERE exit_code IS NOT NULL GROUP BY 1) SELECT job, last_run, date_trunc('day', last_run) + INTERVAL 12 HOUR AS next_run FROM x")
def l6_last_finished(s: SparkSession, d: str) -> DataFrame:
    out = lg.last_finished(log_lines(s, d))
    return out.select("job", F.col("last_run").cast(NTZ).alias("last_run"), lg.next_slot(F.col("last_run"), [0, 6, 12, 18]).cast(NTZ).alias("next_run"))


QUERIES, ORACLES = book.queries, book.oracles
