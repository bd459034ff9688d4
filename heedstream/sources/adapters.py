"""The driver's tables under the schemas that the operators expect.

Each adapter exists twice: as DataFrame code for Spark, and as a common
table expression for the oracles (``SQL``). Prices are picks, not sums, so
that both sides agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heedstream.sources.shared import BROADCAST_ROWS

BENCHMARK = "0050"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floor6(c: Column) -> Column:
    """Six decimals by the floor form, which Spark and the oracles compute alike."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def stock_code(c: Column) -> Column:
    return (c + 1000).cast("string")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, stock_id, open, high, low, close, adj_close, volume), the benchmark's rows included.

    The lines of a stock meet once, by stock, which is also what windows over a
    stock ask for. The benchmark's days are summed first and join the lines before
    they are dealt, as two lines a day with the day's extremes and volume: a union
    after it would deal every stock's days a second time.
    """
    line = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    seq = line[:-1]
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), stock_code(F.col("l_suppkey")).alias("stock_id"), *line)
    unit = lambda at="": F.col(f"{at}l_extendedprice") / F.col(f"{at}l_quantity")
    none = F.lit(None).cast("double")
    days = rows.groupBy("date").agg(F.min(F.struct(*line)).alias("_a"), F.max(F.struct(*line)).alias("_z"), F.max(unit()).alias("high"), F.min(unit()).alias("low"), F.sum("l_quantity").alias("volume"))
    ends = F.array(F.struct(F.col("_a").alias("l"), "high", "low", "volume"), F.struct(F.col("_z").alias("l"), none.alias("high"), none.alias("low"), F.lit(0.0).alias("volume")))
    days = days.select("date", F.lit(BENCHMARK).alias("stock_id"), F.explode(ends).alias("e")).select("date", "stock_id", "e.l.*", "e.high", "e.low", "e.volume")
    both = rows.select("*", none.alias("high"), none.alias("low"), none.alias("volume")).union(days).repartition("stock_id")
    high, low, volume = F.max(F.coalesce("high", unit())), F.min(F.coalesce("low", unit())), F.sum(F.coalesce("volume", "l_quantity"))
    out = both.groupBy("stock_id", "date").agg(F.min(F.struct(*seq)).alias("_a"), F.max(F.struct(*line)).alias("_z"), high.alias("high"), low.alias("low"), volume.cast("long").alias("volume"))
    return out.select("date", "stock_id", unit("_a.").alias("open"), "high", "low", unit("_z.").alias("close"), (unit("_z.") * (1 - F.col("_z.l_discount"))).alias("adj_close"), "volume")


def price_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_id, date) of lines, and the benchmark's on all days, with repeats: for readers of no price."""
    rows = table(spark, sf_dir, "lineitem").select(stock_code(F.col("l_suppkey")).alias("stock_id"), F.to_date("l_shipdate").alias("date"))
    return rows.union(rows.select("date").distinct().select(F.lit(BENCHMARK).alias("stock_id"), "date"))


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(F.col("o_orderkey").alias("burst_id"), F.col("c_name").alias("keyword"), F.col("o_orderdate").alias("published_at"), F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("K+")).alias("approx_traffic"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links of every keyword, and its theme's basket.

    A theme is a part of a market segment; themes are as many as it takes
    that each has about five stocks, so baskets hold all stocks, every keyword
    has one, and links grow with the keywords.
    """
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n")).withColumn("g", F.greatest(F.lit(1).cast("long"), F.expr("n div 25")))
    rows = c.crossJoin(F.broadcast(n))
    direct = rows.select(F.col("c_name").alias("keyword"), stock_code(F.col("c_custkey") % F.col("n")).alias("stock_id"), F.lit("direct").alias("link_type"), F.col("c_mktsegment").alias("theme_name"), F.lit(1).alias("active"))
    segments = c.select("c_mktsegment").distinct().select(F.sort_array(F.collect_list("c_mktsegment")).alias("all"))
    segments = segments.select(F.posexplode("all").alias("k", "c_mktsegment"))
    baskets = s.crossJoin(F.broadcast(n)).select(stock_code(F.col("s_suppkey")).alias("stock_id"), (F.col("s_suppkey") % 5).alias("k"), F.expr("(s_suppkey div 5) % g").alias("j"))
    baskets = baskets.join(F.broadcast(segments), "k")
    theme = rows.select(F.col("c_name").alias("keyword"), "c_mktsegment", (F.col("c_custkey") % F.col("g")).alias("j")).join(baskets, ["c_mktsegment", "j"])
    theme = theme.select("keyword", "stock_id", F.lit("theme").alias("link_type"), F.concat("c_mktsegment", F.lit(" "), F.col("j").cast("string")).alias("theme_name"), F.lit(1).alias("active"))
    return direct.unionByName(theme)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword classes: a fifth of the keywords has none, a quarter of the rest is a fallback, a third has a canonical name."""
    k = F.col("c_custkey")
    other = k % 4 == 0
    return table(spark, sf_dir, "customer").where(k % 5 != 0).select(F.col("c_name").alias("keyword"), F.when(other, "其他").otherwise(F.col("c_mktsegment")).alias("theme_name"), F.when(other, "fallback").otherwise("rule").alias("source"), (k % 7 == 0).cast("int").alias("need_review"), (F.col("c_acctbal") / 10000).alias("confidence_score"), F.when(k % 3 == 0, F.upper("c_name")).alias("canonical_keyword"))


def news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    s = s.select("s_suppkey", "s_name")
    # lines are many times the suppliers: they aren't dealt by them where the suppliers are few
    rows = li.join(p, li.l_partkey == p.p_partkey).join(F.broadcast(s) if s.count() <= BROADCAST_ROWS else s, li.l_suppkey == s.s_suppkey)
    news_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tone = F.when(news_id % 5 == 0, None).when(F.col("l_returnflag") == "A", "Positive").when(F.col("l_returnflag") == "R", "Negative").otherwise("Neutral")
    return rows.select(news_id.alias("news_id"), F.col("l_orderkey").alias("burst_id"), F.col("p_name").alias("news_title"), F.col("s_name").alias("news_source"), tone.alias("news_sentiment"), F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").alias("seq"))


def news(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The first line of each news; of ``columns`` alone, if any are named, as what stands in a picked struct is shuffled whole."""
    own = columns or ("burst_id", "news_title", "news_source", "news_sentiment")
    return news_raw(spark, sf_dir).groupBy("news_id").agg(F.min_by(F.struct(*own), "seq").alias("r")).select("news_id", "r.*")


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Taipei"))
    return table(spark, sf_dir, "events").groupBy(day.alias("date"), F.col("user_id").cast("string").alias("keyword")).agg(F.least(F.lit(100), 20 * F.count("*")).cast("long").alias("burst_score")).withColumn("theme_name", (F.col("keyword").cast("long") % 7).cast("string"))


def heat_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("keyword")).agg(F.count("*").cast("double").alias("heat"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("burst_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.floor("value").cast("long").alias("traffic"), "event_type", "event_id")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("keyword"), F.to_date("ts").alias("date")).distinct()


#: ``classes`` for the oracles.
CLASS = "cl AS (SELECT c_name AS keyword, CASE WHEN c_custkey % 4 = 0 THEN '其他' ELSE c_mktsegment END AS theme_name, CASE WHEN c_custkey % 4 = 0 THEN 'fallback' ELSE 'rule' END AS source, CAST(c_custkey % 7 = 0 AS INTEGER) AS need_review, c_acctbal / 10000 AS confidence_score, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) END AS canonical_keyword FROM customer WHERE c_custkey % 5 <> 0)"

#: The same adapters for the oracles.
SQL = {
    "prices": """base AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey + 1000 AS VARCHAR) AS stock_id, l_extendedprice / l_quantity AS unit, (l_extendedprice / l_quantity) * (1 - l_discount) AS adj,
          l_quantity AS q, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq FROM lineitem),
        prices AS (SELECT date, stock_id, arg_min(unit, seq) AS open, max(unit) AS high, min(unit) AS low, arg_max(unit, seq) AS close, arg_max(adj, seq) AS adj_close, CAST(sum(q) AS BIGINT) AS volume
          FROM (SELECT * FROM base UNION ALL SELECT date, '0050', unit, adj, q, seq FROM base) GROUP BY date, stock_id)""",
    "bursts": "bursts AS (SELECT o_orderkey AS burst_id, c_name AS keyword, o_orderdate AS published_at, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || 'K+' AS approx_traffic FROM orders JOIN customer ON o_custkey = c_custkey)",
    "links": """seg AS (SELECT c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k FROM (SELECT DISTINCT c_mktsegment FROM customer)), lk_n AS (SELECT count(*) AS n, greatest(1, count(*) // 25) AS g FROM supplier),
        lk_b AS (SELECT CAST(s_suppkey + 1000 AS VARCHAR) AS stock_id, segment, (s_suppkey // 5) % g AS j FROM supplier, lk_n, seg WHERE s_suppkey % 5 = k), lk_c AS (SELECT c_name, c_custkey, c_mktsegment AS segment, c_custkey % n AS own, c_custkey % g AS j FROM customer, lk_n),
        links AS (SELECT c_name AS keyword, CAST(own + 1000 AS VARCHAR) AS stock_id, 'direct' AS link_type, segment AS theme_name, 1 AS active FROM lk_c
          UNION ALL SELECT c_name, stock_id, 'theme', c.segment || ' ' || CAST(c.j AS VARCHAR), 1 FROM lk_c c JOIN lk_b b ON c.segment = b.segment AND c.j = b.j)""",
    "news": """news_raw AS (SELECT l_orderkey * 10 + l_linenumber AS news_id, l_orderkey AS burst_id, p_name AS news_title, s_name AS news_source,
          CASE WHEN (l_orderkey * 10 + l_linenumber) % 5 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Positive' WHEN l_returnflag = 'R' THEN 'Negative' ELSE 'Neutral' END AS news_sentiment,
          row(l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
        news AS (SELECT news_id, r.burst_id AS burst_id, r.news_title AS news_title, r.news_source AS news_source, r.news_sentiment AS news_sentiment
          FROM (SELECT news_id, arg_min({'burst_id': burst_id, 'news_title': news_title, 'news_source': news_source, 'news_sentiment': news_sentiment}, seq) AS r FROM news_raw GROUP BY news_id))""",
    "heat": "heat AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, CAST(user_id AS VARCHAR) AS keyword, least(100, 20 * count(*)) AS burst_score, CAST(any_value(user_id) % 7 AS VARCHAR) AS theme_name FROM events GROUP BY 1, 2)",
    "heat_px": "heat_px AS (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS keyword, CAST(count(*) AS DOUBLE) AS heat FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "observations": "observations AS (SELECT user_id AS burst_id, ts AS observed_at, CAST(floor(value) AS BIGINT) AS traffic, event_type, event_id FROM events)",
    "listed": "listed AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS keyword, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'signup')",
}


def sql(adapters: str, body: str) -> str:
    """An oracle: ``body`` continues the WITH list that the named adapters begin."""
    return "WITH " + ",\n".join(SQL[a] for a in adapters.split()) + (",\n" if not body.lstrip().upper().startswith("SELECT") else "\n") + body
