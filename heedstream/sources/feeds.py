"""Sources as tables: feeds, CSV dimensions, exchange lists, boards and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heedstream.functions.exprs import OTHER_THEME, day_start_utc, push_score, theme_form

FEED = "struct<item:array<struct<title:string,approx_traffic:string,pubDate:string,news_item:array<struct<news_item_title:string,news_item_url:string,news_item_source:string>>>>>"


def pub_date(c: Column) -> Column:
    """An RFC 822 date with its zone; the weekday is left out of the parse. Null where it can't be read or has no zone."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(F.regexp_replace(text, "GMT|UTC", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))


def parse_feed(snapshots: DataFrame) -> DataFrame:
    """Snapshots (batch, fetched_at, xml) to one row an item; ``usable`` is false for items without keyword or date."""
    items = snapshots.select("batch", "fetched_at", F.explode(F.from_xml("xml", FEED, {"rowTag": "channel"})["item"]).alias("i"))
    news = F.filter(F.coalesce("i.news_item", F.array().cast("array<struct<news_item_title:string,news_item_url:string,news_item_source:string>>")), lambda n: F.coalesce(F.trim(n["news_item_url"]), F.lit("")) != "")
    out = items.select("batch", "fetched_at", F.trim("i.title").alias("keyword"), pub_date(F.col("i.pubDate")).alias("published_at"), F.coalesce(F.nullif(F.trim("i.approx_traffic"), F.lit("")), F.lit("0+")).alias("approx_traffic"), news.alias("news"))
    return out.withColumn("usable", (F.coalesce("keyword", F.lit("")) != "") & F.col("published_at").isNotNull())


def feed_news(items: DataFrame) -> DataFrame:
    """News rows of usable items."""
    each = items.where("usable").select("batch", "keyword", "published_at", F.posexplode("news").alias("position", "n"))
    return each.select("batch", "keyword", "published_at", "position", F.col("n.news_item_title").alias("news_title"), F.trim("n.news_item_url").alias("news_url"), F.col("n.news_item_source").alias("news_source"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV dimension as texts with a fixed schema and each row's place within its file."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, "string")
    return spark.read.csv(path, header=True, schema=schema).withColumn("ordinal", F.monotonically_increasing_id())


def theme_rows(raw: DataFrame, sub_themes: DataFrame) -> DataFrame:
    """Trimmed theme rows; sub-theme from the dictionary (theme_name, keyword, sub), else other; blank keywords go."""
    t = raw.select(theme_form(F.trim("theme_name")).alias("theme_name"), F.trim("sub_theme").alias("sub_theme"), F.trim("keyword").alias("keyword"), F.coalesce(F.trim("stock_id"), F.lit("")).alias("stock_id"), F.coalesce(F.nullif(F.trim("active"), F.lit("")).try_cast("int"), F.lit(1)).alias("active"), F.nullif(F.trim("category"), F.lit("")).alias("category"))
    t = t.where("coalesce(theme_name, '') <> '' and coalesce(keyword, '') <> ''").join(F.broadcast(sub_themes), ["theme_name", "keyword"], "left")
    return t.select("theme_name", F.coalesce(F.nullif("sub_theme", F.lit("")), "sub", F.lit(OTHER_THEME)).alias("sub_theme"), "keyword", "stock_id", "active", theme_form(F.coalesce("category", "theme_name")).alias("category")).distinct()


def alias_rows(raw: DataFrame) -> DataFrame:
    """Rows with keyword, known type and code."""
    t = raw.select(F.trim("keyword").alias("keyword"), F.lower(F.trim("type")).alias("type"), F.upper(F.trim("stock_id")).alias("stock_id"))
    return t.where("keyword <> '' and stock_id <> '' and type in ('company', 'industry', 'theme')").distinct()


def seed_aliases(raw: DataFrame) -> DataFrame:
    """One row for each alias of an entity, its own name included; the later row wins."""
    names = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    each = raw.select("ordinal", F.trim("entity_name").alias("entity_name"), "stock_id", F.explode(F.array_union(F.array(F.trim("entity_name")), names)).alias("alias"))
    return each.groupBy("alias").agg(F.max_by(F.struct("entity_name", "stock_id"), "ordinal").alias("r")).select("alias", "r.*")


def official_codes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Trimmed codes and names; the first list wins, blank codes go."""
    both = first.select(F.lit(0).alias("p"), F.trim("code").alias("stock_id"), F.trim("name").alias("name")).union(second.select(F.lit(1), F.trim("code"), F.trim("name"))).where("coalesce(stock_id, '') <> ''")
    return both.groupBy("stock_id").agg(F.min_by("name", F.struct("p", "name")).alias("name"))


def posts(pages: DataFrame) -> DataFrame:
    """Stored index rows (href, title, label, author) to posts; deleted ones (no href) go."""
    place = r"(M\.(\d+)\.A\.\w+)\.html"
    out = pages.where(F.coalesce("href", F.lit("")).rlike(place)).select(F.regexp_extract("href", place, 1).alias("post_id"), F.timestamp_seconds(F.regexp_extract("href", place, 2).cast("long")).alias("posted_at"), F.nullif(F.regexp_extract(F.trim("title"), r"^(?:Re:\s*|Fw:\s*)?\[([^\]]+)\]", 1), F.lit("")).alias("category"), F.trim("title").alias("title"), F.trim("author").alias("author"), F.trim("label").alias("push_label"))
    return out.withColumn("push_score", push_score(F.col("push_label")))


def comments(rows: DataFrame) -> DataFrame:
    """Comment stamps (``MM/dd HH:mm`` local) to UTC; a month more than six before the post's is of the next year."""
    stamp = r"(\d{2})/(\d{2})\s+(\d{2}):(\d{2})"
    part = [F.regexp_extract("stamp", stamp, k).try_cast("int") for k in (1, 2, 3, 4)]
    local = F.from_utc_timestamp("posted_at", "Asia/Taipei")
    year = F.year(local) + F.when(part[0] < F.month(local) - 6, 1).otherwise(0)
    when = F.try_make_timestamp(year, part[0], part[1], part[2], part[3], F.lit(0).cast("decimal(16,6)"))
    return rows.select("post_id", "seq", F.to_utc_timestamp(when, "Asia/Taipei").alias("commented_at"), F.trim("user").alias("user"), F.trim(F.regexp_replace("text", "^[: ]+", "")).alias("text"))


def board_articles(rows: DataFrame) -> DataFrame:
    """Engagement of a push label, notices dropped."""
    score = F.when(F.col("label") == "爆", 100).when(F.col("label").startswith("X"), -10).otherwise(F.coalesce(F.col("label").try_cast("int"), F.lit(0)))
    return rows.where(~F.col("title").contains("公告")).select("article_id", "title", score.alias("engagement"))


def keyword_articles(keywords: DataFrame, articles: DataFrame) -> DataFrame:
    """Keywords with the ids of the articles they match, one row for each known article."""
    return keywords.select("keyword", F.explode("matched_ids").alias("article_id")).join(articles, "article_id").select("keyword", "article_id", "title", "engagement")


def social_posts(raw: DataFrame) -> DataFrame:
    """JSON posts: engagement is likes and comments, a missing author is anonymous, topics stay JSON."""
    schema = "struct<id:bigint,title:string,author:string,likes:bigint,comments:bigint,created_at:string,topics:array<string>>"
    p = raw.select(F.from_json("value", schema).alias("p")).select("p.*").where("id is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return p.select("id", "title", F.coalesce(F.nullif("author", F.lit("")), F.lit("匿名")).alias("author"), (zero("likes") + zero("comments")).alias("engagement"), F.try_to_timestamp("created_at").alias("created_at"), F.to_json("topics").alias("topics"))


def star_prices(prices: DataFrame) -> DataFrame:
    """Facts with their calendar features; a missing volume is 0."""
    return prices.select(F.col("stock_id").alias("ticker"), "date", "close", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.month("date").alias("month"), F.quarter("date").alias("quarter"))


def prices_of(prices: DataFrame, stocks: DataFrame | None = None, start: Column | None = None) -> DataFrame:
    """Prices of some stocks from a day on."""
    rows = prices if start is None else prices.where(F.col("date") >= start)
    return rows if stocks is None else rows.join(stocks.select("stock_id").distinct(), "stock_id", "left_semi")


def heat_of(heat: DataFrame, keywords: DataFrame, start: Column, days: int = 30) -> DataFrame:
    """Heat of some keywords from ``days`` before a day on."""
    return heat.where(F.col("date") >= F.date_sub(start, days)).join(keywords.select("keyword").distinct(), "keyword", "left_semi")


def active_links(links: DataFrame) -> DataFrame:
    """S23."""
    return links.where("active = 1")


def observations(bursts: DataFrame, news: DataFrame, classified: DataFrame, start: Column) -> DataFrame:
    """Bursts from a Taipei midnight on, each with its news and its keyword's class where there are any."""
    rows = bursts.where(F.coalesce("published_at", "fetched_at") >= day_start_utc(start).cast("timestamp_ntz"))
    c = classified.select("keyword", "canonical_keyword", F.col("theme_name").alias("classification_theme"))
    return rows.join(news, "burst_id", "left").join(c, "keyword", "left")
