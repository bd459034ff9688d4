"""Idempotent writes as set operations: what a table holds after a batch arrives.

Parquet has no merge, so each upsert is old union new followed by one
aggregation or window by key; running a batch twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedstream.functions.exprs import OTHER_THEME, clamp_confidence, theme_form


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """S7, S11, S22, S25 (comments), S27, S28: the incoming row wins on all columns; among incoming ones the first by ``order``."""
    both = old.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("_p", *(order or []))
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_p", "_n")


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Unknown keys come in whole; of known ones only the named columns are set. Null keys are equal to no key."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    one = new.where(known).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)])))).where("_n = 1").drop("_n")
    o = old.where(known).select(*keys, F.struct(*old.columns).alias("_o"))
    both = o.join(one.select(*keys, F.struct(*one.columns).alias("_n")), keys, "full")
    value = lambda c: F.when(F.col("_o").isNull(), F.col(f"_n.{c}")).when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")) if c in columns else F.coalesce(f"_o.{c}", F.when(F.col("_o").isNull(), F.col(f"_n.{c}")))
    here = lambda c: value(c) if c in new.columns else F.col(f"_o.{c}")
    out = both.select(*[(F.col(c) if c in keys else here(c)).alias(c) for c in old.columns])
    return out.unionByName(old.where(~known)).unionByName(new.where(~known), allowMissingColumns=True)


def unloaded(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """The posts whose thread has no comments yet."""
    return posts.join(comments.select("post_id").distinct(), "post_id", "left_anti")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of keys that the table has not; the first of each key by ``order``."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    one = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return old.unionByName(one, allowMissingColumns=True)


def upsert_bursts(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (keyword, published_at) the first fetch time stays and traffic is that of the last fetch."""
    both = old.unionByName(new).withColumn("last_fetched_at", F.col("fetched_at"))
    return fold_bursts(both).drop("last_fetched_at")


def fold_bursts(rows: DataFrame) -> DataFrame:
    """S2 over rows of any number of batches with ``last_fetched_at``; folds fold on."""
    return rows.groupBy("keyword", "published_at").agg(
        F.min("fetched_at").alias("fetched_at"), F.max("last_fetched_at").alias("last_fetched_at"), F.max_by("approx_traffic", F.struct("last_fetched_at", "approx_traffic")).alias("approx_traffic"))


def collect_counts(old: DataFrame, old_news: DataFrame, items: DataFrame) -> DataFrame:
    """Six counters of each batch of feed items (batch, fetched_at, keyword, published_at, usable, broken, news).

    ``items`` are the usable ones; an item is new if neither the table nor an
    earlier item has its key, else it updates; a news is new if its burst has no such address yet. Items that aren't usable are
    skipped, usable ones that are ``broken`` (can't be stored) failed.
    """
    key = ["keyword", "published_at"]
    good = items.where("usable and not broken")
    known = old.select(*key).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("batch", "fetched_at")) == 1
    rows = good.join(known, key, "left").withColumn("_new", F.col("_known").isNull() & first)
    stored = rows.groupBy("batch").agg(F.count_if("_new").alias("new_trends"), F.count_if(~F.col("_new")).alias("updated_trends"))
    urls = good.select("batch", *key, F.explode(F.transform("news", lambda n: n["news_item_url"])).alias("news_url"))
    fresh = urls.groupBy(*key, "news_url").agg(F.min("batch").alias("batch")).join(old_news.select(*key, "news_url"), [*key, "news_url"], "left_anti").groupBy("batch").agg(F.count("*").alias("new_news"))
    seen = items.groupBy("batch").agg(F.count_if("usable").alias("items"), F.count_if(~F.col("usable")).alias("skipped_items"), F.count_if(F.col("usable") & F.col("broken")).alias("failed_items"))
    out = seen.join(stored, "batch", "left").join(fresh, "batch", "left")
    return out.select("batch", "items", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new_trends", "updated_trends", "new_news")], "skipped_items", "failed_items")


def normalise_prices(raw: DataFrame) -> DataFrame:
    """Snake-case names, plain dates, adjusted close or else close, upper-case codes, eight columns."""
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    adjusted = F.coalesce("adj_close", "close") if "adj_close" in named.columns else F.col("close")
    return named.select(F.to_date("date").alias("date"), F.upper(F.trim("stock_id")).alias("stock_id"), "open", "high", "low", "close", adjusted.alias("adj_close"), F.col("volume").cast("long").alias("volume"))


def low_watermark(pool: DataFrame, prices: DataFrame, days: int = 14) -> DataFrame:
    """From when to fetch each stock; null asks for all history."""
    last = prices.groupBy("stock_id").agg(F.max("date").alias("last"))
    return pool.join(last, "stock_id", "left").select("stock_id", F.date_sub("last", days).alias("fetch_from"))


def stock_pool(csv: DataFrame, links: DataFrame) -> DataFrame:
    """Codes of the list and of active links, trimmed, upper-case, distinct, not empty."""
    both = csv.select("stock_id").union(links.where("active = 1").select("stock_id"))
    return both.select(F.upper(F.trim("stock_id")).alias("stock_id")).where("stock_id <> ''").distinct()


def heat_rows(raw: DataFrame) -> DataFrame:
    """Partial days and rows without a date go, bad scores are 0."""
    good = raw.where(F.col("burst_date").isNotNull() & ~F.coalesce("is_partial", F.lit(False)))
    return good.select("keyword", "theme_name", "burst_date", F.coalesce(F.col("burst_score").try_cast("int"), F.lit(0)).alias("burst_score"))


def heat_queue(links: DataFrame, history: DataFrame, today: Column) -> DataFrame:
    """Keywords of themes that need fresh heat, direct ones first, then the stalest."""
    rank = F.when(F.col("link_type") == "direct", 2).when(F.col("stock_id").isNotNull(), 1).otherwise(0)
    pairs = links.where("active = 1").groupBy("theme_name", "keyword").agg(F.max(rank).alias("rank"))
    last = history.groupBy("theme_name", "keyword").agg(F.max("burst_date").alias("last"))
    queue = pairs.join(last, ["theme_name", "keyword"], "left").where(F.col("last").isNull() | (F.col("last") < F.date_sub(today, 1)))
    return queue.orderBy(F.col("rank").desc(), F.col("last").asc_nulls_first(), "theme_name", "keyword")


def sync_themes(table: DataFrame, csv: DataFrame) -> DataFrame:
    """Legacy names renamed, rows the table has not inserted; link type ``theme`` where there is a stock."""
    key = ["theme_name", "keyword", "stock_id", "category"]
    renamed = table.withColumn("theme_name", theme_form(F.col("theme_name"))).withColumn("category", theme_form(F.col("category")))
    rows = csv.select(*key, F.when(F.col("stock_id") != "", "theme").alias("link_type")).distinct()
    held = renamed.select(*key).distinct()
    fresh = rows.alias("n").join(held.alias("o"), [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key], "left_anti")
    return renamed.unionByName(fresh, allowMissingColumns=True)


def guarded_classification(old: DataFrame, new: DataFrame, entity: bool = False) -> DataFrame:
    """Unknown keywords come in; a known one's row takes the columns that ``new`` has only where it was a fallback.

    Rows of entity resolution (``entity``) also replace what stands under the other theme or under none.
    """
    guard = F.coalesce(F.col("o.source") == "fallback", F.lit(False))
    if entity:
        guard = guard | F.coalesce(F.col("o.theme_name") == OTHER_THEME, F.lit(True))
    take = F.col("n.keyword").isNotNull() & (F.col("o.keyword").isNull() | guard)
    met = old.alias("o").join(new.alias("n"), F.col("o.keyword") == F.col("n.keyword"), "full")
    put = lambda c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return met.select(F.coalesce("o.keyword", "n.keyword").alias("keyword"), *[put(c).alias(c) for c in old.columns if c != "keyword"])


def classification_log(rows: DataFrame) -> DataFrame:
    """Append-only log rows: the result as JSON with sorted keys."""
    fields = sorted(c for c in rows.columns if c != "keyword")
    return rows.select("keyword", F.to_json(F.struct(*fields)).alias("result"))


def enrich_news(news: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sentiment, score and type are set only where one of them is missing."""
    p = predictions.select("news_id", F.struct("news_sentiment", "sentiment_score", "event_type").alias("p"))
    joined = news.join(p, "news_id", "left")
    missing = F.col("news_sentiment").isNull() | F.col("sentiment_score").isNull() | F.col("event_type").isNull()
    put = lambda c: F.when(missing & F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("news_id", put("news_sentiment"), put("sentiment_score"), put("event_type"))


def classification_rows(predictions: DataFrame, allowed: list[str]) -> DataFrame:
    """Validated classifications: allowed theme or other, link type by rule, confidence in 0..1."""
    theme = theme_form(F.coalesce("theme_name", F.lit(OTHER_THEME)))
    theme = F.when(theme.isin(*allowed), theme).otherwise(OTHER_THEME)
    kind = F.lower(F.trim(F.coalesce("link_type", F.lit("none"))))
    has = F.size(F.coalesce("stock_ids", F.array().cast("array<string>"))) > 0
    out = predictions.select("keyword", F.coalesce(F.nullif(F.substr(F.trim("canonical_keyword"), F.lit(1), F.lit(255)), F.lit("")), F.trim("keyword")).alias("canonical_keyword"), theme.alias("theme_name"), kind.alias("_k"), has.alias("_h"), clamp_confidence(F.col("confidence_score")).alias("confidence_score"))
    link = F.when(F.col("_h"), "company").when(F.col("_k").isin("company", "industry") & (F.col("theme_name") != OTHER_THEME), F.col("_k")).otherwise("none")
    return out.withColumn("link_type", link).withColumn("stock_related", (F.col("link_type") != "none").cast("int")).drop("_k", "_h")
