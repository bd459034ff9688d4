"""Data repair: duplicates of re-polled feeds, and time columns of two eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedstream.functions.exprs import local_to_utc, strict_time


def has_value(c: str) -> Column:
    """Neither null nor blank."""
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def _alone(known: Column, row_id: str) -> Column:
    """A part of a grouping key that leaves rows without a key by themselves."""
    return F.when(~known, F.col(row_id))


def dedupe_bursts(bursts: DataFrame) -> DataFrame:
    """One row for each (keyword, published_at): the smallest id, the traffic of the largest, and whether the survivor was fetched first.

    Rows without keyword or time belong to no group and come through singly.
    """
    out = bursts.groupBy("keyword", "published_at", _alone(has_value("keyword") & has_value("published_at"), "burst_id").alias("_alone")).agg(
        F.min("burst_id").alias("burst_id"), F.max_by("approx_traffic", "burst_id").alias("approx_traffic"), F.count("*").alias("rows"),
        F.min("fetched_at").alias("first_fetch"), F.min_by("fetched_at", "burst_id").alias("fetched_at"))
    return out.withColumn("earliest", F.col("first_fetch").eqNullSafe(F.col("fetched_at"))).drop("first_fetch", "_alone")


def survivor_map(bursts: DataFrame) -> DataFrame:
    """(burst_id, survivor) for every burst; one without keyword or time survives itself."""
    grouped = bursts.where(has_value("keyword") & has_value("published_at"))
    first = grouped.groupBy("keyword", "published_at").agg(F.min("burst_id").alias("survivor"))
    return bursts.join(first, ["keyword", "published_at"], "left").select("burst_id", F.coalesce("survivor", "burst_id").alias("survivor"))


def dedupe_news(news: DataFrame, survivors: DataFrame) -> DataFrame:
    """News under surviving bursts; of each (burst, url) the smallest id stays.

    A survivor keeps its own sentiment, score and type; only where it has no
    sentiment it takes all three from the first row that has one. Where
    sentiments of a group differ nothing is taken and ``conflict`` is set. News without a
    URL belong to no group and come through singly.
    """
    moved = news.join(survivors, "burst_id", "left").withColumn("burst_id", F.coalesce("survivor", "burst_id"))
    known = has_value("news_sentiment")
    triple = F.struct("news_sentiment", "sentiment_score", "event_type")
    out = moved.groupBy("burst_id", "news_url", _alone(has_value("news_url"), "news_id").alias("_alone")).agg(
        F.min("news_id").alias("news_id"), F.min_by(F.struct(triple.alias("t"), known.alias("known")), "news_id").alias("own"), F.min_by(triple, F.when(known, F.col("news_id"))).alias("donor"),
        F.count("*").alias("rows"), (F.count_distinct(F.when(known, F.col("news_sentiment"))) > 1).alias("conflict"))
    take = ~F.col("own.known") & ~F.col("conflict") & F.col("donor").isNotNull()
    return out.withColumn("t", F.when(take, F.col("donor")).otherwise(F.col("own.t"))).select("news_id", "burst_id", "news_url", "t.*", "rows", "conflict")


def quarantine(bursts: DataFrame, news: DataFrame) -> DataFrame:
    """Rows (table, id, reason) that must not be grouped, and groups that a repair must not settle by itself."""
    b, n = dedupe_bursts(bursts), dedupe_news(news, survivor_map(bursts))
    row = lambda df, table, id_, reason: df.select(F.lit(table).alias("table"), F.col(id_).cast("long").alias("id"), F.lit(reason).alias("reason"))
    out = row(bursts.where(~(has_value("keyword") & has_value("published_at"))), "bursts", "burst_id", "no key")
    out = out.union(row(news.where(~has_value("news_url")), "news", "news_id", "no url"))
    return out.union(row(b.where("not earliest"), "bursts", "burst_id", "survivor not fetched first")).union(row(n.where("conflict"), "news", "news_id", "sentiments differ"))


def settled(deduped: DataFrame, flag: Column, what: str) -> DataFrame:
    """``deduped`` as it is, in a plan that fails on the first row for which ``flag`` does not hold."""
    return deduped.where(F.when(F.coalesce(flag, F.lit(False)), True).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def dedupe_report(before_bursts: DataFrame, after_bursts: DataFrame, before_news: DataFrame, after_news: DataFrame) -> DataFrame:
    """D3: row counts before and after, keys that still repeat, and news without a burst."""
    again = after_bursts.where(has_value("keyword") & has_value("published_at")).groupBy("keyword", "published_at").agg(F.count("*").alias("n")).where("n > 1")
    orphans = after_news.join(after_bursts.select("burst_id"), "burst_id", "left_anti")
    counts = [("bursts_before", before_bursts), ("bursts_after", after_bursts), ("news_before", before_news), ("news_after", after_news), ("repeating_keys", again), ("orphans", orphans)]
    out = None
    for name, df in counts:
        one = df.agg(F.lit(name).alias("check"), F.count("*").alias("value"))
        out = one if out is None else out.union(one)
    return out


def repair_times(rows: DataFrame, fetch_zone: str = "Asia/Taipei", publish_zone: str = "America/Los_Angeles") -> DataFrame:
    """Text times to UTC: published ones are in the feed's zone; fetched ones of 26 characters are in local time, of 19 in UTC already.

    Adds era, both UTC times, the problem that keeps a row from repair, the
    lag before and after it, and by how many hours publishing was moved.
    """
    old = F.length("fetched_at") == 26
    fetched, published = strict_time(F.col("fetched_at")), strict_time(F.col("published_at"))
    out = rows.withColumn("era", F.when(old, "local").when(F.length("fetched_at") == 19, "utc"))
    out = out.withColumn("_f", local_to_utc(fetched, fetch_zone)).withColumn("_p", local_to_utc(published, publish_zone))
    layout = F.col("era").isNull() | fetched.isNull() | published.isNull()
    out = out.withColumn("problem", F.when(layout, "layout").when(old, F.coalesce("_f.problem", "_p.problem")).otherwise(F.col("_p.problem")))
    good = F.col("problem").isNull()
    out = out.withColumn("fetched_utc", F.when(old, F.col("_f.utc")).otherwise(fetched)).withColumn("published_utc", F.col("_p.utc"))
    seconds = lambda a, b: F.when(good, F.unix_timestamp(a) - F.unix_timestamp(b))
    out = out.withColumns({"lag_before": seconds(fetched, published), "lag_seconds": seconds(F.col("fetched_utc"), F.col("published_utc")), "offset_hours": seconds(F.col("published_utc"), published) / 3600})
    return out.drop("_f", "_p")


def lag_stats(repaired: DataFrame, column: str = "lag_seconds") -> DataFrame:
    """Rows, extremes, mean and upper median (element n div 2) of a lag (``lag_before`` or after) by era, by rank within the era."""
    # nulls are left to the aggregates: a filter would repeat the whole repair in the scan
    median = F.expr(f"percentile_disc(0.5) within group (order by -{column})")
    out = repaired.groupBy("era").agg(F.count(column).alias("rows"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), median.alias("_m")).where("rows > 0")
    return out.select("era", "rows", "least", "most", "mean", (-F.col("_m")).cast("long").alias("median"))


def offset_counts(repaired: DataFrame) -> DataFrame:
    """Rows by the hours that their time of publishing was moved."""
    label = F.format_string("%+.0fh", "offset_hours")
    return repaired.groupBy(label.alias("offset")).agg(F.count("offset_hours").alias("rows")).where("rows > 0")


def precondition_counts(bursts: DataFrame, news: DataFrame) -> DataFrame:
    """What keeps the times of bursts (burst_id, published_at, fetched_at) and news (burst_id, fetched_at) from repair (check, rows); all of it 0 is fit."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    odd = lambda c: ~size(c).isin(19, 26)
    part = lambda c: (F.length(c) == 26) & (F.substr(c, F.lit(20)) != ".000000")
    null = F.col("published_at").isNull() | F.col("fetched_at").isNull()
    b = bursts.agg(F.count_if(null).alias("null times"), F.count_if(~null & (odd("published_at") | odd("fetched_at"))).alias("unknown layout"), F.count_if(F.length("published_at") != F.length("fetched_at")).alias("layouts differ"), F.count_if(part("published_at") | part("fetched_at")).alias("_f"))
    n = news.agg(F.count_if(odd("fetched_at")).alias("unknown news layout"), F.count_if(part("fetched_at")).alias("_g"))
    met = news.select("burst_id", F.length("fetched_at").alias("_n")).join(bursts.select("burst_id", F.length("fetched_at").alias("_b")), "burst_id").agg(F.count_if(F.col("_n") != F.col("_b")).alias("news of another era"))
    row = b.crossJoin(n).crossJoin(met).withColumn("fractions of seconds", F.col("_f") + F.col("_g"))
    names = ["null times", "unknown layout", "layouts differ", "unknown news layout", "news of another era", "fractions of seconds"]
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("check"), F.col(x).alias("rows")) for x in names])).alias("r")).select("r.*")


def verify_times(before: DataFrame, repaired: DataFrame, least_hours: float = 0.0) -> DataFrame:
    """After the repair (check, rows): rows lost or made, rows that weren't repaired, and lags under the least one, which say that a zone is wrong."""
    counts = repaired.agg(F.count("*").alias("_n"), F.count_if(F.col("problem").isNotNull()).alias("not repaired"), F.count_if(F.col("lag_seconds") < F.lit(least_hours * 3600 - 0.0036)).alias("negative lags"))
    row = counts.crossJoin(before.agg(F.count("*").alias("_b"))).withColumn("rows changed", F.abs(F.col("_n") - F.col("_b")))
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("check"), F.col(x).alias("rows")) for x in ("rows changed", "not repaired", "negative lags")])).alias("r")).select("r.*")
