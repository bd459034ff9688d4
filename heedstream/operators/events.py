"""Event detection: rolling baselines, quiet-period rules and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedstream.functions.exprs import keyword_form, traffic_number

QUIET_DAYS = 3


def quiet_starts(days: DataFrame, key: list[str], date: str = "date", quiet: int = QUIET_DAYS) -> DataFrame:
    """Days that follow more than ``quiet`` days after the key's previous day."""
    last = F.lag(date).over(Window.partitionBy(*key).orderBy(date))
    return days.withColumn("_last", last).where(F.col("_last").isNull() | (F.datediff(date, "_last") > quiet)).drop("_last")


def quiet_events(bursts: DataFrame, tone: DataFrame | None = None) -> DataFrame:
    """Bursts (keyword, date, traffic) to events with the day's highest traffic and, of ``tone`` (keyword, date, tone), its sum."""
    days = bursts.groupBy("keyword", "date").agg(F.max("traffic").alias("traffic"))
    if tone is not None:
        days = days.join(tone.groupBy("keyword", "date").agg(F.sum("tone").alias("tone")), ["keyword", "date"], "left").withColumn("tone", F.coalesce("tone", F.lit(0)))
    return quiet_starts(days, ["keyword"])


def keyword_heat(heat: DataFrame, mapping: DataFrame, score: Column) -> DataFrame:
    """The day's highest score by mapped keyword; keywords meet by their normal form."""
    names = mapping.select(keyword_form(F.col("keyword")).alias("_k"), F.col("keyword").alias("_name")).dropDuplicates(["_k"])
    rows = heat.withColumn("_k", keyword_form(F.col("keyword"))).withColumn("_score", score)
    return rows.join(names, "_k").groupBy("date", F.col("_name").alias("keyword")).agg(F.max("_score").alias("heat"))


def subtheme_heat(daily: DataFrame, mapping: DataFrame) -> DataFrame:
    """Daily mean heat and keyword count of active sub-theme rows."""
    names = mapping.where("active = 1").select("sub_theme", keyword_form(F.col("keyword")).alias("_k")).distinct()
    rows = daily.withColumn("_k", keyword_form(F.col("keyword"))).join(names, "_k")
    return rows.groupBy("date", "sub_theme").agg(F.avg("heat").alias("heat"), F.count_distinct("_k").alias("keywords"))


def densify(*inputs: DataFrame) -> DataFrame:
    """Every day of each keyword from its first to its last day over all inputs (keyword, date)."""
    days = inputs[0].select("keyword", "date")
    for other in inputs[1:]:
        days = days.union(other.select("keyword", "date"))
    ends = days.where("date is not null").groupBy("keyword").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select("keyword", F.explode(F.sequence("a", "b")).alias("date"))


def detect(heat: DataFrame, news: DataFrame, rss: DataFrame) -> DataFrame:
    """Events of (keyword, date) with their triggers.

    ``heat`` has (keyword, date, heat), ``news`` (keyword, date, news_id)
    and ``rss`` (keyword, date, approx_traffic). Heat half again over the
    mean of the seven days before, three news at twice their mean, or a
    listing after three days off the list make an event.
    """
    h = heat.groupBy("keyword", "date").agg(F.max("heat").alias("heat"))
    n = news.dropDuplicates(["news_id"]).groupBy("keyword", "date").agg(F.count("*").alias("news_count"))
    r = rss.groupBy("keyword", "date").agg(F.max(traffic_number(F.col("approx_traffic"))).alias("traffic"))
    full = densify(h, n, r).join(h, ["keyword", "date"], "left").join(n, ["keyword", "date"], "left").join(r, ["keyword", "date"], "left")
    full = full.withColumn("news_count", F.coalesce("news_count", F.lit(0))).withColumn("on_list", F.col("traffic").isNotNull())
    by = Window.partitionBy("keyword").orderBy("date")
    seven, three = by.rowsBetween(-7, -1), by.rowsBetween(-3, -1)
    full = full.withColumn("_base", F.when(F.count("heat").over(seven) >= 3, F.avg("heat").over(seven)))
    full = full.withColumn("heat_change", F.when(F.col("_base") > 0, F.try_divide("heat", "_base") - 1))
    full = full.withColumn("_news", F.when(F.count("news_count").over(seven) >= 3, F.avg("news_count").over(seven)))
    full = full.withColumn("_recent", F.coalesce(F.max("on_list").over(three), F.lit(False)))
    marks = F.array(
        F.when(F.col("heat_change") >= 0.5, "heat"),
        F.when((F.col("news_count") >= 3) & (F.col("news_count") >= 2 * F.col("_news")), "news"),
        F.when(F.col("on_list") & ~F.col("_recent"), "listing"),
    )
    full = full.withColumn("triggers", F.array_join(F.filter(marks, lambda x: x.isNotNull()), "、")).where("triggers <> ''")
    return full.select("date", "keyword", "heat", "heat_change", "news_count", "traffic", "triggers")


def spikes(counts: DataFrame, least: int = 5, times: float = 3.0) -> DataFrame:
    """Counts (stock_id, date, count; every day): a hit is ``least`` and ``times`` the mean of 20 days before; hits after quiet days since the last hit."""
    prior = Window.partitionBy("stock_id").orderBy("date").rowsBetween(-20, -1)
    base = F.when(F.count("count").over(prior) >= 10, F.avg("count").over(prior))
    hits = counts.withColumn("_base", base).where((F.col("count") >= least) & (F.col("count") >= times * F.col("_base"))).drop("_base")
    return quiet_starts(hits, ["stock_id"])


def heat_rises(heat: DataFrame, times: float = 1.5) -> DataFrame:
    """(keyword, stock_id, date, score): a score of ``times`` the mean of seven observed rows before, after quiet days since the last hit."""
    prior = Window.partitionBy("keyword", "stock_id").orderBy("date").rowsBetween(-7, -1)
    base = F.when(F.count("score").over(prior) >= 3, F.avg("score").over(prior))
    hits = heat.withColumn("_base", base).where((F.col("_base") > 0) & (F.col("score") >= times * F.col("_base"))).drop("_base")
    return quiet_starts(hits, ["keyword", "stock_id"])


#: What the first event of a day stands for.
RETURNS = ("return_1d", "return_5d", "return_10d", "excess_1d", "excess_5d", "excess_10d")


def merge_days(events: DataFrame, news: DataFrame, headlines: int = 5, kinds: int = 3, common: DataFrame | None = None) -> DataFrame:
    """Events of a stock on one day as one numbered row with that day's news.

    ``events`` has stock_id, date, market_date, keyword, link_type, triggers,
    traffic and the six returns, ``news`` news_id, keyword, date,
    news_title, news_source, news_url, news_sentiment and event_type. A news
    counts once for a day, however many of its keywords it matches. Returns and market day are the first
    keyword's; of event types the most frequent count (the other type left out, ties by name), of
    headlines the first by id. Only those few of a day are gathered.
    ``common`` are further news (the same columns without keyword) that are told under every keyword
    of their date: they are counted once a date instead of once a stock, and what is in them
    must not be in ``news`` for that date.
    """
    key = ["stock_id", "date"]
    first = lambda c: F.min_by(F.struct(c), "keyword")[c].alias(c)  # noqa: E731  also where the value is null
    out = events.groupBy(*key).agg(
        first("market_date"), F.sort_array(F.collect_set("keyword")).alias("keywords"), F.sort_array(F.collect_set("link_type")).alias("link_types"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("triggers", "、"))))).alias("triggers"), F.max("traffic").alias("traffic"), *[first(c) for c in RETURNS])
    met = events.select(*key, "keyword").distinct().join(news, ["keyword", "date"])
    # dealt by stock and day once: what follows groups within that
    met = met.repartition(*key).groupBy(*key, "news_id").agg(F.min(F.struct("keyword", "news_title", "news_source", "news_url", "news_sentiment", "event_type")).alias("n")).select(*key, "news_id", "n.*")
    tone = lambda t: F.count_if(F.col("news_sentiment") == t)
    line = F.struct("news_id", F.struct("news_title", "news_source", "news_url", "news_sentiment").alias("h"))

    def digest(rows: DataFrame, by: list[str]) -> DataFrame:
        """Counts, the first lines, and the number of news of each type, of which there are few; first by type, then of all."""
        placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("news_id")))
        kind = placed.groupBy(*by, "event_type").agg(F.count("*").alias("n"), tone("Positive").alias("p"), tone("Neutral").alias("u"), tone("Negative").alias("g"), F.collect_list(F.when(F.col("_n") <= headlines, line)).alias("t"))
        counted = F.collect_list(F.when(F.col("event_type") != "其他", F.struct("event_type", "n"))).alias("_types")
        out = kind.groupBy(*by).agg(F.sum("n").alias("news_count"), F.sum("p").alias("positive"), F.sum("u").alias("neutral"), F.sum("g").alias("negative"), F.flatten(F.collect_list("t")).alias("_top"), counted)
        return out.withColumn("_types", F.when(F.size("_types") > 0, F.col("_types")))

    own = digest(met, key)
    names = ["news_count", "positive", "neutral", "negative"]
    lists = ["_top", "_types"]
    out = out.join(own, key, "left")
    if common is not None:
        day = digest(common, ["date"])
        day = day.select("date", *[F.col(c).alias(f"_day{c}") for c in names + lists])
        out = out.join(F.broadcast(day), "date", "left").select(*out.columns, *[f"_day{c}" for c in names + lists])  # one row a date
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_day{c}", F.lit(0)) for c in names} | {c: F.when(F.col(c).isNull(), F.col(f"_day{c}")).when(F.col(f"_day{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"_day{c}")) for c in lists})
        out = out.drop(*[f"_day{c}" for c in names + lists])
    total = F.transform(F.array_distinct(F.transform("_types", lambda x: x["event_type"])), lambda t: F.struct((-F.aggregate(F.filter("_types", lambda x: x["event_type"] == t), F.lit(0).cast("long"), lambda n, x: n + x["n"])).alias("n"), t.alias("event_type")))
    out = out.withColumns({
        "headlines": F.transform(F.slice(F.sort_array("_top"), 1, headlines), lambda x: x["h"]),
        "event_types": F.transform(F.slice(F.sort_array(total), 1, kinds), lambda x: x["event_type"]),
    }).drop(*lists).fillna(0, names)
    return out.withColumn("number", F.row_number().over(Window.partitionBy("stock_id").orderBy("date")))


def usable_days(events: DataFrame, calendar: DataFrame, lag: int = 0) -> DataFrame:
    """(stock_id, day) on which an event can be acted on, ``lag`` trading days after its aligned day; all stocks share the calendar (date, day), which is broadcast."""
    from heedstream.operators.returns import trading_day_map

    first = calendar.agg(F.min("date").alias("_first"))
    own = events.select("stock_id", "date").crossJoin(F.broadcast(first)).select("stock_id", F.greatest("date", "_first").alias("date"))
    return own.join(F.broadcast(trading_day_map(calendar)), "date").select("stock_id", (F.col("day") + lag).alias("day")).distinct()


def flag_days(daily: DataFrame, usable: DataFrame, name: str) -> DataFrame:
    """Rows of ``daily`` with whether their day is usable; a stock's days meet its rows as one set, by stock, so that the rows stay where they are."""
    marked = usable.groupBy("stock_id").agg(F.collect_set("day").alias("_days"))
    out = daily.join(marked, "stock_id", "left").withColumn(name, F.coalesce(F.array_contains("_days", F.col("day")), F.lit(False)))
    return out.drop("_days")


def near(daily: DataFrame, flag: str, rows: int = 5) -> DataFrame:
    """Any event within ``rows`` trading rows on either side."""
    return daily.withColumn("near_event", F.max(flag).over(Window.partitionBy("stock_id").orderBy("date").rowsBetween(-rows, rows)))


def session_shares(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shares of mentions (when) before, in and after the market's hours and at weekends."""
    from heedstream.functions.exprs import market_session

    session = market_session(F.col("when"))
    share = lambda *k: F.avg(session.isin(*k).cast("double"))
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("mentions"), *[share(k).alias(f"{k}_share") for k in ("pre", "in", "after", "weekend")])


def most_mentioned(rows: DataFrame, most: int = 6) -> DataFrame:
    """The stocks with most mentions; a top-k report."""
    return rows.groupBy("stock_id").agg(F.count("*").alias("mentions")).orderBy(F.col("mentions").desc(), "stock_id").limit(most)
