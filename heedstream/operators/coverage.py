"""Coverage, freshness and status of the collected data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedstream.functions.exprs import OTHER_THEME, SENTIMENTS, UNANALYZED, expected_trading_day, keyword_form, previous_weekday, sentiment_form, taipei_day
from heedstream.operators import logs as lg
from heedstream.sources.shared import stage


def theme_daily_stats(heat: DataFrame, bursts: DataFrame, news: DataFrame, mapping: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """By day and theme: keywords and scores of the heat rows, news and bursts, and the theme's active stocks.

    Every theme with an active row of ``mapping`` has a row on each of ``days``
    (if None on all days of heat and bursts), and so has a theme that only heat or bursts
    know on their days. Counts without rows are 0, scores without a known value null.
    """
    key = ["date", "theme_name"]
    known = lambda df: df.where("date is not null and theme_name is not null")
    h = known(heat).groupBy(*key).agg(F.count_distinct("keyword").alias("keywords"), F.avg("trend_score").alias("avg_score"), F.max(F.col("trend_score").cast("double")).alias("max_score"))
    t = known(bursts).groupBy(*key).agg(F.count_distinct("burst_id").alias("bursts"))
    n = known(news).groupBy(*key).agg(F.count_distinct("news_id").alias("news"))
    active = mapping.where("active = 1 and theme_name is not null")
    s = active.groupBy("theme_name").agg(F.count_distinct("stock_id").alias("stocks"))
    facts = stage(h.join(t, key, "full").join(n, key, "full"), "facts")
    # a theme's rows stand for the days up to its next one, as of the benchmark's calendar: no day of a theme is shuffled or held by itself
    calendar = (facts.select("date") if days is None else days).distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    calendar = stage(calendar, "calendar")
    values = ["keywords", "bursts", "news", "avg_score", "max_score"]
    own = facts.join(F.broadcast(calendar), "date").select("theme_name", "day", *values, F.lit(None).cast("long").alias("stocks"))
    marks = s.select("theme_name", F.lit(0).alias("day"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in values], "stocks")
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows go in and many come out, so that small parts are not to be put together
    by = Window.partitionBy("theme_name")
    rows = own.union(marks).repartition(parts, "theme_name").crossJoin(F.broadcast(calendar.agg(F.coalesce(F.max("day"), F.lit(0)).alias("_end"))))
    rows = rows.withColumn("stocks", F.max("stocks").over(by)).withColumn("_to", F.coalesce(F.lead("day").over(by.orderBy("day")) - 1, "_end"))
    rows = rows.withColumn("_to", F.when(F.col("stocks").isNull(), F.col("day")).otherwise(F.col("_to"))).withColumn("_from", F.greatest("day", F.lit(1))).where("_from <= _to")
    out = rows.withColumn("_d", F.explode(F.sequence("_from", "_to")))
    out = out.select("theme_name", F.col("_d").alias("day"), "stocks", *[F.when(F.col("_d") == F.col("day"), F.col(c)).alias(c) for c in values]).join(F.broadcast(calendar), "day")
    return out.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keywords", "bursts", "news", "stocks")], "avg_score", "max_score")


def theme_coverage(themes: DataFrame, bursts: DataFrame, news: DataFrame) -> DataFrame:
    """Distinct bursts and news of each theme, themes without any included."""
    t = bursts.groupBy("theme_name").agg(F.count_distinct("burst_id").alias("bursts"))
    n = news.groupBy("theme_name").agg(F.count_distinct("news_id").alias("news"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return themes.select("theme_name").distinct().join(t, "theme_name", "left").join(n, "theme_name", "left").select("theme_name", zero("bursts"), zero("news"))


def keyword_themes(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (keyword, ...) under every theme whose keywords have the same normal form, for tables without classes."""
    themes = mapping.select("theme_name", keyword_form(F.col("keyword")).alias("_form")).distinct()
    return rows.drop("theme_name").withColumn("_form", keyword_form(F.col("keyword"))).join(themes, "_form").drop("_form")


def _with_entity(bursts: DataFrame, classified: DataFrame) -> DataFrame:
    known = F.col("entity_name").isNotNull() & F.col("entity_type").isNotNull() & (F.col("entity_type") != OTHER_THEME)
    rows = bursts.where("trim(keyword) <> ''").join(classified.select("keyword", "entity_name", "entity_type"), "keyword", "left")
    return rows.withColumn("_known", F.coalesce(known, F.lit(False)))


def entity_coverage(bursts: DataFrame, classified: DataFrame) -> DataFrame:
    """How many keywords have an entity, and their share; blank keywords don't count."""
    rows = _with_entity(bursts, classified).select("keyword", "_known").distinct()
    hits = F.count_if("_known")
    return rows.agg(F.count("*").alias("keywords"), hits.alias("resolved"), (F.count("*") - hits).alias("unresolved"), F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)).alias("rate"))


def unresolved_keywords(bursts: DataFrame, classified: DataFrame, most: int = 100) -> DataFrame:
    """Keywords without an entity by the number of their bursts; a top-k report (all of them if ``most`` is 0)."""
    rows = _with_entity(bursts, classified).where("not _known").groupBy("keyword").agg(F.count("burst_id").alias("bursts")).orderBy(F.col("bursts").desc(), "keyword")
    return rows.limit(most) if most else rows


def quality_summary(bursts: DataFrame, classified: DataFrame) -> DataFrame:
    """Keywords, how many are classified, their share and how many want review."""
    rows = bursts.select("keyword").distinct().join(classified, "keyword", "left")
    done = F.count_if(F.coalesce("theme_name", F.lit(OTHER_THEME)) != OTHER_THEME)
    return rows.agg(F.count("*").alias("total"), done.alias("classified"), F.try_divide(done * 100.0, F.count("*")).alias("coverage_pct"), F.count_if(F.col("need_review") == 1).alias("need_review"))


def verification_sample(news: DataFrame, most: int = 20) -> DataFrame:
    """The first analysed news by id, under the sheet's column names."""
    rows = news.where(sentiment_form(F.col("news_sentiment")) != UNANALYZED)
    return rows.orderBy("news_id").limit(most).select(F.col("news_title").alias("title"), F.coalesce("news_title", F.lit("新聞內容未提供")).alias("summary"), F.col("news_source").alias("source"), F.col("news_sentiment").alias("sentiment"))


def daily_tone(news: DataFrame, keys: list[str]) -> DataFrame:
    """Daily news by sentiment, all four labels as columns."""
    rows = news.withColumn("_tone", sentiment_form(F.col("news_sentiment")))
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("_tone") == t).alias(t.lower()) for t in (*SENTIMENTS, UNANALYZED)])


def stock_options(links: DataFrame, prices: DataFrame, benchmark: str) -> DataFrame:
    """Keywords of each priced stock by link type, most first."""
    priced = prices.select("stock_id").distinct()
    out = links.where((F.col("active") == 1) & (F.col("stock_id") != benchmark)).join(priced, "stock_id", "left_semi").groupBy("stock_id").agg(F.count_distinct(F.when(F.col("link_type") == "direct", F.col("keyword"))).alias("direct"), F.count_distinct(F.when(F.col("link_type") == "theme", F.col("keyword"))).alias("theme"))
    return out.withColumn("total", F.col("direct") + F.col("theme")).orderBy(F.col("total").desc(), "stock_id")


def market_radar(members: DataFrame, stocks: DataFrame, heat: DataFrame, observations: DataFrame, prices: DataFrame, today: Column) -> DataFrame:
    """By theme the change of heat (last seven days over the seven before), the last seven days' news by tone, and the basket's mean return over ten rows.

    ``members`` (theme_name, keyword) and ``stocks`` (theme_name, stock_id) define the themes; the other theme is left out. News of
    ``observations`` (news_id, keyword, canonical, date, news_sentiment) belong to a theme by either name, once each.
    """
    members = members.where(F.col("theme_name") != OTHER_THEME).distinct()
    stocks = stocks.where((F.col("theme_name") != OTHER_THEME) & (F.coalesce("stock_id", F.lit("")) != "")).distinct()
    back = F.datediff(today, "date")
    mean = lambda a, b: F.avg(F.when(back.between(a, b), F.col("trend_score")))
    h = heat.where(back <= 13).join(members, "keyword").groupBy("theme_name").agg(F.avg(F.when(back <= 6, F.col("trend_score"))).alias("heat_recent"), mean(7, 13).alias("_before"))
    recent = observations.where(F.col("news_id").isNotNull() & (back <= 6))
    either = recent.select("news_id", "news_sentiment", F.explode(F.array_distinct(F.array("keyword", "canonical"))).alias("keyword"))
    n = either.join(members, "keyword").groupBy("theme_name", "news_id").agg(F.max(sentiment_form(F.col("news_sentiment"))).alias("tone"))
    tone = lambda t: F.count_if(F.col("tone") == t).alias(t.lower())
    n = n.groupBy("theme_name").agg(F.count("*").alias("news"), *[tone(t) for t in SENTIMENTS])
    newest = Window.partitionBy("stock_id").orderBy(F.col("date").desc())
    last = prices.where("close is not null").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= 11).groupBy("stock_id").agg(F.max(F.when(F.col("_n") == 1, F.col("close"))).alias("a"), F.max(F.when(F.col("_n") == 11, F.col("close"))).alias("b"))
    move = last.where("b <> 0").select("stock_id", (F.col("a") / F.col("b") - 1).alias("move"))
    b = stocks.join(move, "stock_id", "left").groupBy("theme_name").agg(F.avg("move").alias("return_10d"), F.count("*").alias("stocks"))
    themes = members.select("theme_name").union(stocks.select("theme_name")).distinct()
    out = themes.join(h, "theme_name", "left").join(n, "theme_name", "left").join(b, "theme_name", "left")
    change = F.when(F.col("_before") > 0, F.col("heat_recent") / F.col("_before") - 1)
    return out.select("theme_name", change.alias("heat_change"), "heat_recent", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("news", "positive", "neutral", "negative")], "return_10d", F.coalesce("stocks", F.lit(0)).alias("stocks"))


def timeline(news: DataFrame, names: DataFrame) -> DataFrame:
    """Titled news of named keywords once each, newest first."""
    rows = news.join(names.select("keyword", "theme_name"), "keyword").where("trim(coalesce(news_title, '')) <> ''").dropDuplicates(["news_id"])
    return rows.select("date", "theme_name", "keyword", "news_id", "news_title", F.coalesce("news_source", F.lit("unknown")).alias("news_source"), sentiment_form(F.col("news_sentiment")).alias("news_sentiment")).orderBy(F.col("date").desc(), "news_id")


def system_status(bursts: DataFrame, news: DataFrame, classified: DataFrame, prices: DataFrame, links: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """One row of counts and extrema with the rule of stale, pending or healthy.

    ``now`` and burst times are UTC; days are Taipei's. Stale is without bursts of the last day; pending
    is with unclassified keywords, keywords without an entity, titled news
    that lack one of three values, prices of more than three days or statistics of more than one day ago.
    """
    named = bursts.where("trim(keyword) <> ''").select("keyword").distinct()
    k = named.join(classified.select("keyword", "theme_name", "source", "entity_name", "entity_type", F.lit(True).alias("_c")), "keyword", "left")
    fallback = (F.col("source") == "fallback") & (F.col("theme_name") == OTHER_THEME)
    k = k.agg(F.count("*").alias("total_keywords"), F.count("_c").alias("classified_keywords"), F.count_if(F.col("_c").isNull() | fallback).alias("unclassified_keywords"),
              F.count_if(F.col("entity_name").isNull() | F.col("entity_type").isNull() | (F.col("entity_type") == OTHER_THEME)).alias("pending_entities"))
    t = bursts.agg(F.count("*").alias("event_count"), F.max(F.coalesce("fetched_at", "published_at")).alias("latest_burst_at"), F.min(F.coalesce("published_at", "fetched_at")).alias("earliest_burst_at"))
    lacks = F.col("news_sentiment").isNull() | F.col("sentiment_score").isNull() | F.col("event_type").isNull()
    n = news.agg(F.count("*").alias("total_news"), F.count_if(~lacks).alias("analyzed_news"), F.count_if(lacks & F.col("news_title").isNotNull()).alias("unanalyzed_news"))
    p = prices.agg(F.count("*").alias("stock_rows"), F.max("date").alias("latest_stock_date"))
    x = links.where("active = 1").agg(F.count_distinct("theme_name").alias("theme_count"), F.count_distinct("stock_id").alias("tracked_stock_count"))
    row = k.crossJoin(t).crossJoin(n).crossJoin(p).crossJoin(x).crossJoin(stats.agg(F.max("date").alias("latest_stats_date")))
    today = taipei_day(now)
    row = row.withColumns({"history_start": taipei_day(F.col("earliest_burst_at")), "history_end": taipei_day(F.col("latest_burst_at"))})
    stale = F.coalesce(now - F.col("latest_burst_at").cast("timestamp") > F.expr("interval 24 hours"), F.lit(True))
    older = lambda c, days: F.coalesce(F.datediff(today, c) > days, F.lit(True))
    open_ = (F.col("unclassified_keywords") > 0) | (F.col("unanalyzed_news") > 0) | (F.col("pending_entities") > 0) | older("latest_stock_date", 3) | older("latest_stats_date", 1)
    return row.withColumn("health", F.when(stale, "stale").when(open_, "pending").otherwise("healthy"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """G33."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


def live_light(minutes: Column, green: int, red: int) -> Column:
    """The light of a source by minutes since its last row."""
    return F.when(minutes.isNull() | (minutes > red), "red").when(minutes <= green, "green").otherwise("yellow")


def live_status(rss_minutes: Column, etl_hours: Column) -> Column:
    """Red without new rows for a day, green within an hour and with an update job that ended within seven, else yellow."""
    late = (rss_minutes > 60) | etl_hours.isNull() | (etl_hours > 7)
    return F.when(rss_minutes.isNull() | (rss_minutes > 24 * 60), "red").when(late, "yellow").otherwise("green")


def new_rows(tables: dict[str, tuple[DataFrame, str]], start: Column, end: Column) -> DataFrame:
    """Rows of one Taipei day by table; the day is a half-open UTC range, so that it reaches the scan."""
    out = None
    for name, (df, column) in tables.items():
        one = df.where((F.col(column) >= start) & (F.col(column) < end)).agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


def heat_coverage(links: DataFrame, heat: DataFrame, today: Column, days: int = 3) -> DataFrame:
    """Active pairs of theme and keyword, how many have fresh heat, and the same of direct ones."""
    pairs = links.where("active = 1").groupBy("theme_name", "keyword").agg(F.max((F.col("link_type") == "direct").cast("int")).alias("direct"))
    fresh = heat.where(F.col("date") >= F.date_sub(today, days)).select("keyword").distinct().withColumn("_f", F.lit(True))
    return pairs.join(fresh, "keyword", "left").agg(F.count("*").alias("active"), F.count_if("_f").alias("fresh"), F.count_if(F.col("direct") == 1).alias("direct"), F.count_if((F.col("direct") == 1) & F.col("_f")).alias("direct_fresh"))


#: What a status is worth.
POINTS = {"OK": 20, "WARN": 10, "FAIL": 0, "UNKNOWN": 10}
COMPONENTS = ("rss", "stocks", "bursts", "models", "etl")


#: What the lines of a block say for ``log_facts``, and the line and value of the last that says so.
_SAID = {"_status": ("history", "status"), "_s": ("history", "Success"), "_p": ("gemini", "Processed"), "_stopped": ("gemini", "Stopped")}


def log_runs(lines: DataFrame, etl: str, stocks: str) -> DataFrame:
    """One row for each run of both jobs: its start, exit code and success, and what the blocks of an update run say (see ``log_facts``).

    The same as ``logs.job_runs`` and ``logs.blocks``, in one pass: lines are dealt once, without
    their texts, by stretches of ``logs.BLOCK`` lines and summed there by run. What a stretch begins with may
    belong to a run or block of the stretches before: it is counted with the first of their summaries, in their order.
    """
    text = F.trim("value")
    parts = [F.regexp_extract(text, lg.RUN, k) for k in range(1, 6)]
    head = F.lit(None).cast("string")
    for name, whole, begins in lg.HEADS:
        is_head = text.isin(*whole)
        for x in begins:
            is_head = is_head | text.startswith(x)
        head = F.coalesce(head, F.when(is_head, name))
    is_pair = text.rlike(lg.KEY_VALUE) & ~text.startswith("[") & head.isNull()
    key = F.trim(F.regexp_extract(text, lg.KEY_VALUE, 1))
    wanted = [k for _, k in _SAID.values() if k != "status"]
    said = F.when(head.isNotNull(), text).when(is_pair & key.isin(*wanted), F.trim(F.regexp_extract(text, lg.KEY_VALUE, 2)))
    stamp = F.try_to_timestamp(F.concat_ws(" ", parts[0], F.lpad(parts[1], 8, "0")), F.lit("yyyy/MM/dd HH:mm:ss"))
    marked = F.col("value").contains(F.when(F.col("job") == etl, "Theme ETL completed").otherwise("筆行情"))
    rows = lines.where(F.col("job").isin(etl, stocks) & F.col("value").isNotNull()).select(
        "job", "line", F.nullif(parts[3], F.lit("")).alias("mark"), F.when(parts[3] == "start", stamp).alias("_start"), F.when(parts[3] == "exit", parts[4].try_cast("int")).alias("_code"),
        F.when(is_pair, F.lit(None)).otherwise(F.coalesce(head, F.lit(""))).alias("_head"), is_pair.alias("_pair"), F.when(is_pair & key.isin(*wanted), key).alias("_key"), said.alias("_said"), marked.alias("_m"), F.col("value").contains("Traceback").alias("_t"))
    by = ["job", "_block"]
    up_to = Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", F.floor(F.col("line") / lg.BLOCK))
    rows = rows.withColumn("_local", F.count(F.when(F.col("mark") == "start", 1)).over(up_to)).withColumn("_in", F.last("_head", ignorenulls=True).over(up_to))
    last = lambda when: F.max(F.when(when, F.struct("line", F.col("_said").alias("value"))))
    own = lambda block, key: (F.col("_in") == block) & (F.col("_head").isNotNull() if key == "status" else F.col("_key") == key)
    open_ = F.col("_in").isNull() & F.col("_pair")
    cut = rows.groupBy(*by, "_local").agg(
        F.max("_start").alias("started_at"), F.max(F.when(F.col("mark") == "exit", F.struct("line", F.col("_code").alias("value")))).alias("_exit"), F.bool_or("_m").alias("_m"), F.bool_or("_t").alias("_t"),
        *[last(own(*x)).alias(c) for c, x in _SAID.items()], *[last(open_ & (F.col("_key") == x[1])).alias(f"{c}_open") for c, x in _SAID.items() if x[1] != "status"],
        F.bool_or(F.col("_pair") & (F.col("_in") == "gemini")).alias("models_seen"), F.bool_or(open_).alias("_open"), F.max(F.when(F.col("_head").isNotNull(), F.struct("line", "_head")))["_head"].alias("_end"))
    cut = stage(cut, "cut")
    order = Window.partitionBy("job").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*by).agg(F.max("_local").alias("_starts"), F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_local"))).alias("_end"))
    ends = ends.select(*by, F.coalesce(F.sum("_starts").over(order), F.lit(0)).alias("_before"), F.last("_end", ignorenulls=True).over(order).alias("_enter"))
    met = cut.drop("_end").join(ends, by).withColumn("run", (F.col("_before") + F.col("_local")).cast("long")).where("run > 0")
    entered = lambda c, block: F.greatest(c, F.when(F.col("_enter") == block, F.col(f"{c}_open")))  # noqa: E731  the later line counts
    met = met.withColumns({c: entered(c, block) for c, (block, k) in _SAID.items() if k != "status"} | {"models_seen": F.coalesce("models_seen", F.lit(False)) | F.coalesce(F.col("_open") & (F.col("_enter") == "gemini"), F.lit(False))})
    out = met.groupBy("job", "run").agg(F.max("started_at").alias("started_at"), F.max("_exit")["value"].alias("exit_code"), F.bool_or("_m").alias("_m"), F.bool_or("_t").alias("_t"), *[F.max(c)["value"].alias(c) for c in _SAID], F.bool_or("models_seen").alias("models_seen"))
    codes = F.when(F.col("job") == etl, F.col("exit_code").isin(0, 3)).otherwise(F.col("exit_code") == 0)
    return out.withColumn("success", F.when(F.col("exit_code").isNotNull(), codes).otherwise(F.coalesce(F.col("_m") & ~F.col("_t"), F.lit(False)))).drop("_m", "_t")


def log_facts(lines: DataFrame, etl: str = "etl", stocks: str = "stock_collector") -> DataFrame:
    """One row of what the logs of both jobs say: last runs, their ends, and the blocks of the last update run."""
    runs = log_runs(lines, etl, stocks).withColumn("models_processed", lg.leading_number(F.col("_p")))
    at = lambda job, *when: F.when(F.lit(True) if not when else when[0], F.when(F.col("job") == job, F.col("run")))
    latest = lambda job, *when: F.max_by("started_at", at(job, *when))
    one = runs.agg(
        latest(etl, lg.leading_number(F.col("_s")) > 0).alias("heat_success"), latest(etl, F.col("models_processed") > 0).alias("models_success"), latest(etl, F.col("success")).alias("etl_success"), latest(stocks, F.col("success")).alias("stock_success"),
        F.max_by(F.struct("started_at", "exit_code", "success", "_status", "models_seen", "models_processed", "_stopped"), at(etl)).alias("e"), F.max_by(F.struct("exit_code"), at(stocks)).alias("k"))
    return one.select("heat_success", "models_success", F.col("e.started_at").alias("etl_started"), F.col("e.exit_code").alias("etl_exit"), F.col("e.success").alias("etl_ok"), "etl_success", F.col("k.exit_code").alias("stock_exit"), "stock_success", F.col("e._status").alias("history_status"), F.col("e.models_seen").alias("models_seen"), F.col("e.models_processed").alias("models_processed"), F.col("e._stopped").alias("models_stopped"))


def component_health(facts: DataFrame) -> DataFrame:
    """One row of facts to the status of five components, a score of 100 and its grade.

    Facts are those of ``log_facts`` and: now, rss_minutes, warnings, stock_day,
    heat_day, fresh, active, analyzed, total_news, stats_day. Times are local.
    """
    now = F.col("now")
    expected = expected_trading_day(now)
    day = F.to_date(now)
    ratio = F.coalesce(F.try_divide("fresh", "active"), F.lit(0.0))
    rss = F.when(F.col("rss_minutes").isNull(), "FAIL").when(F.col("rss_minutes") <= 30, F.when(F.col("warnings") > 0, "WARN").otherwise("OK")).when(F.col("rss_minutes") <= 120, "WARN").otherwise("FAIL")
    stock = F.when(F.col("stock_day").isNull() | (F.col("stock_exit") != 0), "FAIL").when(F.col("stock_day") >= expected, "OK").when(F.col("stock_day") >= previous_weekday(expected), "WARN").otherwise("FAIL")
    stopped = F.coalesce(F.col("history_status").startswith("Stopped"), F.lit(False))
    heat = F.when(F.col("heat_day").isNull() | (F.col("heat_day") < F.date_sub(day, 3)) | (ratio < 0.2), "FAIL").when((F.col("heat_day") >= F.date_sub(day, 1)) & (ratio >= 0.8) & ~stopped, "OK").otherwise("WARN")
    few = F.coalesce((F.col("total_news") > 0) & (F.col("analyzed") / F.col("total_news") < 0.5), F.lit(False))
    models = F.when(~F.coalesce("models_seen", F.lit(False)), "UNKNOWN").when(F.coalesce("models_stopped", F.lit("no")) == "no", F.when(few, "WARN").otherwise("OK")).when(F.col("models_processed") > 0, "WARN").otherwise("FAIL")
    old_stats = F.coalesce(F.col("stats_day") < F.date_sub(day, 1), F.lit(True))
    etl = F.when(F.col("etl_started").isNull() | (now - F.col("etl_started") > F.expr("interval 26 hours")), "FAIL").when(F.col("etl_ok"), F.when(old_stats, "WARN").otherwise("OK")).when(F.col("etl_exit").isNull(), "WARN").otherwise("FAIL")
    out = facts.withColumns(dict(zip(COMPONENTS, (rss, stock, heat, models, etl), strict=True)))
    worth = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    out = out.withColumn("score", sum((worth[F.col(c)] for c in COMPONENTS), F.lit(0)))
    return out.withColumn("grade", F.when(F.col("score") >= 90, "healthy").when(F.col("score") >= 60, "attention").otherwise("failing")).withColumn("failing", F.array_contains(F.array(*COMPONENTS), "FAIL"))


def volatility_at(events: DataFrame, table: DataFrame) -> DataFrame:
    """The ratio before and the level after of each event's market day; events meet their stock's days that have either as one map, by stock."""
    days = table.where("before is not null or after5 is not null").groupBy("stock_id").agg(F.map_from_entries(F.collect_list(F.struct("date", F.struct("before", "after5")))).alias("_days"))
    met = events.join(days, "stock_id", "left").withColumn("_v", F.try_element_at("_days", F.col("date")))
    return met.select("stock_id", "date", *[c for c in events.columns if c not in ("stock_id", "date")], "_v.before", "_v.after5")


def latest_ratio(table: DataFrame) -> DataFrame:
    return table.where("ratio is not null").groupBy("stock_id").agg(F.max_by("ratio", "date").alias("ratio"), F.max("date").alias("date"))


def top_keywords(heat: DataFrame, most: int = 5) -> DataFrame:
    """The keywords of a stock with the highest peak of heat."""
    peak = heat.groupBy("stock_id", "keyword").agg(F.max("heat").alias("peak"))
    order = Window.partitionBy("stock_id").orderBy(F.col("peak").desc(), "keyword")
    return peak.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
