"""Summaries, tests, correlations, matched comparisons and regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heedstream.functions.exprs import UNANALYZED, correlation_grade, event_label, metric_text, one_decimal, sentiment_form, traffic_number
from heedstream.operators.events import subtheme_heat
from heedstream.sources.shared import small, stage

HORIZONS = (1, 3, 5, 10)
# The words of verdicts (G4) and the sentences of the summaries (G5), which results must repeat to the letter.
HOLDS, PARTLY, FAILS, TOO_FEW = "成立", "部分成立", "不成立", "資料不足"
CONCLUSIONS = {
    "none": "目前資料不足，無法穩定判斷事件與股價後續關聯。",
    "up": "熱門事件與股價存在輕度正向關聯，事件後 10 日平均表現呈現正值。",
    "down": "熱門事件在本期間內未呈現明顯正向關聯，後續股價反應偏弱或負向。",
    "flat": "熱門事件在本期間內的價格反應接近中性，表示事件影響較弱。",
}
OVERVIEW = {"title": "事件研究", "period": "研究期間：", "count": "事件數量：", "positive": "正報酬事件：", "negative": "負報酬事件：", "reaction": "平均首次反應天數：", "days": " 天", "mean": "平均{n}日報酬：", "conclusion": "AI結論："}
EVENT = {
    "at": "事件於", "unknown": "未知日期", "happened": "發生。", "no_move": "事件後3日股價變化資料尚不足。", "move": "事件後3日股價累積", "rise": "上漲", "fall": "下跌", "stop": "。",
    "same_day": "事件當天突破MA{n}。", "after": "事件後第", "crossed": "日突破MA{n}。", "above": "事件後已突破MA{n}。", "never": "事件後未出現 MA{n} 突破訊號。",
}


def t_stat(c: str, least: int = 2) -> Column:
    """Mean over its standard error; null for few values or no spread."""
    sd = F.stddev_samp(c)
    return F.when((F.count(c) >= least) & (sd >= 1e-12), F.try_divide(F.avg(c), sd / F.sqrt(F.count(c))))


def normal_p(t: Column) -> Column:
    """Two-sided normal p of a t value: erfc(|t| / sqrt 2) by a series in built-in functions.

    For |t| < 4 the error function's power series, beyond it the continued
    fraction; both to about 1e-12.
    """
    z = F.abs(t) / F.sqrt(F.lit(2.0))
    small = F.least(z, F.lit(4.0))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(small.alias("term"), small.alias("sum")), lambda a, k: F.struct((-a["term"] * small * small / k).alias("term"), (a["sum"] + -a["term"] * small * small / k / (2 * k + 1)).alias("sum")))["sum"]
    low = 1 - 2 / F.sqrt(F.lit(np.pi)) * series
    big = F.greatest(z, F.lit(2.5))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), big, lambda a, k: big + k / 2.0 / a)
    high = F.exp(-big * big) / F.sqrt(F.lit(np.pi)) / fraction
    return F.when(z < 2.8, low).otherwise(high)


def holding_summary(performance: DataFrame, prefix: str = "return") -> DataFrame:
    """G1: count, mean, win rate, best and worst in percent for each holding period."""
    long = performance.select(F.explode(F.array(*[F.struct(F.lit(n).alias("holding_days"), F.col(f"{prefix}_{n}d").alias("r")) for n in HORIZONS])).alias("x")).select("x.*").where("r is not null")
    return long.groupBy("holding_days").agg(F.count("*").alias("events"), (F.avg("r") * 100).alias("mean_pct"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_rate_pct"), (F.max("r") * 100).alias("max_gain_pct"), (F.min("r") * 100).alias("max_loss_pct"))


def research_summary(performance: DataFrame, keys: list[str]) -> DataFrame:
    """Shares, reaction, best and worst event, mean returns; ``performance`` has normal_10d joined."""
    label = event_label(F.col("keyword"), F.col("date"))
    ten = F.col("return_10d")
    reaction = F.when(F.col("reaction_days").between(0, 30), F.col("reaction_days"))
    order = lambda sign: F.struct((sign * ten).alias("r"), F.col("date"), F.col("keyword"))
    return performance.groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        (F.avg((ten > 0).cast("double")) * 100).alias("positive_pct"), (F.avg((ten < 0).cast("double")) * 100).alias("negative_pct"),
        F.avg(reaction).alias("avg_reaction_days"),
        F.min_by(F.when(ten.isNotNull(), label), F.when(ten.isNotNull(), order(-1))).alias("best_event"),
        F.min_by(F.when(ten.isNotNull(), label), F.when(ten.isNotNull(), order(1))).alias("worst_event"),
        *[(F.avg(f"return_{n}d") * 100).alias(f"avg_return_{n}d_pct") for n in HORIZONS],
        *[(F.avg(f"excess_{n}d") * 100).alias(f"avg_excess_{n}d_pct") for n in (5, 10)],
        (F.avg(F.col("excess_10d") - F.col("normal_10d")) * 100).alias("avg_abnormal_10d_pct"),
    )


def hypotheses(performance: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Verdicts on rising returns (H1) and on positive against negative news (H2)."""
    rows = performance.withColumn("abnormal", F.col("excess_10d") - F.col("normal_10d")).withColumn("tone", sentiment_form(F.col("news_sentiment")))
    out = rows.groupBy(*keys).agg(
        F.count("abnormal").alias("n"), F.avg("abnormal").alias("mean"), t_stat("abnormal").alias("t"),
        F.count_if(F.col("tone") == "Positive").alias("n_pos"), F.count_if(F.col("tone") == "Negative").alias("n_neg"),
        F.avg(F.when(F.col("tone") == "Positive", F.col("excess_10d"))).alias("pos_mean"), F.avg(F.when(F.col("tone") == "Negative", F.col("excess_10d"))).alias("neg_mean"),
    )
    h1 = F.when(F.col("n") < least, TOO_FEW).when((F.col("mean") > 0) & (F.col("t") >= 2), HOLDS).when((F.col("mean") > 0) & (F.col("t") >= 1), PARTLY).otherwise(FAILS)
    few = ((F.col("n_pos") < 5) & (F.col("n_neg") < 5)) | F.col("pos_mean").isNull() | F.col("neg_mean").isNull()
    h2 = F.when(few, TOO_FEW).when(F.col("pos_mean") > F.col("neg_mean"), HOLDS).otherwise(FAILS)
    return out.withColumn("h1", h1).withColumn("h2", h2)


def reaction_by_theme(performance: DataFrame) -> DataFrame:
    """Mean first reaction of each theme, fastest first."""
    return performance.where(F.col("reaction_days").between(0, 30)).groupBy("theme_name").agg(F.avg("reaction_days").alias("days")).orderBy("days", "theme_name")


def overview_text(summary: DataFrame, theme: str, start: Column, end: Column) -> DataFrame:
    """The overview of a theme's summary row as text."""
    ten = F.col("avg_return_10d_pct")
    name = F.col(theme)
    about = lambda k: F.concat(name, F.lit(CONCLUSIONS[k]))
    conclusion = F.when(ten.isNull(), CONCLUSIONS["none"]).when(ten > 0, about("up")).when(ten < 0, about("down")).otherwise(about("flat"))
    o = {k: F.lit(v) for k, v in OVERVIEW.items()}
    lines = [
        F.concat(name, o["title"]), F.concat(o["period"], start, F.lit(" ~ "), end), F.concat(o["count"], F.col("event_count").cast("string")),
        F.concat(o["positive"], metric_text(F.col("positive_pct"), "%")), F.concat(o["negative"], metric_text(F.col("negative_pct"), "%")), F.concat(o["reaction"], metric_text(F.col("avg_reaction_days"), OVERVIEW["days"])),
        *[F.concat(F.lit(OVERVIEW["mean"].format(n=n)), metric_text(F.col(f"avg_return_{n}d_pct"), "%")) for n in HORIZONS],
    ]
    return summary.select(theme, F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), o["conclusion"], conclusion).alias("overview"))


def event_text(performance: DataFrame) -> DataFrame:
    """One sentence for each event: day, three-day move and breakouts."""
    e = {k: F.lit(v) for k, v in EVENT.items()}
    move = F.when(F.col("return_3d").isNull(), e["no_move"]).otherwise(F.concat(e["move"], F.when(F.col("return_3d") > 0, e["rise"]).otherwise(e["fall"]), one_decimal(F.abs(F.col("return_3d") * 100)), F.lit("%")))

    def cross(n: int) -> Column:
        day = F.col(f"ma{n}_breakout_day")
        say = lambda k: F.lit(EVENT[k].format(n=n))
        return F.when(day == 0, say("same_day")).when(day.isNotNull(), F.concat(e["after"], day.cast("string"), say("crossed"))).when(F.col(f"ma{n}").isNotNull(), say("above")).otherwise(say("never"))

    return performance.withColumn("text", F.concat(F.col("keyword"), e["at"], F.coalesce(F.date_format("date", "yyyy-MM-dd"), e["unknown"]), e["happened"], move, e["stop"], cross(20), cross(60)))


def excess_table(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units (keys, n, excess, normal), one for each stock or basket and day 0: means of what is known, difference, t, p, share up and number of differences."""
    out = units.withColumn("d", F.col("excess") - F.col("normal")).groupBy(*keys).agg(
        F.avg("excess").alias("event_mean"), F.avg("normal").alias("normal_mean"), F.avg("d").alias("excess_over_normal"), t_stat("d", 3).alias("t"),
        F.avg(F.when(F.col("excess").isNotNull(), (F.col("excess") > 0).cast("double"))).alias("share_up"), F.count("d").alias("units"))
    return out.withColumn("p", normal_p(F.col("t")))


def tone_split(units: DataFrame, least: int = 3) -> DataFrame:
    """Units (kind, tone, q as in ``study_units``): mean excess over normal after 5 and 10 days by kind and sign of the tone, and its t."""
    d = lambda n: F.filter("q", lambda x: x["n"] == n)[0]
    rows = units.select("kind", F.signum("tone").cast("int").alias("tone"), *[(d(n)["excess"] - d(n)["normal"]).alias(f"d{n}") for n in (5, 10)])
    out = rows.groupBy("kind", "tone").agg(F.count("*").alias("n"), *[x for n in (5, 10) for x in (F.avg(f"d{n}").alias(f"mean_{n}"), t_stat(f"d{n}", 3).alias(f"t_{n}"))])
    return out.where(F.col("n") >= least)


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null without spread."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def heat_price(heat: DataFrame, returns: DataFrame, pairs: DataFrame, least: int = 5) -> DataFrame:
    """Same-day correlation of heat (keyword, date, heat) and returns (stock_id, date, r), of the given pairs (stock_id, keyword)."""
    own = returns.join(pairs, "stock_id").join(heat, ["keyword", "date"])
    met = own.where("heat is not null and r is not null")
    return met.groupBy("stock_id", "keyword").agg(F.count("*").alias("n"), correlation("heat", "r").alias("r")).where(F.col("n") >= least)


def _best_lags(heat: DataFrame, returns: DataFrame, pairs: DataFrame, least: int, lags: int) -> DataFrame:
    """(stock_id, keyword, best_lag, r, n, same_day) of pairs that have a lag with ``least`` days.

    Lags are trading rows of the stock, whether or not there was heat on them:
    the returns around a row are windows over the stock's rows, taken before
    heat is joined by date.
    """
    by = Window.partitionBy("stock_id").orderBy("date")
    at = lambda k: F.lead("r", k).over(by) if k > 0 else F.lag("r", -k).over(by) if k < 0 else F.col("r")
    around = returns.select("stock_id", "date", "r", *[at(k).alias(f"_r{k + lags}") for k in range(-lags, lags + 1)])
    around = around.select("stock_id", "date", F.array(*[f"_r{k}" for k in range(2 * lags + 1)]).alias("_r"))
    # heat has a row a keyword and day: broadcast behind a count, the rows around every day of every pair stay where the windows by stock have them
    met = around.join(pairs.select("stock_id", "keyword").distinct(), "stock_id").join(small(heat.where("heat is not null")), ["keyword", "date"])
    # one row a lag meets the aggregation, which sums within each task first: 21 lags of sums in one row are too much code to compile
    each = met.select("stock_id", "keyword", "heat", F.posexplode("_r").alias("lag", "r")).where("r is not null")
    each = each.groupBy("stock_id", "keyword", "lag").agg(F.count("*").alias("n"), correlation("heat", "r").alias("c"))
    each = each.where((F.col("n") >= least) & F.col("c").isNotNull()).withColumn("lag", F.col("lag") - lags)
    best = each.groupBy("stock_id", "keyword").agg(F.min_by(F.struct("lag", "c", "n"), F.struct(-F.abs("c"), F.abs("lag"), F.col("lag"))).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("same_day"))
    return best.select("stock_id", "keyword", F.col("b.lag").alias("best_lag"), F.col("b.c").alias("r"), F.col("b.n").alias("n"), "same_day")


def cross_correlation(heat: DataFrame, returns: DataFrame, pairs: DataFrame, least: int = 30, lags: int = 10) -> DataFrame:
    """For each pair (stock_id, keyword) the lag in -lags..lags of greatest |r|, ties to the nearer and then the smaller lag.

    ``returns`` (stock_id, date, r) has a row for every trading row of a stock.
    Heat of a row meets the return ``lag`` rows later. A pair without a lag
    of ``least`` days and a coefficient has a null lag and n = 0.
    """
    best = _best_lags(heat, returns, pairs, least, lags).drop("same_day")
    return pairs.select("stock_id", "keyword").distinct().join(best, ["stock_id", "keyword"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def theme_cross(daily_heat: DataFrame, returns: DataFrame, mapping: DataFrame, least: int = 30, lags: int = 10) -> DataFrame:
    """G11 of sub-themes and their stocks, with the same-day coefficient and a grade of confidence.

    ``daily_heat`` (keyword, date, heat) becomes the sub-themes' mean heat
    (E2); ``mapping`` (sub_theme, keyword, stock_id, active) names keywords and
    the pairs. Pairs without a lag of ``least`` days are left out.
    """
    heat = subtheme_heat(daily_heat, mapping).select(F.col("sub_theme").alias("keyword"), "date", "heat")
    pairs = mapping.where("active = 1 and trim(stock_id) <> '' and sub_theme is not null").select("stock_id", F.col("sub_theme").alias("keyword")).distinct()
    out = _best_lags(heat, returns, pairs, least, lags).withColumnRenamed("keyword", "sub_theme")
    return out.withColumn("grade", correlation_grade(F.col("r"), F.col("n")))


def sentiment_shares(news: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shares over analysed news, coverage, and a flag below a fifth."""
    tone = sentiment_form(F.col("news_sentiment"))
    rows = news.withColumn("_tone", tone)
    analyzed = F.count_if(F.col("_tone") != UNANALYZED)
    out = rows.groupBy(*(keys or [])).agg(F.count("*").alias("total"), analyzed.alias("analyzed"), F.count_if(F.col("_tone") == UNANALYZED).alias("unanalyzed"), *[F.count_if(F.col("_tone") == t).alias(f"{t.lower()}_n") for t in ("Positive", "Neutral", "Negative")])
    for t in ("positive", "neutral", "negative"):
        out = out.withColumn(f"{t}_pct", F.try_divide(F.col(f"{t}_n") * 100.0, F.col("analyzed")))
    out = out.withColumn("coverage_pct", F.try_divide(F.col("analyzed") * 100.0, F.col("total")))
    return out.withColumn("low_coverage", F.coalesce(F.col("coverage_pct") < 20, F.lit(False)))


def modal_share(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Share of the most frequent value of a column."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias(f"{column}_modal_share"))


def quality_check(performance: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of sentiments and their coverage, valid reaction days, and warnings: one breakout day of more than 35 %, more than 80 % neutral news. Without rows there is nothing to warn of."""
    out = sentiment_shares(news, keys)
    valid = performance.groupBy(*keys).agg((F.avg(F.when(F.col("reaction_days").isNotNull(), F.col("reaction_days").between(0, 30).cast("double"))) * 100).alias("reaction_days_valid_pct"))
    out = out.join(valid, keys, "full")
    for n in (20, 60):
        out = out.join(modal_share(performance, f"ma{n}_breakout_day", keys).withColumnRenamed(f"ma{n}_breakout_day_modal_share", f"ma{n}_share"), keys, "left")
        out = out.withColumn(f"ma{n}_warning", F.coalesce(F.col(f"ma{n}_share") > 0.35, F.lit(False)))
    warned = F.coalesce((F.col("analyzed") > 0) & (F.col("neutral_pct") > 80), F.lit(False))
    return out.withColumns({"reaction_days_valid_pct": F.coalesce("reaction_days_valid_pct", F.lit(100.0)), "sentiment_warning": warned})


def signal_scores(events: DataFrame) -> DataFrame:
    """Events (event_id, stock_id, date, approx_traffic, volume_change, news_sentiment, future_return_5d).

    The percent rank with average ties comes from a histogram of traffic
    values, so no row order of all events is built.
    """
    rows = events.withColumn("_t", traffic_number(F.col("approx_traffic")))
    counts = rows.groupBy("_t").agg(F.count("*").alias("_c"))
    ranks = _percent_ranks(counts)
    # traffic takes few values: a broadcast behind a check of their number spares a popular value from being one task
    heat = rows.join(small(ranks), "_t").withColumn("_heat", F.col("_rank") * 100)
    volume = (F.greatest(F.lit(-1.0), F.least(F.lit(3.0), F.coalesce("volume_change", F.lit(0.0)))) + 1) / 4 * 100
    tone = F.when(F.col("news_sentiment") == "Positive", 100.0).when(F.col("news_sentiment") == "Negative", 0.0).otherwise(50.0)
    before = Window.partitionBy("stock_id").orderBy("date", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    won = F.when(F.col("future_return_5d").isNotNull(), (F.col("future_return_5d") > 0).cast("double"))
    win = F.coalesce(F.avg(won).over(before), F.lit(0.5)) * 100
    score = F.bround(F.col("_heat") * 0.35 + volume * 0.25 + tone * 0.15 + F.col("_win") * 0.25, 1)
    out = heat.withColumn("_win", win).withColumn("signal_score", score)
    return out.withColumn("signal", F.when(F.col("signal_score") < 40, "🟢 可觀察").when(F.col("signal_score") < 70, "🟡 已反應").otherwise("🔴 過熱")).withColumn("historical_win_rate", F.col("_win")).drop("_t", "_c", "_rank", "_heat", "_win")


def _placed(counts: DataFrame) -> DataFrame:
    """(_t, _c) with _before, the rows of lesser values, and _all; summed in value ranges, then within a range."""
    size = F.log2(F.abs("_t") + F.lit(2.0**-20)) + 20
    ranged = counts.withColumn("_band", F.floor(F.signum("_t") * size * 32))
    bands = ranged.groupBy("_band").agg(F.sum("_c").alias("_m"))
    line = Window.orderBy("_band")
    bands = bands.withColumn("_less", F.coalesce(F.sum("_m").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_m").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = Window.partitionBy("_band").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(bands.select("_band", "_less", "_all")), "_band")
    return joined.select("_t", "_c", (F.col("_less") + F.coalesce(F.sum("_c").over(inside), F.lit(0))).alias("_before"), "_all")


def _percent_ranks(counts: DataFrame) -> DataFrame:
    """(_t, _c) to (_t, _rank), average ranks over all rows."""
    return _placed(counts).select("_t", ((F.col("_before") + (F.col("_c") + 1) / 2) / F.col("_all")).alias("_rank"))


def decile_edges(rows: DataFrame, column: str) -> DataFrame:
    """Distinct exact decile edges of a column, one row (edges).

    The values on both sides of each decile come from counts of the values
    and their running sums in value ranges; no task holds all values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_t")).agg(F.count("*").alias("_c"))
    place = lambda k: (F.col("_all") - 1) * k / 10
    holds = lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_c"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), f(place(k)).alias("at"), (place(k) - F.floor(place(k))).alias("share")) for k in range(11) for side, f in ((0, F.floor), (1, F.ceil))])
    found = _placed(counts).select("_t", F.explode(F.filter(wanted, lambda w: holds(w["at"]))).alias("w"))
    edge = found.groupBy("w.k").agg(F.max(F.when(F.col("w.side") == 0, F.col("_t"))).alias("lo"), F.max(F.when(F.col("w.side") == 1, F.col("_t"))).alias("hi"), F.max("w.share").alias("share"))
    edge = edge.select((F.col("lo") * (1 - F.col("share")) + F.col("hi") * F.col("share")).alias("e"))
    return edge.agg(F.sort_array(F.collect_set("e")).alias("edges"))


def deciles(rows: DataFrame, column: str) -> DataFrame:
    """Bucket 0.. of each row, right-closed, the lowest value included."""
    edges = decile_edges(rows, column)
    inner = F.filter(F.col("edges"), lambda e, i: (i > 0) & (e < F.col(column)))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(inner)).drop("edges")


def matched(panel: DataFrame, flag: str, columns: tuple[str, ...] = ("future5", "future10")) -> DataFrame:
    """Event rows against the mean of event-free rows in the same bucket."""
    controls = panel.where("not near_event").groupBy("bucket").agg(*[F.avg(c).alias(f"{c}_control") for c in ("today", *columns)], F.avg(F.col("big5").cast("double")).alias("big5_control"))
    hits = panel.where(flag).join(F.broadcast(controls), "bucket")
    for c in columns:
        hits = hits.withColumn(f"{c}_diff", F.col(c) - F.col(f"{c}_control"))
    return hits.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in ("today", *columns)], *[F.avg(f"{c}_control").alias(f"{c}_control_mean") for c in ("today", *columns)], *[F.avg(f"{c}_diff").alias(f"{c}_diff_mean") for c in columns], *[t_stat(f"{c}_diff").alias(f"{c}_t") for c in columns], F.avg(F.col("big5").cast("double")).alias("big5_share"), F.avg("big5_control").alias("big5_control_share"))


def clustered_ols(rows: DataFrame, y: str, x: list[str], cluster: str) -> DataFrame:
    """Least squares with a constant and standard errors clustered by ``cluster``.

    One pass over the rows sums XtX and Xty by cluster; totals and the
    clusters' scores come from that table, and only k x k sums reach the
    driver, k being the number of columns. Errors and t are null where there
    is only one cluster, or no more rows than columns.
    """
    names = ["const", *x]
    k = len(names)
    clean = rows.select(F.col(cluster).alias("_g"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(x)]).dropna()
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    by = stage(clean.groupBy("_g").agg(F.count("*").alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in cells], *[F.sum(F.col(f"x{i}") * F.col("_y")).alias(f"b{i}") for i in range(k)]), "clusters")
    sums = by.agg(F.sum("n").alias("n"), F.count("*").alias("g"), *[F.sum(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in cells], *[F.sum(f"b{i}").alias(f"b{i}") for i in range(k)]).first()
    if not sums["g"]:
        return rows.sparkSession.createDataFrame([], "term string, beta double, se double, t double, n long, clusters long")
    square = lambda row, name: np.array([[row[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.inv(square(sums, "a"))
    beta = inverse @ np.array([sums[f"b{i}"] for i in range(k)])
    score = lambda i: F.col(f"b{i}") - sum((F.col(f"a{min(i, j)}_{max(i, j)}") * float(beta[j]) for j in range(1, k)), F.col(f"a0_{i}") * float(beta[0]))
    scores = by.select(*[score(i).alias(f"s{i}") for i in range(k)])
    meat = square(scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in cells]).first(), "m")
    n, g = sums["n"], sums["g"]
    enough = g > 1 and n > k
    se = np.sqrt(np.diag(inverse @ meat @ inverse) * (g / (g - 1) * (n - 1) / (n - k))) if enough else [None] * k
    return rows.sparkSession.createDataFrame([(names[i], float(beta[i]), float(se[i]) if enough else None, float(beta[i] / se[i]) if enough and se[i] else None, n, g) for i in range(k)], "term string, beta double, se double, t double, n long, clusters long")


def event_profile(panel: DataFrame, every: DataFrame, flag: str, sample: Column, most: int = 400, before: int = 5, after: int = 20) -> DataFrame:
    """Mean path of event rows and of a bounded number of event-free rows of each bucket, weighted by the events' buckets.

    Rows are those of ``panel``; the values around them come from ``every``,
    which has all calendar days of a stock, numbered from 1. Windows that the calendar cuts off don't count, in the paths;
    the weights count all events.
    """
    # a stock's values in calendar order, one array a stock, which the calendar bounds: rows meet it by stock, no window of any day is shuffled
    lines = every.groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("day", "today"))).alias("_line"))
    lines = lines.select("stock_id", F.transform("_line", lambda x: x["today"]).alias("_line"), F.element_at("_line", -1)["day"].alias("_last"))
    hits = panel.where(flag).select("stock_id", "day", "bucket", F.lit(True).alias("_hit"))
    pool = panel.where("not near_event").withColumn("_k", F.row_number().over(Window.partitionBy("bucket").orderBy(sample, "stock_id", "day"))).where(F.col("_k") <= most)
    rows = stage(hits.union(pool.select("stock_id", "day", "bucket", F.lit(False))), "chosen")
    weights = rows.where("_hit").groupBy("bucket").agg(F.count("*").alias("w"))
    total = rows.where("_hit").agg(F.count("*").alias("_all"))
    size = before + after + 1
    paths = rows.join(lines, "stock_id").where((F.col("day") - before >= 1) & (F.col("day") + after <= F.col("_last")))
    paths = paths.select("_hit", "bucket", F.slice("_line", F.col("day") - before, size).alias("_v"))
    sums = stage(paths.groupBy("_hit", "bucket").agg(F.count("*").alias("n"), F.array(*[F.struct(F.sum(F.col("_v")[k]).alias("s"), F.count(F.col("_v")[k]).alias("c")) for k in range(size)]).alias("v")).select("_hit", "bucket", "n", F.posexplode("v").alias("k", "v")), "profile")
    own = sums.where("_hit").groupBy("k").agg(F.try_divide(F.sum("v.s"), F.sum("v.c")).alias("event"), F.sum("n").alias("n"))
    control = sums.where("not _hit").join(F.broadcast(weights), "bucket").crossJoin(F.broadcast(total))
    control = control.groupBy("k").agg(F.sum(F.try_divide("v.s", "v.c") * F.col("w") / F.col("_all")).alias("control"))
    return own.join(control, "k", "left").select((F.col("k") - before).alias("offset"), "event", "n", "control")


def component_report(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and t of the four event components."""
    return parts.groupBy(*keys).agg(F.count("*").alias("n"), *[e for c in ("pre", "day0_ar", "post5", "post10") for e in (F.avg(c).alias(f"{c}_mean"), t_stat(c, 3).alias(f"{c}_t"))])
