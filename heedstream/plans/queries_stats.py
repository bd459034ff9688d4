"""Registered queries: summaries, tests, correlations, coverage and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedstream.functions import exprs as ex
from heedstream.operators import coverage as cv
from heedstream.operators import returns as rt
from heedstream.operators import stats as st
from heedstream.plans import frames as fr
from heedstream.plans import queries_returns as qr
from heedstream.plans._book import Book, r6, rounded
from heedstream.sources import adapters as ad
from heedstream.sources.shared import stage

book = Book()
CLASS, classes = ad.CLASS, ad.classes
NOW = "timestamp '1998-08-03 20:00:00'"


def now():  # noqa: ANN201
    return F.expr(NOW)


LABEL = "keyword || '（' || strftime(date, '%Y-%m-%d') || '）'"
SUMMARY = f"""sm AS (SELECT theme_name, count(*) AS event_count, avg(CASE WHEN return_10d > 0 THEN 1.0 WHEN return_10d IS NOT NULL THEN 0.0 END) * 100 AS positive_pct, avg(CASE WHEN return_10d < 0 THEN 1.0 WHEN return_10d IS NOT NULL THEN 0.0 END) * 100 AS negative_pct,
  avg(CASE WHEN reaction_days BETWEEN 0 AND 30 THEN reaction_days END) AS avg_reaction_days, {', '.join(f'avg(return_{n}d) * 100 AS avg_return_{n}d_pct' for n in (1, 3, 5, 10))}, avg(excess_5d) * 100 AS avg_excess_5d_pct, avg(excess_10d) * 100 AS avg_excess_10d_pct, avg(excess_10d - normal_10d) * 100 AS avg_abnormal_10d_pct
  FROM events_perf WHERE link_type = 'direct' GROUP BY 1),
best AS (SELECT theme_name, {LABEL} AS best_event FROM (SELECT *, row_number() OVER (PARTITION BY theme_name ORDER BY -return_10d, date, keyword) AS k FROM events_perf WHERE link_type = 'direct' AND return_10d IS NOT NULL) WHERE k = 1),
worst AS (SELECT theme_name, {LABEL} AS worst_event FROM (SELECT *, row_number() OVER (PARTITION BY theme_name ORDER BY return_10d, date, keyword) AS k FROM events_perf WHERE link_type = 'direct' AND return_10d IS NOT NULL) WHERE k = 1)"""
NUMBERS = ["positive_pct", "negative_pct", "avg_reaction_days", "avg_return_1d_pct", "avg_return_3d_pct", "avg_return_5d_pct", "avg_return_10d_pct", "avg_excess_5d_pct", "avg_excess_10d_pct", "avg_abnormal_10d_pct"]


@book.add(ad.sql(fr.ALL, f"{fr.BASE_SQL}, {SUMMARY} SELECT theme_name, event_count, {', '.join(map(r6, NUMBERS))}, best_event, worst_event FROM sm LEFT JOIN best USING (theme_name) LEFT JOIN worst USING (theme_name)"))
def g2_research_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.research_summary(fr.performance(s, d), ["theme_name"]), *NUMBERS)


H = """h AS (SELECT theme_name, count(excess_10d - normal_10d) AS n, avg(excess_10d - normal_10d) AS mean, avg(excess_10d - normal_10d) / (stddev_samp(excess_10d - normal_10d) / sqrt(count(excess_10d - normal_10d))) AS t,
  count(*) FILTER (news_sentiment = 'Positive') AS n_pos, count(*) FILTER (news_sentiment = 'Negative') AS n_neg, avg(excess_10d) FILTER (news_sentiment = 'Positive') AS pos_mean, avg(excess_10d) FILTER (news_sentiment = 'Negative') AS neg_mean FROM events_perf WHERE link_type = 'direct' GROUP BY 1)"""


@book.add(ad.sql(fr.ALL, f"""{fr.BASE_SQL}, {H} SELECT theme_name, n, {r6('mean')}, {r6('t')}, n_pos, n_neg, {r6('pos_mean')}, {r6('neg_mean')},
CASE WHEN n < 10 THEN '資料不足' WHEN mean > 0 AND t >= 2 THEN '成立' WHEN mean > 0 AND t >= 1 THEN '部分成立' ELSE '不成立' END AS h1,
CASE WHEN n_pos < 5 AND n_neg < 5 THEN '資料不足' WHEN pos_mean IS NULL OR neg_mean IS NULL THEN '資料不足' WHEN pos_mean > neg_mean THEN '成立' ELSE '不成立' END AS h2 FROM h"""))
def g4_hypotheses(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.hypotheses(fr.performance(s, d), ["theme_name"]), "mean", "t", "pos_mean", "neg_mean")


@book.add(ad.sql(fr.ALL, f"{fr.BASE_SQL} SELECT theme_name, {r6('avg(reaction_days)', 'days')} FROM events_perf WHERE link_type = 'direct' AND reaction_days BETWEEN 0 AND 30 GROUP BY 1"))
def g4_reaction_by_theme(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.reaction_by_theme(fr.performance(s, d)), "days")


PCT = "CASE WHEN {c} IS NULL THEN '資料不足' ELSE printf('%.1f', {c}) || '{s}' END"
MEANS = " || chr(10) || ".join(f"'平均{n}日報酬：' || " + PCT.format(c=f"avg_return_{n}d_pct", s="%") for n in (1, 3, 5, 10))


@book.add(ad.sql(fr.ALL, f"""{fr.BASE_SQL}, {SUMMARY} SELECT theme_name, theme_name || '事件研究' || chr(10) || '研究期間：1995-01-01 ~ 1998-08-02' || chr(10) || '事件數量：' || event_count || chr(10) || '正報酬事件：' || {PCT.format(c='positive_pct', s='%')} || chr(10) || '負報酬事件：' || {PCT.format(c='negative_pct', s='%')} || chr(10) || '平均首次反應天數：' || {PCT.format(c='avg_reaction_days', s=' 天')} || chr(10) || {MEANS} || chr(10) || chr(10) || 'AI結論：' ||
CASE WHEN avg_return_10d_pct IS NULL THEN '目前資料不足，無法穩定判斷事件與股價後續關聯。' WHEN avg_return_10d_pct > 0 THEN theme_name || '熱門事件與股價存在輕度正向關聯，事件後 10 日平均表現呈現正值。' WHEN avg_return_10d_pct < 0 THEN theme_name || '熱門事件在本期間內未呈現明顯正向關聯，後續股價反應偏弱或負向。' ELSE theme_name || '熱門事件在本期間內的價格反應接近中性，表示事件影響較弱。' END AS overview FROM sm"""))
def g5_overview_text(s: SparkSession, d: str) -> DataFrame:
    return st.overview_text(st.research_summary(fr.performance(s, d), ["theme_name"]), "theme_name", F.lit("1995-01-01"), F.lit("1998-08-02"))


CROSSING = " || ".join(f"CASE WHEN ma{n}_breakout_day = 0 THEN '事件當天突破MA{n}。' WHEN ma{n}_breakout_day IS NOT NULL THEN '事件後第' || ma{n}_breakout_day || '日突破MA{n}。' WHEN ma{n} IS NOT NULL THEN '事件後已突破MA{n}。' ELSE '事件後未出現 MA{n} 突破訊號。' END" for n in (20, 60))


@book.add(ad.sql(fr.ALL, f"""{fr.BASE_SQL} SELECT keyword, stock_id, date, keyword || '事件於' || strftime(date, '%Y-%m-%d') || '發生。' || CASE WHEN return_3d IS NULL THEN '事件後3日股價變化資料尚不足。' ELSE '事件後3日股價累積' || CASE WHEN return_3d > 0 THEN '上漲' ELSE '下跌' END || printf('%.1f', abs(return_3d * 100)) || '%' END || '。' || {CROSSING} AS text FROM events_perf WHERE link_type = 'direct'"""))
def g5_event_text(s: SparkSession, d: str) -> DataFrame:
    return st.event_text(fr.performance(s, d)).select("keyword", "stock_id", "date", "text")


XT = "CASE WHEN count({c}) >= 3 AND stddev_samp({c}) >= 1e-12 THEN avg({c}) / (stddev_samp({c}) / sqrt(count({c}))) END"


#: Forward abnormal returns and normal levels of units; needs UNITS.
STUDY = f"""{qr.UNITS}, {qr.SPINE}, fa AS (SELECT stock_id, date, day, {', '.join(f"lead(price, {n}) OVER w / price - lead(b, {n}) OVER w / b AS ar{n}" for n in (1, 3, 5, 10))} FROM sp WINDOW w AS (PARTITION BY stock_id ORDER BY day)),
per AS (SELECT * FROM fa WHERE date >= DATE '{fr.STUDY_START}'), sb AS (SELECT stock_id, {', '.join(f"avg(ar{n}) AS base{n}" for n in (1, 3, 5, 10))} FROM per GROUP BY 1),
bk AS (SELECT DISTINCT unit, stock_id FROM fp WHERE kind = 'theme'), bd AS (SELECT unit, day, {', '.join(f"avg(ar{n}) AS ar{n}" for n in (1, 3, 5, 10))} FROM bk JOIN per USING (stock_id) GROUP BY 1, 2), tb AS (SELECT unit, {', '.join(f"avg(ar{n}) AS base{n}" for n in (1, 3, 5, 10))} FROM bd GROUP BY 1),
su AS (SELECT kind, unit, tone, ar1, ar3, ar5, ar10, base1, base3, base5, base10 FROM fp JOIN fa USING (stock_id, day) JOIN sb USING (stock_id) WHERE kind = 'direct'
  UNION ALL SELECT 'theme', t.*, base1, base3, base5, base10 FROM (SELECT unit, tone, ar1, ar3, ar5, ar10 FROM (SELECT unit, day, sum(tone) AS tone, avg(ar1) AS ar1, avg(ar3) AS ar3, avg(ar5) AS ar5, avg(ar10) AS ar10 FROM fp JOIN fa USING (stock_id, day) WHERE kind = 'theme' GROUP BY 1, 2)) t JOIN tb USING (unit))"""


@book.add(ad.sql(fr.ALL, f"""{STUDY}, v AS ({' UNION ALL '.join(f"SELECT kind, {n} AS n, ar{n} AS x, base{n} AS m, ar{n} - base{n} AS dd FROM su" for n in (1, 3, 5, 10))})
SELECT kind, n, {r6('avg(x)', 'event_mean')}, {r6('avg(m)', 'normal_mean')}, {r6('avg(dd)', 'excess_over_normal')}, {r6(XT.format(c='dd'), 't')}, {r6('avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END)', 'share_up')}, count(dd) AS units FROM v GROUP BY 1, 2"""))
def g6_excess_table(s: SparkSession, d: str) -> DataFrame:
    """By kind and window, one observation a stock or basket and day 0; p values are covered by tests (DuckDB has no erfc)."""
    return rounded(st.excess_table(_units(s, d), ["kind", "n"]).drop("p"), "event_mean", "normal_mean", "excess_over_normal", "t", "share_up")


def _studied(s: SparkSession, d: str, toned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Units of the study with their returns, with tones if asked for, and the forward returns of all stocks."""
    lines = stage(rt.price_lines(ad.prices(s, d).select("stock_id", "date", F.col("adj_close").alias("price"))), "lines")
    calendar = stage(rt.line_calendar(lines, ad.BENCHMARK), "calendar")
    ahead = stage(rt.study_returns(lines, calendar, ad.BENCHMARK, fr.STUDY_START), "ahead")
    dated, priced = calendar.select("date", "day"), lines.select("stock_id")
    if toned:
        days = rt.pair_days(rt.event_pairs(fr.linked(s, d, None, fr.STUDY_START), dated, priced))
    else:
        days = rt.event_days(fr.quiet(s, d, fr.STUDY_START), fr.canonical_links(s, d), dated, priced)
    return rt.study_units(stage(days, "days"), ahead), ahead


def _units(s: SparkSession, d: str) -> DataFrame:
    return _studied(s, d)[0].select("kind", F.explode("q").alias("q")).select("kind", "q.*")


@book.add()
def g3_p_values(s: SparkSession, d: str) -> DataFrame:
    """Two-sided normal p of each table row's t."""
    return st.excess_table(_units(s, d), ["kind", "n"]).select("kind", "n", F.round("t", 6).alias("t"), F.round("p", 9).alias("p"))


@book.add(ad.sql(fr.ALL, f"""{fr.ROWS_SQL}, bs AS (SELECT DISTINCT theme_name, stock_id FROM links WHERE link_type = 'theme'), dy AS (SELECT theme_name, date, avg(excess_10d) AS x FROM bs JOIN perf USING (stock_id) WHERE excess_10d IS NOT NULL GROUP BY 1, 2)
SELECT theme_name, {r6('avg(x)', 'baseline')}, count(*) AS days FROM dy GROUP BY 1"""))
def g7_basket_baseline(s: SparkSession, d: str) -> DataFrame:
    """Mean over days of the day's mean over the basket."""
    rows = rt.with_performance(ad.prices(s, d), ad.BENCHMARK).where("excess_10d is not null")
    b = ad.links(s, d).where("link_type = 'theme'").select("theme_name", "stock_id").distinct()
    out = rows.join(b, "stock_id").groupBy("theme_name", "date").agg(F.avg("excess_10d").alias("x")).groupBy("theme_name").agg(F.avg("x").alias("baseline"), F.count("*").alias("days"))
    return rounded(out, "baseline")


@book.add(ad.sql(fr.ALL, f"""{STUDY}, ds AS (SELECT DISTINCT unit FROM fp WHERE kind = 'direct') SELECT (SELECT floor(avg(abs(ar1)) * 1e6 + 0.5) / 1e6 FROM su WHERE kind = 'direct') AS event_move, (SELECT floor(avg(abs(ar1)) * 1e6 + 0.5) / 1e6 FROM per WHERE stock_id IN (SELECT unit FROM ds)) AS usual_move, (SELECT count(ar1) FROM su WHERE kind = 'direct') AS n"""))
def g8_attention_size(s: SparkSession, d: str) -> DataFrame:
    """Mean absolute one-day abnormal return of direct events against all days of the period of the same stocks."""
    units, ahead = _studied(s, d)
    units = stage(units.where("kind = 'direct'").select("unit", F.abs(F.filter("q", lambda x: x["n"] == 1)[0]["excess"]).alias("x")), "direct")
    own = ahead.select("stock_id", "line", "start").join(units.select(F.col("unit").alias("stock_id")).distinct(), "stock_id", "left_semi")
    usual = own.select("start", F.explode("line").alias("p")).where("p.day >= start").agg(F.avg(F.abs("p.ar1")).alias("usual_move"))
    out = units.agg(F.avg("x").alias("event_move"), F.count("x").alias("n")).crossJoin(usual)
    return rounded(out.select("event_move", "usual_move", "n"), "event_move", "usual_move")


@book.add(ad.sql(fr.ALL, f"""{STUDY}, g AS (SELECT kind, CAST(sign(tone) AS INTEGER) AS tone, ar5 - base5 AS a, ar10 - base10 AS b FROM su)
SELECT kind, tone, count(*) AS n, {r6('avg(a)', 'mean_5')}, {r6(XT.format(c='a'), 't_5')}, {r6('avg(b)', 'mean_10')}, {r6(XT.format(c='b'), 't_10')} FROM g GROUP BY 1, 2 HAVING count(*) >= 3"""))
def g9_tone_split(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.tone_split(_studied(s, d, True)[0]), "mean_5", "t_5", "mean_10", "t_10")


RR = "rr AS (SELECT stock_id, date, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS k FROM prices WHERE stock_id <> '0050' WINDOW w AS (PARTITION BY stock_id ORDER BY date))"


def _returns(s: SparkSession, d: str) -> DataFrame:
    """The day's return on every trading row of every stock but the benchmark."""
    rows = rt.price_features(ad.prices(s, d).where(F.col("stock_id") != ad.BENCHMARK))
    return rows.select("stock_id", "date", F.col("return_1d").alias("r"))


def _every_pair(s: SparkSession, d: str) -> DataFrame:
    """All stocks with all segments, of which there are few."""
    stocks = ad.prices(s, d).where(F.col("stock_id") != ad.BENCHMARK).select("stock_id").distinct()
    return stocks.crossJoin(F.broadcast(ad.heat_px(s, d).select("keyword").distinct()))


COR = "covar_samp(heat, r) / nullif(stddev_samp(heat) * stddev_samp(r), 0)"


@book.add(ad.sql("heat_px prices", f"{RR}, hp AS (SELECT stock_id, keyword, heat, r FROM heat_px JOIN rr USING (date) WHERE r IS NOT NULL) SELECT stock_id, keyword, count(*) AS n, {r6(COR, 'r')} FROM hp GROUP BY 1, 2 HAVING count(*) >= 5"))
def g10_heat_price(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.heat_price(ad.heat_px(s, d), _returns(s, d), _every_pair(s, d)), "r")


#: Needs rr, hh (keyword, date, heat) and pr (stock_id, keyword): lags count the stock's own trading rows.
LAGS = """hr AS (SELECT pr.stock_id, pr.keyword, hh.heat, rr.k FROM pr JOIN rr ON rr.stock_id = pr.stock_id JOIN hh ON hh.keyword = pr.keyword AND hh.date = rr.date),
lg AS (SELECT hr.stock_id, hr.keyword, l.l AS lag, count(*) AS n, covar_samp(hr.heat, rr.r) / nullif(stddev_samp(hr.heat) * stddev_samp(rr.r), 0) AS c FROM hr CROSS JOIN (SELECT unnest(range(-10, 11)) AS l) l JOIN rr ON rr.stock_id = hr.stock_id AND rr.k = hr.k + l.l WHERE rr.r IS NOT NULL GROUP BY 1, 2, 3),
gd AS (SELECT * FROM lg WHERE n >= 30 AND c IS NOT NULL), bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, keyword ORDER BY -abs(c), abs(lag), lag) AS q FROM gd) WHERE q = 1)"""


@book.add(ad.sql("heat_px prices", f"""{RR}, hh AS (SELECT * FROM heat_px), pr AS (SELECT stock_id, keyword FROM (SELECT DISTINCT stock_id FROM rr) CROSS JOIN (SELECT DISTINCT keyword FROM heat_px)), {LAGS}
SELECT pr.stock_id, pr.keyword, lag AS best_lag, {r6('c', 'r')}, coalesce(n, 0) AS n FROM pr LEFT JOIN bst ON bst.stock_id = pr.stock_id AND bst.keyword = pr.keyword"""))
def g11_cross_correlation(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.cross_correlation(ad.heat_px(s, d), _returns(s, d), _every_pair(s, d)), "r")


GROUP = "c_mktsegment || '-' || CAST(c_custkey % 4 AS VARCHAR)"


@book.add(ad.sql("prices", f"""{RR}, mp AS (SELECT DISTINCT c_mktsegment AS sub_theme, {GROUP} AS name, CAST(c_custkey % (SELECT count(*) FROM supplier) + 1000 AS VARCHAR) AS stock_id FROM customer),
dh AS (SELECT {GROUP} AS name, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS heat FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
hh AS (SELECT sub_theme AS keyword, date, avg(heat) AS heat FROM dh JOIN (SELECT DISTINCT sub_theme, name FROM mp) USING (name) GROUP BY 1, 2), pr AS (SELECT DISTINCT stock_id, sub_theme AS keyword FROM mp), {LAGS},
sd AS (SELECT stock_id, keyword, c AS same_day FROM gd WHERE lag = 0)
SELECT b.stock_id, b.keyword AS sub_theme, b.lag AS best_lag, {r6('b.c', 'r')}, b.n, {r6('same_day')}, CASE WHEN b.n >= 90 AND abs(b.c) >= .6 THEN 'A' WHEN b.n >= 60 AND abs(b.c) >= .4 THEN 'B' WHEN b.n >= 30 AND abs(b.c) >= .3 THEN 'C' END AS grade FROM bst b LEFT JOIN sd ON sd.stock_id = b.stock_id AND sd.keyword = b.keyword"""))
def g12_theme_cross(s: SparkSession, d: str) -> DataFrame:
    """Segments as sub-themes of four keyword groups each, with the stocks that their keywords are linked to."""
    c = ad.table(s, d, "customer")
    name = F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 4).cast("string"))
    n = ad.table(s, d, "supplier").agg(F.count("*").alias("n"))
    mapping = c.crossJoin(F.broadcast(n)).select(F.col("c_mktsegment").alias("sub_theme"), name.alias("keyword"), ad.stock_code(F.col("c_custkey") % F.col("n")).alias("stock_id"), F.lit(1).alias("active"))
    heat = ad.table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(name.alias("keyword"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").cast("double").alias("heat"))
    return rounded(st.theme_cross(heat, _returns(s, d), mapping), "r", "same_day")


DAYS = "td AS (SELECT t.*, CAST(published_at AS DATE) AS date, l.theme_name FROM bursts t JOIN (SELECT DISTINCT keyword, theme_name FROM links WHERE link_type = 'direct') l USING (keyword)), nd AS (SELECT n.*, td.date, td.theme_name, td.keyword FROM news n JOIN td USING (burst_id))"


def themed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bursts and news with their day and theme, and links."""
    links = ad.links(s, d)
    t = ad.bursts(s, d).join(links.where("link_type = 'direct'").select("keyword", "theme_name").distinct(), "keyword").withColumn("date", F.to_date("published_at"))
    return t, ad.news(s, d).join(t.select("burst_id", "keyword", "date", "theme_name"), "burst_id"), links


#: Heat rows of two keywords a segment and day, of which one has no score; classes give bursts and news their themes.
STAT_HEAT = "ht AS (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS theme_name, o_orderpriority AS keyword, CASE WHEN o_orderpriority NOT LIKE '5%' THEN CAST(count(*) AS DOUBLE) END AS trend_score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, o_orderpriority)"


def stat_heat(s: SparkSession, d: str) -> DataFrame:
    o, c = ad.table(s, d, "orders"), ad.table(s, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("theme_name"), F.col("o_orderpriority").alias("keyword")).agg(F.count("*").cast("double").alias("n"))
    return rows.select("date", "theme_name", "keyword", F.when(~F.col("keyword").startswith("5"), F.col("n")).alias("trend_score"))


@book.add(ad.sql("bursts links news", f"""{ad.CLASS}, {STAT_HEAT}, rs AS (SELECT t.burst_id, n.news_id, CAST(t.published_at + INTERVAL 8 HOUR AS DATE) AS date, cl.theme_name FROM bursts t JOIN cl USING (keyword) LEFT JOIN news n USING (burst_id)),
mp AS (SELECT theme_name, count(DISTINCT stock_id) AS stocks FROM links WHERE active = 1 GROUP BY 1), dy AS (SELECT date FROM ht UNION SELECT date FROM rs), k AS (SELECT date, theme_name FROM dy, mp UNION SELECT date, theme_name FROM ht UNION SELECT date, theme_name FROM rs),
a AS (SELECT date, theme_name, count(DISTINCT keyword) AS keywords, avg(trend_score) AS avg_score, max(trend_score) AS max_score FROM ht GROUP BY 1, 2), b AS (SELECT date, theme_name, count(DISTINCT news_id) AS news, count(DISTINCT burst_id) AS bursts FROM rs GROUP BY 1, 2)
SELECT k.date, k.theme_name, coalesce(keywords, 0) AS keywords, coalesce(bursts, 0) AS bursts, coalesce(news, 0) AS news, coalesce(stocks, 0) AS stocks, {r6('avg_score')}, max_score FROM k LEFT JOIN a USING (date, theme_name) LEFT JOIN b USING (date, theme_name) LEFT JOIN mp USING (theme_name)"""))
def g13_theme_daily_stats(s: SparkSession, d: str) -> DataFrame:
    """Every mapped theme on every day that has heat or bursts."""
    t = ad.bursts(s, d).join(classes(s, d).select("keyword", "theme_name"), "keyword").withColumn("date", ex.taipei_day(F.col("published_at")))
    n = ad.news(s, d, "burst_id").join(t.select("burst_id", "date", "theme_name"), "burst_id")
    return rounded(cv.theme_daily_stats(stat_heat(s, d), t, n, ad.links(s, d)), "avg_score")


@book.add(ad.sql("bursts links news", f"""{DAYS}, th AS (SELECT DISTINCT theme_name FROM links UNION SELECT 'none') SELECT th.theme_name, (SELECT count(DISTINCT burst_id) FROM td WHERE td.theme_name = th.theme_name) AS bursts, (SELECT count(DISTINCT news_id) FROM nd WHERE nd.theme_name = th.theme_name) AS news FROM th"""))
def g14_theme_coverage(s: SparkSession, d: str) -> DataFrame:
    t, n, links = themed(s, d)
    themes = links.select("theme_name").union(s.range(1).select(F.lit("none")))
    return cv.theme_coverage(themes, t, n)




@book.add(ad.sql("bursts links news", f"""mp AS (SELECT DISTINCT theme_name, lower(replace(keyword, '#', '')) AS form FROM links WHERE keyword NOT LIKE '%4'), th AS (SELECT DISTINCT theme_name FROM links), t AS (SELECT b.burst_id, theme_name FROM bursts b JOIN mp ON lower(replace(b.keyword, '#', '')) = form)
SELECT th.theme_name, (SELECT count(DISTINCT burst_id) FROM t WHERE t.theme_name = th.theme_name) AS bursts, (SELECT count(DISTINCT news_id) FROM news JOIN t USING (burst_id) WHERE t.theme_name = th.theme_name) AS news FROM th"""))
def g14_by_keyword(s: SparkSession, d: str) -> DataFrame:
    """G14 without classes: themes by the normal form of their keywords."""
    links = ad.links(s, d)
    t = cv.keyword_themes(ad.bursts(s, d).select("burst_id", "keyword"), links.where("keyword not like '%4'").select("theme_name", F.upper("keyword").alias("keyword")))
    return cv.theme_coverage(links, t, ad.news(s, d).select("news_id", "burst_id").join(t, "burst_id"))


@book.add(ad.sql("bursts", f"{CLASS} SELECT t.keyword, count(DISTINCT burst_id) AS bursts FROM bursts t WHERE t.keyword NOT IN (SELECT keyword FROM cl WHERE theme_name <> '其他') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"))
def g15_top_unclassified(s: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    from heedstream.operators.resolve import pending

    return pending(ad.bursts(s, d), classes(s, d), 50)


@book.add(ad.sql("bursts news", f"""{CLASS}, k AS (SELECT DISTINCT keyword FROM bursts), an AS (SELECT c_name AS keyword FROM customer WHERE c_custkey % 11 = 0), kn AS (SELECT c_name AS keyword FROM customer WHERE c_custkey % 10 = 5)
SELECT 'entity' AS kind, k.keyword AS item FROM k LEFT JOIN cl USING (keyword) WHERE coalesce(theme_name, '其他') = '其他' AND keyword NOT IN (SELECT keyword FROM an) AND keyword NOT IN (SELECT keyword FROM kn)
UNION ALL SELECT 'fallback', k.keyword FROM k LEFT JOIN cl USING (keyword) WHERE (source IS NULL OR (source = 'fallback' AND theme_name = '其他')) AND keyword NOT IN (SELECT keyword FROM an)
UNION ALL SELECT 'news', CAST(news_id AS VARCHAR) FROM news WHERE news_sentiment IS NULL"""))
def j15_pending(s: SparkSession, d: str) -> DataFrame:
    """What waits for entity resolution, for a class, and for a sentiment, less what has been answered."""
    from heedstream.operators import resolve as rs

    t, c = ad.bursts(s, d), ad.table(s, d, "customer")
    named = lambda when: c.where(when).select(F.col("c_name").alias("keyword"))
    n = ad.news(s, d).withColumn("sentiment_score", F.when(F.col("news_sentiment").isNotNull(), 0.5)).withColumn("event_type", F.lit("x"))
    sets = {"entity": rs.pending_entities(t, classes(s, d), named("c_custkey % 10 = 5"), named("c_custkey % 11 = 0")), "fallback": rs.pending_fallbacks(t, classes(s, d), named("c_custkey % 11 = 0")), "news": rs.pending_news(n).select(F.col("news_id").cast("string"))}
    out = [df.toDF("item").select(F.lit(k).alias("kind"), "item") for k, df in sets.items()]
    return out[0].union(out[1]).union(out[2])


ENTITIES = "ce AS (SELECT keyword, CASE WHEN c_custkey % 6 <> 1 THEN c_name END AS entity_name, CASE WHEN c_custkey % 6 = 2 THEN '其他' WHEN c_custkey % 6 <> 3 THEN '上市公司' END AS entity_type FROM cl JOIN customer ON c_name = keyword), bk AS (SELECT burst_id, CASE WHEN burst_id % 9 = 0 THEN ' ' WHEN burst_id % 10 > 0 THEN keyword END AS keyword FROM bursts)"


def _entities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bursts, some of them without a keyword, and classes, some of them without an entity."""
    k, i = F.col("c_custkey"), F.col("burst_id")
    c = classes(s, d).select("keyword").join(ad.table(s, d, "customer").select(k, F.col("c_name").alias("keyword")), "keyword")
    t = ad.bursts(s, d).select(i, F.when(i % 9 == 0, " ").when(i % 10 > 0, F.col("keyword")).alias("keyword"))
    return t, c.select("keyword", F.when(k % 6 != 1, F.col("keyword")).alias("entity_name"), F.when(k % 6 == 2, "其他").when(k % 6 != 3, "上市公司").alias("entity_type"))


@book.add(ad.sql("bursts", f"{CLASS}, {ENTITIES}, k AS (SELECT DISTINCT bk.keyword, entity_name IS NOT NULL AND coalesce(entity_type, '其他') <> '其他' AS hit FROM bk LEFT JOIN ce USING (keyword) WHERE trim(bk.keyword) <> '') SELECT count(*) AS keywords, count(*) FILTER (hit) AS resolved, count(*) FILTER (NOT hit) AS unresolved, {r6('count(*) FILTER (hit) / count(*)', 'rate')} FROM k"))
def g16_entity_coverage(s: SparkSession, d: str) -> DataFrame:
    return rounded(cv.entity_coverage(*_entities(s, d)), "rate")


@book.add(ad.sql("bursts", f"{CLASS}, {ENTITIES} SELECT keyword, count(*) AS bursts FROM bk LEFT JOIN ce USING (keyword) WHERE trim(keyword) <> '' AND (entity_name IS NULL OR coalesce(entity_type, '其他') = '其他') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"))
def g16_unresolved(s: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return cv.unresolved_keywords(*_entities(s, d))


@book.add(ad.sql("bursts", f"{CLASS}, k AS (SELECT DISTINCT keyword FROM bursts) SELECT count(*) AS total, count(*) FILTER (theme_name <> '其他') AS classified, {r6('count(*) FILTER (theme_name <> $$其他$$) * 100.0 / count(*)', 'coverage_pct')}, count(*) FILTER (need_review = 1) AS need_review FROM k LEFT JOIN cl USING (keyword)"))
def g17_quality_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(cv.quality_summary(ad.bursts(s, d), classes(s, d)), "coverage_pct")


SHARES = ", ".join(f"count(*) FILTER (news_sentiment = '{t}') AS {t.lower()}_n, {r6(f'count(*) FILTER (news_sentiment = $${t}$$) * 100.0 / nullif(count(news_sentiment), 0)', f'{t.lower()}_pct')}" for t in ex.SENTIMENTS)


@book.add(ad.sql("news", f"SELECT news_source, count(*) AS total, count(news_sentiment) AS analyzed, count(*) - count(news_sentiment) AS unanalyzed, {SHARES}, {r6('count(news_sentiment) * 100.0 / count(*)', 'coverage_pct')}, count(news_sentiment) * 100.0 / count(*) < 20 AS low_coverage FROM news GROUP BY 1"))
def g18_sentiment_shares(s: SparkSession, d: str) -> DataFrame:
    return rounded(st.sentiment_shares(ad.news(s, d), ["news_source"]), "positive_pct", "neutral_pct", "negative_pct", "coverage_pct")


@book.add(ad.sql(fr.ALL, f"""{fr.BASE_SQL}, e AS (SELECT * FROM events_perf WHERE link_type = 'direct'), m20 AS (SELECT theme_name, max(n) / sum(n) AS x FROM (SELECT theme_name, ma20_breakout_day, count(*) AS n FROM e WHERE ma20_breakout_day IS NOT NULL GROUP BY 1, 2) GROUP BY 1), m60 AS (SELECT theme_name, max(n) / sum(n) AS x FROM (SELECT theme_name, ma60_breakout_day, count(*) AS n FROM e WHERE ma60_breakout_day IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT theme_name, avg(CASE WHEN reaction_days BETWEEN 0 AND 30 THEN 1.0 WHEN reaction_days IS NOT NULL THEN 0.0 END) * 100 AS ok FROM e GROUP BY 1), td AS (SELECT t.burst_id, l.theme_name FROM bursts t JOIN (SELECT DISTINCT keyword, theme_name FROM links WHERE link_type = 'direct') l USING (keyword)),
s AS (SELECT theme_name, count(*) AS total, count(x) AS analyzed, count(*) FILTER (x = 'Neutral') AS nn FROM (SELECT theme_name, CASE WHEN theme_name LIKE 'B%' AND news_sentiment IS NOT NULL THEN 'Neutral' ELSE news_sentiment END AS x FROM news JOIN td USING (burst_id)) GROUP BY 1)
SELECT theme_name, coalesce(total, 0) AS total, coalesce(analyzed, 0) AS analyzed, {r6('nn * 100.0 / nullif(analyzed, 0)', 'neutral_pct')}, floor(coalesce(ok, 100) * 1e6 + 0.5) / 1e6 AS reaction_days_valid_pct, {r6('m20.x', 'ma20_share')}, coalesce(m20.x > 0.35, false) AS ma20_warning, {r6('m60.x', 'ma60_share')}, coalesce(m60.x > 0.35, false) AS ma60_warning, coalesce(analyzed > 0 AND nn * 100.0 / analyzed > 80, false) AS sentiment_warning FROM v FULL JOIN s USING (theme_name) LEFT JOIN m20 USING (theme_name) LEFT JOIN m60 USING (theme_name)"""))
def g19_quality_check(s: SparkSession, d: str) -> DataFrame:
    """G19 by theme; news of one segment are made neutral, so that it is warned of."""
    n = themed(s, d)[1].withColumn("news_sentiment", F.when(F.col("theme_name").startswith("B") & F.col("news_sentiment").isNotNull(), "Neutral").otherwise(F.col("news_sentiment")))
    out = st.quality_check(fr.performance(s, d), n, ["theme_name"])
    kept = ["theme_name", "total", "analyzed", "neutral_pct", "reaction_days_valid_pct", "ma20_share", "ma20_warning", "ma60_share", "ma60_warning", "sentiment_warning"]
    return rounded(out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "analyzed")}).select(*kept), "neutral_pct", "reaction_days_valid_pct", "ma20_share", "ma60_share")


@book.add(ad.sql("news", "SELECT news_title AS title, news_title AS summary, news_source AS source, news_sentiment AS sentiment FROM news WHERE news_sentiment IS NOT NULL ORDER BY news_id LIMIT 20"))
def g20_verification_sample(s: SparkSession, d: str) -> DataFrame:
    return cv.verification_sample(ad.news(s, d))


@book.add(ad.sql("bursts links news", f"{DAYS} SELECT theme_name, date, {', '.join(f'count(*) FILTER (news_sentiment = $${t}$$) AS {t.lower()}' for t in ex.SENTIMENTS)}, count(*) FILTER (news_sentiment IS NULL) AS unanalyzed FROM nd GROUP BY 1, 2"))
def g21_daily_tone(s: SparkSession, d: str) -> DataFrame:
    return cv.daily_tone(themed(s, d)[1], ["theme_name", "date"])


@book.add(ad.sql("links prices", "SELECT stock_id, count(DISTINCT keyword) FILTER (link_type = 'direct') AS direct, count(DISTINCT keyword) FILTER (link_type = 'theme') AS theme, count(DISTINCT keyword) FILTER (link_type = 'direct') + count(DISTINCT keyword) FILTER (link_type = 'theme') AS total FROM links WHERE active = 1 AND stock_id <> '0050' AND stock_id IN (SELECT stock_id FROM prices) GROUP BY 1"))
def g22_stock_options(s: SparkSession, d: str) -> DataFrame:
    return cv.stock_options(ad.links(s, d), ad.prices(s, d), ad.BENCHMARK)


#: Heat of every keyword on the days of its bursts.
BURST_HEAT = "kh AS (SELECT keyword, CAST(published_at + INTERVAL 8 HOUR AS DATE) AS date, max(CAST(regexp_extract(approx_traffic, '(\\d+)', 1) AS DOUBLE)) AS trend_score FROM bursts GROUP BY 1, 2)"


def burst_heat(s: SparkSession, d: str) -> DataFrame:
    return ad.bursts(s, d).groupBy("keyword", ex.taipei_day(F.col("published_at")).alias("date")).agg(F.max(ex.traffic_digits(F.col("approx_traffic")).cast("double")).alias("trend_score"))


@book.add(ad.sql("bursts links news prices", f"""{CLASS}, {BURST_HEAT}, td AS (SELECT max(date) AS today FROM kh), mb AS (SELECT DISTINCT theme_name, CASE WHEN keyword LIKE '%0' THEN upper(keyword) ELSE keyword END AS keyword FROM links WHERE theme_name <> '其他'), sk AS (SELECT DISTINCT theme_name, stock_id FROM links WHERE theme_name <> '其他'),
h AS (SELECT theme_name, avg(trend_score) FILTER (today - date <= 6) AS a, avg(trend_score) FILTER (today - date BETWEEN 7 AND 13) AS b FROM kh JOIN mb USING (keyword), td GROUP BY 1),
ob AS (SELECT n.news_id, n.news_sentiment, t.keyword, coalesce(cl.canonical_keyword, t.keyword) AS canonical, CAST(t.published_at + INTERVAL 8 HOUR AS DATE) AS date FROM news n JOIN bursts t USING (burst_id) LEFT JOIN cl ON cl.keyword = t.keyword), nw AS (SELECT DISTINCT theme_name, news_id, news_sentiment FROM ob JOIN mb ON mb.keyword IN (ob.keyword, ob.canonical), td WHERE today - date <= 6),
n AS (SELECT theme_name, count(*) AS news, count(*) FILTER (news_sentiment = 'Positive') AS positive, count(*) FILTER (news_sentiment = 'Neutral') AS neutral, count(*) FILTER (news_sentiment = 'Negative') AS negative FROM nw GROUP BY 1),
l AS (SELECT stock_id, max(close) FILTER (k = 1) / max(close) FILTER (k = 11) - 1 AS mv FROM (SELECT stock_id, close, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS k FROM prices) GROUP BY 1), b AS (SELECT theme_name, avg(mv) AS r, count(*) AS stocks FROM sk LEFT JOIN l USING (stock_id) GROUP BY 1)
SELECT theme_name, {r6('CASE WHEN h.b > 0 THEN a / h.b - 1 END', 'heat_change')}, {r6('a', 'heat_recent')}, coalesce(news, 0) AS news, coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative, {r6('r', 'return_10d')}, coalesce(stocks, 0) AS stocks FROM (SELECT DISTINCT theme_name FROM mb) LEFT JOIN h USING (theme_name) LEFT JOIN n USING (theme_name) LEFT JOIN b USING (theme_name)"""))
def g23_market_radar(s: SparkSession, d: str) -> DataFrame:
    links = ad.links(s, d)
    members = links.select("theme_name", F.when(F.col("keyword").endswith("0"), F.upper("keyword")).otherwise(F.col("keyword")).alias("keyword"))
    heat = stage(burst_heat(s, d), "heat")
    today = heat.agg(F.max("date").alias("t")).first()["t"]
    t = ad.bursts(s, d).select("burst_id", "keyword", ex.taipei_day(F.col("published_at")).alias("date"))
    seen = ad.news(s, d).join(t, "burst_id").join(classes(s, d).select("keyword", "canonical_keyword"), "keyword", "left").select("news_id", "news_sentiment", "keyword", F.coalesce("canonical_keyword", "keyword").alias("canonical"), "date")
    out = cv.market_radar(members, links.select("theme_name", "stock_id"), heat, seen, ad.prices(s, d), F.lit(today))
    return rounded(out, "heat_change", "heat_recent", "return_10d")


@book.add(ad.sql("bursts links news", f"{DAYS} SELECT date, theme_name, keyword, news_id, news_title, coalesce(news_source, 'unknown') AS news_source, coalesce(news_sentiment, 'Unanalyzed') AS news_sentiment FROM nd WHERE trim(news_title) <> ''"))
def g24_timeline(s: SparkSession, d: str) -> DataFrame:
    _, n, links = themed(s, d)
    return cv.timeline(n.drop("theme_name"), links.where("link_type = 'direct'").select("keyword", "theme_name").distinct())


@book.add(ad.sql("bursts links news prices", f"""fe AS (SELECT stock_id, date, CAST(volume AS DOUBLE) / lag(volume) OVER w - 1 AS vc, lead(close, 5) OVER w / close - 1 AS fr FROM prices WINDOW w AS (PARTITION BY stock_id ORDER BY date)), tn AS (SELECT burst_id, arg_min(news_sentiment, news_id) AS sentiment FROM news GROUP BY 1),
ev AS (SELECT t.burst_id AS event_id, l.stock_id, CAST(t.published_at AS DATE) AS date, t.approx_traffic, tn.sentiment FROM bursts t JOIN links l USING (keyword) LEFT JOIN tn USING (burst_id) WHERE l.link_type = 'direct'),
al AS (SELECT ev.*, f.vc, f.fr, CAST(regexp_extract(approx_traffic, '([\\d.]+)', 1) AS DOUBLE) * 1000 AS tr FROM ev ASOF JOIN fe f ON ev.stock_id = f.stock_id AND ev.date <= f.date),
rk AS (SELECT *, (rank() OVER (ORDER BY tr) + (count(*) OVER (PARTITION BY tr) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS heat, coalesce(avg(CASE WHEN fr IS NOT NULL THEN CAST(fr > 0 AS DOUBLE) END) OVER (PARTITION BY stock_id ORDER BY date, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) * 100 AS win FROM al),
sc AS (SELECT *, heat * 0.35::DOUBLE + (greatest(-1, least(3, coalesce(vc, 0))) + 1) / 4 * 100 * 0.25::DOUBLE + CASE sentiment WHEN 'Positive' THEN 100.0::DOUBLE WHEN 'Negative' THEN 0 ELSE 50 END * 0.15::DOUBLE + win * 0.25::DOUBLE AS x FROM rk)
SELECT event_id, stock_id, {r6('win', 'historical_win_rate')}, round_even(x, 1) AS signal_score FROM sc"""))
def g25_signal_scores(s: SparkSession, d: str) -> DataFrame:
    t = ad.bursts(s, d).join(ad.links(s, d).where("link_type = 'direct'"), "keyword")
    tone = ad.news(s, d, "burst_id", "news_sentiment").where("news_sentiment is not null").groupBy("burst_id").agg(F.min_by("news_sentiment", "news_id").alias("news_sentiment"))
    e = t.join(tone, "burst_id", "left").select(F.col("burst_id").alias("event_id"), "stock_id", F.to_date("published_at").alias("date"), "approx_traffic", "news_sentiment")
    features = rt.price_features(ad.prices(s, d)).select("stock_id", "date", "volume_change", "future_return_5d")
    met = rt.align(e, features).where("day0 is not null").select(*e.columns, "day0.volume_change", "day0.future_return_5d")
    met = stage(met, "aligned")  # ranks of traffic and the events themselves read it
    return rounded(st.signal_scores(met).select("event_id", "stock_id", "historical_win_rate", "signal_score"), "historical_win_rate")


LIGHT = "CASE WHEN max({c}) < TIMESTAMP '1999-06-01' - INTERVAL 24 HOUR THEN 'red' WHEN max({c}) >= TIMESTAMP '1999-06-01' - INTERVAL 1 HOUR THEN 'green' ELSE 'yellow' END AS light"


@book.add(f"""SELECT 'orders' AS table_name, count(*) AS rows, {LIGHT.format(c='o_orderdate')} FROM orders UNION ALL SELECT 'lineitem', count(*), {LIGHT.format(c='l_shipdate')} FROM lineitem UNION ALL SELECT 'events', count(*), {LIGHT.format(c='ts')} FROM events""")
def g33_table_counts(s: SparkSession, d: str) -> DataFrame:
    """Row counts, and a light by the age of the newest row at a fixed time."""
    tables = {n: ad.table(s, d, n) for n in ("orders", "lineitem", "events")}
    counts = cv.table_counts(tables)
    newest = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    ages = None
    for n, c in newest.items():
        one = tables[n].agg(F.lit(n).alias("table_name"), (F.lit(F.unix_timestamp(F.expr("timestamp '1999-06-01'"))) - F.unix_timestamp(F.max(F.col(c).cast("timestamp")))).alias("age"))
        ages = one if ages is None else ages.union(one)
    return counts.join(ages, "table_name").select("table_name", "rows", cv.live_light(F.col("age") / 60, 60, 24 * 60).alias("light"))


@book.add(ad.sql("bursts", """SELECT 'bursts' AS table_name, count(*) AS rows FROM bursts WHERE published_at >= TIMESTAMP '1997-03-04 16:00:00' AND published_at < TIMESTAMP '1997-03-05 16:00:00' UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-04 16:00:00' AND l_shipdate < TIMESTAMP '1997-03-05 16:00:00'"""))
def g34_new_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of one Taipei day by pushable UTC ranges."""
    start = ex.day_start_utc(F.lit("1997-03-05").cast("date")).cast("timestamp_ntz")
    end = ex.day_start_utc(F.lit("1997-03-06").cast("date")).cast("timestamp_ntz")
    return cv.new_rows({"bursts": (ad.bursts(s, d), "published_at"), "lines": (ad.table(s, d, "lineitem"), "l_shipdate")}, start, end)


@book.add(ad.sql("links heat_px", """p AS (SELECT theme_name, keyword, max(CAST(link_type = 'direct' AS INTEGER)) AS direct FROM links GROUP BY 1, 2), f AS (SELECT DISTINCT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-07-28'), g AS (SELECT DISTINCT c_name AS keyword FROM f JOIN customer ON c_custkey = o_custkey)
SELECT count(*) AS active, count(g.keyword) AS fresh, count(*) FILTER (direct = 1) AS direct, count(g.keyword) FILTER (direct = 1) AS direct_fresh FROM p LEFT JOIN g USING (keyword)"""))
def g34_heat_coverage(s: SparkSession, d: str) -> DataFrame:
    heat = ad.bursts(s, d).select("keyword", F.to_date("published_at").alias("date"))
    return cv.heat_coverage(ad.links(s, d), heat, F.lit("1998-07-31").cast("date"))


@book.add(ad.sql(fr.ALL, f"{qr.VOL}, {fr.LINKED_SQL}, {qr.DENSE_EVENTS} SELECT ed.keyword, ed.stock_id, ed.date, {r6('before')}, {r6('after5')} FROM ed LEFT JOIN vt ON vt.stock_id = ed.stock_id AND vt.date = ed.date"))
def g36_volatility_at_events(s: SparkSession, d: str) -> DataFrame:
    v = rt.volatility(qr.dense(s, d), ad.BENCHMARK)
    return rounded(cv.volatility_at(qr.dense_events(s, d).drop("tone"), v).select("keyword", "stock_id", "date", "before", "after5"), "before", "after5")


@book.add(ad.sql("prices", f"{qr.VOL} SELECT stock_id, {r6('arg_max(ratio, date)', 'ratio')}, max(date) AS date, CASE WHEN arg_max(ratio, date) >= 1.5 THEN 'high' WHEN arg_max(ratio, date) >= 1.2 THEN 'raised' WHEN arg_max(ratio, date) > 0.8 THEN 'normal' ELSE 'calm' END AS level FROM vt WHERE ratio IS NOT NULL GROUP BY 1"))
def g36_latest_ratio(s: SparkSession, d: str) -> DataFrame:
    """G36 and F16."""
    out = cv.latest_ratio(rt.volatility(qr.dense(s, d), ad.BENCHMARK)).withColumn("level", ex.volatility_level(F.col("ratio")))
    return rounded(out, "ratio")


@book.add(ad.sql("heat_px links", "x AS (SELECT l.stock_id, h.keyword || (l.active + 0) AS k, h.keyword, max(heat) AS peak FROM heat_px h JOIN (SELECT DISTINCT theme_name, stock_id, active FROM links) l ON l.theme_name = h.keyword GROUP BY 1, 2, 3), r AS (SELECT stock_id, keyword, peak, row_number() OVER (PARTITION BY stock_id ORDER BY peak DESC, keyword) AS rank FROM x) SELECT * FROM r WHERE rank <= 5"))
def g42_top_keywords(s: SparkSession, d: str) -> DataFrame:
    heat = ad.heat_px(s, d).join(ad.links(s, d).select(F.col("theme_name").alias("keyword"), "stock_id").distinct(), "keyword")
    return cv.top_keywords(heat).select("stock_id", "keyword", "peak", "rank")


@book.add(ad.sql(fr.ALL, f"""{fr.BASE_SQL} SELECT stock_id, count(*) AS events, {r6('avg(excess_10d)', 'mean_excess')}, {r6('any_value(normal_10d)', 'normal')}, {r6('avg(excess_10d) - any_value(normal_10d)', 'difference')}, {r6('avg(return_10d)', 'mean_return')},
CASE WHEN avg(excess_10d) - any_value(normal_10d) > 0.01 THEN 'better' WHEN avg(excess_10d) - any_value(normal_10d) < -0.01 THEN 'worse' WHEN avg(excess_10d) IS NOT NULL THEN 'same' END AS verdict FROM events_perf WHERE link_type = 'direct' AND date >= DATE '1996-01-01' GROUP BY 1"""))
def g43_stock_headlines(s: SparkSession, d: str) -> DataFrame:
    """Events of a period by stock against its normal level."""
    p = fr.performance(s, d).where("date >= date '1996-01-01'")
    out = p.groupBy("stock_id").agg(F.count("*").alias("events"), F.avg("excess_10d").alias("mean_excess"), F.first("normal_10d").alias("normal"), F.avg("return_10d").alias("mean_return"))
    out = out.withColumn("difference", F.col("mean_excess") - F.col("normal")).withColumn("verdict", ex.against_normal(F.col("mean_excess"), F.col("normal")))
    return rounded(out, "mean_excess", "normal", "difference", "mean_return")


QUERIES, ORACLES = book.queries, book.oracles
