"""Frames that several queries share, built from the adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heedstream.functions.exprs import taipei_day, traffic_digits
from heedstream.operators import events as ev
from heedstream.operators import resolve as rs
from heedstream.operators import returns as rt
from heedstream.sources import adapters as ad
from heedstream.sources.shared import stage

SCORE = {"Positive": 1, "Negative": -1}


def tone_score(c: str = "news_sentiment"):  # noqa: ANN201
    return F.when(F.col(c) == "Positive", 1).when(F.col(c) == "Negative", -1).otherwise(0)


#: First day of the study; prices begin sixty days before.
STUDY_START = "1992-03-01"


def quiet(spark: SparkSession, d: str, start: str | None = None) -> DataFrame:
    """Quiet-period events (keyword, date, traffic, tone) of canonical keywords (J22) on Taipei days (F9), of all bursts or of those from ``start`` on."""
    rows = ad.bursts(spark, d)
    t = rs.canonical(rows.where(F.col("published_at") >= F.lit(start).cast("timestamp_ntz")) if start else rows, ad.classes(spark, d)).select("burst_id", "keyword", taipei_day(F.col("published_at")).alias("date"), traffic_digits(F.col("approx_traffic")).alias("traffic"))
    tone = ad.news(spark, d, "burst_id", "news_sentiment").groupBy("burst_id").agg(F.sum(tone_score()).alias("tone"))
    toned = t.join(tone, "burst_id").select("keyword", "date", "tone")
    return ev.quiet_events(t, toned)


def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of canonical keywords."""
    return rs.canonical(ad.links(spark, d), ad.classes(spark, d))


def linked(spark: SparkSession, d: str, kind: str | None = "direct", start: str | None = None) -> DataFrame:
    """Quiet events of linked stocks; links are those of canonical keywords."""
    links = canonical_links(spark, d)
    return quiet(spark, d, start).join(links.where(F.col("link_type") == kind) if kind else links, "keyword").select("keyword", "stock_id", "link_type", "theme_name", "date", "traffic", "tone")


def performance(spark: SparkSession, d: str, kind: str | None = "direct", only: tuple[str, ...] | None = None) -> DataFrame:
    """Linked events with the performance of their day-0 row and the stock's normal excess return; of that row ``only`` some columns, if named, as it is shuffled whole."""
    rows = rt.with_performance(ad.prices(spark, d), ad.BENCHMARK)
    columns = [c for c in rows.columns if (c in ("stock_id", "date", *only) if only else c not in ("open", "high", "low", "adj_close", "volume"))]
    met = rt.align(linked(spark, d, kind), rows.select(*columns)).where("day0 is not null")
    met = met.select("keyword", "stock_id", "link_type", "theme_name", "traffic", "tone", "date", F.col("day0.date").alias("day0_date"), *[F.col(f"day0.{c}").alias(c) for c in columns if c not in ("stock_id", "date")])
    tone = F.when(F.col("tone") > 0, "Positive").when(F.col("tone") < 0, "Negative").otherwise("Neutral")
    return met.withColumn("news_sentiment", tone)


def study(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What the studies read, each written once: pairs of events and stocks (W18), and daily abnormal returns."""
    prices = stage(ad.prices(spark, d).select("stock_id", "date", "adj_close"), "prices")
    return stage(study_pairs(spark, d, prices), "pairs"), rt.daily_abnormal(prices, ad.BENCHMARK)


def study_pairs(spark: SparkSession, d: str, prices: DataFrame) -> DataFrame:
    """Pairs of events and stocks (W18) of the study's period; of ``prices`` only stocks and the benchmark's days count."""
    days = stage(prices.where(F.col("stock_id") == ad.BENCHMARK).select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("day")), "days")
    return rt.event_pairs(linked(spark, d, None, STUDY_START), days, prices)


#: The same for the oracles; needs the adapters bursts, news, links and prices.
QUIET_SQL = f"""{ad.CLASS}, tn AS (SELECT burst_id, sum(CASE news_sentiment WHEN 'Positive' THEN 1 WHEN 'Negative' THEN -1 ELSE 0 END) AS tone FROM news GROUP BY 1),
kd AS (SELECT coalesce(cl.canonical_keyword, t.keyword) AS keyword, CAST(t.published_at + INTERVAL 8 HOUR AS DATE) AS date, max(CAST(regexp_extract(t.approx_traffic, '(\\d+)', 1) AS DOUBLE)) AS traffic, CAST(coalesce(sum(tn.tone), 0) AS BIGINT) AS tone FROM bursts t LEFT JOIN cl ON cl.keyword = t.keyword LEFT JOIN tn USING (burst_id) GROUP BY 1, 2),
quiet AS (SELECT keyword, date, traffic, tone FROM (SELECT *, lag(date) OVER (PARTITION BY keyword ORDER BY date) AS prev FROM kd) WHERE prev IS NULL OR date - prev > 3)"""
#: Links of canonical keywords; needs QUIET_SQL and the adapter links.
KLINKS = "klinks AS (SELECT coalesce(cl.canonical_keyword, l.keyword) AS keyword, l.* EXCLUDE (keyword) FROM links l LEFT JOIN cl ON cl.keyword = l.keyword)"
LINKED_SQL = f"{QUIET_SQL}, {KLINKS}"

ROWS_SQL = """nb AS (SELECT *, row_number() OVER w AS ordinal, lead(close, 1) OVER w / close - 1 AS return_1d, lead(close, 3) OVER w / close - 1 AS return_3d, lead(close, 5) OVER w / close - 1 AS return_5d, lead(close, 10) OVER w / close - 1 AS return_10d,
  lead(date, 1) OVER w AS to_1, lead(date, 3) OVER w AS to_3, lead(date, 5) OVER w AS to_5, lead(date, 10) OVER w AS to_10,
  max(high) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) / close - 1 AS max_gain_10d, min(low) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) / close - 1 AS max_loss_10d,
  avg(close) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20, avg(close) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ma60
  FROM prices WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
cr AS (SELECT *, CASE WHEN close > ma20 AND lag(close) OVER w <= lag(ma20) OVER w THEN ordinal END AS x20, CASE WHEN close > ma60 AND lag(close) OVER w <= lag(ma60) OVER w THEN ordinal END AS x60 FROM nb WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
bk AS (SELECT *, min(x20) OVER f - ordinal AS ma20_breakout_day, min(x60) OVER f - ordinal AS ma60_breakout_day FROM cr WINDOW f AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)),
re AS (SELECT a.stock_id, a.date, min(b.ordinal - a.ordinal) AS reaction_days FROM nb a JOIN nb b ON a.stock_id = b.stock_id AND b.ordinal BETWEEN a.ordinal + 1 AND a.ordinal + 30 AND abs(b.close / a.close - 1) >= 0.01 GROUP BY 1, 2),
bm AS (SELECT date, close FROM prices WHERE stock_id = '0050'),
perf AS (SELECT k.*, reaction_days, k.return_1d - (b1.close / b0.close - 1) AS excess_1d, k.return_3d - (b3.close / b0.close - 1) AS excess_3d, k.return_5d - (b5.close / b0.close - 1) AS excess_5d, k.return_10d - (b10.close / b0.close - 1) AS excess_10d FROM bk k LEFT JOIN re USING (stock_id, date)
  LEFT JOIN bm b0 ON k.date = b0.date LEFT JOIN bm b1 ON k.to_1 = b1.date LEFT JOIN bm b3 ON k.to_3 = b3.date LEFT JOIN bm b5 ON k.to_5 = b5.date LEFT JOIN bm b10 ON k.to_10 = b10.date),
normal AS (SELECT stock_id, avg(excess_1d) AS normal_1d, avg(excess_3d) AS normal_3d, avg(excess_5d) AS normal_5d, avg(excess_10d) AS normal_10d, count(*) AS days FROM perf GROUP BY 1)"""

EVENTS_SQL = """le AS (SELECT q.*, l.stock_id, l.link_type, l.theme_name FROM quiet q JOIN klinks l USING (keyword)),
events_perf AS (SELECT le.keyword, le.stock_id, le.link_type, le.theme_name, le.traffic, le.tone, le.date, p.date AS day0_date, p.* EXCLUDE (stock_id, date, open, high, low, adj_close, volume), n.normal_1d, n.normal_3d, n.normal_5d, n.normal_10d,
  CASE WHEN le.tone > 0 THEN 'Positive' WHEN le.tone < 0 THEN 'Negative' ELSE 'Neutral' END AS news_sentiment
  FROM le ASOF JOIN perf p ON le.stock_id = p.stock_id AND le.date <= p.date LEFT JOIN normal n ON n.stock_id = le.stock_id)"""

#: Quiet events of bursts from the study's first day on.
STUDY_SQL = LINKED_SQL.replace("FROM bursts t", f"FROM (SELECT * FROM bursts WHERE published_at >= TIMESTAMP '{STUDY_START}') t")

ALL = "bursts news links prices"
BASE_SQL = ",\n".join((LINKED_SQL, ROWS_SQL, EVENTS_SQL))
