"""Registered queries: streaming operators, drained over what has landed, and the composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedstream.functions.exprs import taipei_day
from heedstream.operators import coverage as cv
from heedstream.operators import returns as rt
from heedstream.operators import stats as st
from heedstream.plans import frames as fr
from heedstream.plans import jobs
from heedstream.plans import queries_data as qd
from heedstream.plans import queries_returns as qr
from heedstream.plans import queries_stats as qs
from heedstream.plans._book import Book, r6, rounded
from heedstream.sources import adapters as ad
from heedstream.sources.shared import stage
from heedstream.streaming import streams as sm

book = Book()
NTZ = "timestamp_ntz"


def observed(s: SparkSession, d: str) -> DataFrame:
    """The events table as a stream."""
    path = f"{d}/events.parquet"
    rows = sm.read_files(s, f"{d}/events.parque[t]", s.read.parquet(path).schema)  # a pattern: the source takes a folder or a single file
    return rows.select(F.col("user_id").alias("burst_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.floor("value").cast("long").alias("traffic"), "event_type", "event_id")


@book.add("SELECT CAST(user_id AS VARCHAR) AS keyword, CAST(ts AS DATE) AS day, min(ts) AS fetched_at, arg_max(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '+', row(ts, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '+')) AS approx_traffic FROM events GROUP BY 1, 2")
def t1_collect(s: SparkSession, d: str) -> DataFrame:
    polls = observed(s, d).select(F.col("burst_id").cast("string").alias("keyword"), F.date_trunc("day", "observed_at").alias("published_at"), F.col("observed_at").alias("fetched_at"), F.concat(F.col("traffic").cast("string"), F.lit("+")).alias("approx_traffic"))
    bursts, _ = sm.collect(polls, sm.work_folder(s))
    return bursts.select("keyword", F.to_date("published_at").alias("day"), F.col("fetched_at").cast(NTZ).alias("fetched_at"), "approx_traffic")


@book.add(f"WITH {qd.FEED_COUNTS} SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(new_trends) AS BIGINT) AS new_trends, CAST(sum(updated_trends) AS BIGINT) AS updated_trends, (SELECT CAST(sum(new_news) AS BIGINT) FROM nb) AS new_news, CAST(sum(skipped_items) AS BIGINT) AS skipped_items, CAST(sum(failed_items) AS BIGINT) AS failed_items, (SELECT count(*) FROM (SELECT DISTINCT kw, pub FROM gd)) AS bursts, (SELECT CAST(sum(new_news) AS BIGINT) FROM nb) AS news FROM fc LEFT JOIN fs USING (batch)")
def t1_collect_items(s: SparkSession, d: str) -> DataFrame:
    """The items of the feed as a stream of a file a batch of days, and the sums of the counters that it observed."""
    folder = sm.work_folder(s)
    qd.feed_items(s, d).withColumn("part", F.expr("batch div 7")).repartition(8, "part").write.partitionBy("part").parquet(f"{folder}/landed")
    landed = s.read.parquet(f"{folder}/landed")
    out = sm.collect_items(sm.read_files(s, f"{folder}/landed", landed.schema, per_trigger=2), f"{folder}/job", every=3)
    sums = out["counts"].agg(*[F.sum(c).alias(c) for c in sm.COUNTER_NAMES])
    return sums.crossJoin(out["bursts"].agg(F.count("*").alias("bursts"))).crossJoin(out["news"].agg(F.count("*").alias("news")))


@book.add("SELECT user_id AS burst_id, event_type FROM events GROUP BY 1, 2")
def t2_dedupe(s: SparkSession, d: str) -> DataFrame:
    return sm.drain(sm.dedupe(observed(s, d), ["burst_id", "event_type"], "observed_at"), sm.work_folder(s)).select("burst_id", "event_type")


CLOSED = "WITH x AS (SELECT user_id, ts, floor(value) AS v, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 60 MINUTE AS gap FROM events), g AS (SELECT *, sum(CAST(coalesce(gap, true) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id AS burst_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS polls FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


@book.add(CLOSED)
def t3_list_sessions(s: SparkSession, d: str) -> DataFrame:
    out = sm.drain(sm.list_sessions(observed(s, d)), sm.work_folder(s))
    return out.select("burst_id", F.col("first_seen").cast(NTZ).alias("first_seen"), F.col("last_seen").cast(NTZ).alias("last_seen"), "polls")


@book.add("SELECT user_id AS burst_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS polls FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) + 1 AS TIMESTAMP) - INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def t4_daily_counts(s: SparkSession, d: str) -> DataFrame:
    return sm.drain(sm.daily_counts(observed(s, d)), sm.work_folder(s))


@book.add("SELECT event_type AS source, max(ts) AS newest FROM events GROUP BY 1")
def t5_freshness(s: SparkSession, d: str) -> DataFrame:
    out = sm.freshness(observed(s, d).withColumnRenamed("event_type", "source"), sm.work_folder(s))
    return out.select("source", F.col("newest").cast(NTZ).alias("newest"))


@book.add("WITH l AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS keyword, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup'), q AS (SELECT *, lag(day) OVER (PARTITION BY keyword ORDER BY day) AS prev FROM l) SELECT keyword, day FROM q WHERE prev IS NULL OR day - prev > 3")
def t6_new_listings(s: SparkSession, d: str) -> DataFrame:
    rows = observed(s, d).where("event_type = 'signup'").select(F.col("burst_id").cast("string").alias("keyword"), "observed_at")
    return sm.drain(sm.new_listings(rows), sm.work_folder(s))


# ---- composed jobs ----

@book.add()
def g37_stock_dataset(s: SparkSession, d: str) -> DataFrame:
    """The pieces of every stock's dataset in one job, summed up by stock."""
    i = F.col("news_id")
    t = ad.bursts(s, d).select("burst_id", "keyword", taipei_day(F.col("published_at")).alias("date"), "approx_traffic")
    seen = t.join(ad.classes(s, d).select("keyword", "canonical_keyword"), "keyword", "left").select("burst_id", "keyword", F.coalesce("canonical_keyword", "keyword").alias("canonical"), "date", "approx_traffic")
    news = ad.news(s, d).select("news_id", "burst_id", "news_title", "news_source", F.lit("u").alias("news_url"), "news_sentiment", F.when(i % 4 > 0, F.concat(F.lit("type"), (i % 4).cast("string"))).alias("event_type"))
    links = ad.links(s, d).select(F.when(F.col("keyword").endswith("2"), F.upper("keyword")).otherwise(F.col("keyword")).alias("keyword"), "stock_id", "link_type")
    heat = qs.burst_heat(s, d).withColumnRenamed("trend_score", "heat")
    data = jobs.stock_datasets(stage(ad.prices(s, d), "prices"), links, seen, news, heat, ad.BENCHMARK, fr.STUDY_START)
    out = data["returns"].groupBy("stock_id").agg(F.count("*").alias("events"), F.avg("return_5d").alias("mean_5d"), F.avg("excess_10d").alias("mean_excess"))
    days = data["event_days"].groupBy("stock_id").agg(F.count("*").alias("days"), F.sum("news_count").alias("day_news"), F.sum("positive").alias("positive"), F.max("number").alias("last_number"), F.sum(F.size("headlines")).cast("long").alias("headlines"), F.count("vol_before").alias("with_volatility"))
    tones = data["news_daily"].groupBy("stock_id").agg(F.count("*").alias("news_days"), F.sum(F.expr("positive + neutral + negative + unanalyzed")).alias("news"), F.sum("negative").alias("negative"))
    moves = data["volatility"].groupBy("stock_id").agg(F.count("move").alias("moves"), F.avg("move").alias("mean_move"))
    lines = data["technicals"].groupBy("stock_id").agg(F.max_by("macd", "date").alias("last_macd"), F.count("rsi14").alias("rsi_days"))
    for more in (data["normal"].select("stock_id", "normal_10d"), days, tones, moves, lines):
        out = out.join(more, "stock_id")
    return rounded(out, "mean_5d", "mean_excess", "normal_10d", "mean_move", "last_macd")


book.oracles["g37_stock_dataset"] = "WITH RECURSIVE " + ad.sql(fr.ALL, f"""{ad.CLASS}, {qs.BURST_HEAT}, {fr.ROWS_SQL}, {qr.AR_ADJ}, lk AS (SELECT CASE WHEN keyword LIKE '%2' THEN upper(keyword) ELSE keyword END AS keyword, stock_id, min(link_type) AS link_type FROM links GROUP BY 1, 2), nms AS (SELECT DISTINCT keyword FROM lk),
ob AS (SELECT t.burst_id, CASE WHEN cl.canonical_keyword IN (SELECT keyword FROM nms) OR cl.canonical_keyword IS NULL THEN coalesce(cl.canonical_keyword, t.keyword) ELSE t.keyword END AS keyword, CAST(t.published_at + INTERVAL 8 HOUR AS DATE) AS date, CAST(regexp_extract(approx_traffic, '(\\d+)', 1) AS DOUBLE) * 1000 AS traffic FROM bursts t LEFT JOIN cl ON cl.keyword = t.keyword WHERE coalesce(cl.canonical_keyword, t.keyword) IN (SELECT keyword FROM nms) OR t.keyword IN (SELECT keyword FROM nms)),
tn AS (SELECT n.news_id, o.keyword, o.date, coalesce(n.news_sentiment, 'Unanalyzed') AS tone FROM news n JOIN ob o USING (burst_id)), hh AS (SELECT keyword, date, trend_score AS heat FROM kh WHERE keyword IN (SELECT keyword FROM nms)), nn AS (SELECT keyword, date, count(*) AS n FROM tn GROUP BY 1, 2), ls AS (SELECT keyword, date, max(traffic) AS traffic FROM ob GROUP BY 1, 2),
al AS (SELECT keyword, date FROM hh UNION SELECT keyword, date FROM nn UNION SELECT keyword, date FROM ls), dys AS (SELECT keyword, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM (SELECT keyword, min(date) AS a, max(date) AS b FROM al GROUP BY 1)),
f AS (SELECT y.keyword, y.date, hh.heat, coalesce(n, 0) AS news_count, traffic FROM dys y LEFT JOIN hh ON hh.keyword = y.keyword AND hh.date = y.date LEFT JOIN nn ON nn.keyword = y.keyword AND nn.date = y.date LEFT JOIN ls ON ls.keyword = y.keyword AND ls.date = y.date),
g AS (SELECT *, CASE WHEN count(heat) OVER s >= 3 THEN avg(heat) OVER s END AS hb, CASE WHEN count(*) OVER s >= 3 THEN avg(news_count) OVER s END AS nb, coalesce(bool_or(traffic IS NOT NULL) OVER t, false) AS rec FROM f WINDOW s AS (PARTITION BY keyword ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY keyword ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
tg AS (SELECT keyword, date FROM g WHERE date >= DATE '{fr.STUDY_START}' AND (coalesce(hb > 0 AND heat / hb - 1 >= 0.5, false) OR coalesce(news_count >= 3 AND news_count >= 2 * nb, false) OR (traffic IS NOT NULL AND NOT rec))),
ee AS (SELECT tg.keyword, tg.date, lk.stock_id FROM tg JOIN lk USING (keyword)), pf AS (SELECT e.keyword, e.stock_id, e.date AS event_date, p.date AS market_date, p.return_5d, p.excess_10d FROM ee e ASOF JOIN perf p ON e.stock_id = p.stock_id AND e.date <= p.date),
ed AS (SELECT stock_id, event_date, arg_min(market_date, keyword) AS market_date FROM pf GROUP BY 1, 2), dn AS (SELECT DISTINCT pf.stock_id, pf.event_date, tn.news_id, tn.tone FROM pf JOIN tn ON tn.keyword = pf.keyword AND tn.date = pf.event_date), dc AS (SELECT stock_id, event_date, count(*) AS n, count(*) FILTER (tone = 'Positive') AS pos FROM dn GROUP BY 1, 2),
mv AS (SELECT *, abs(ar) AS move FROM ar), vv AS (SELECT *, CASE WHEN count(move) OVER r >= 15 THEN avg(move) OVER r END AS recent, CASE WHEN count(move) OVER u >= 25 THEN avg(move) OVER u END AS usual FROM mv WINDOW r AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), u AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND 20 PRECEDING)), vb AS (SELECT stock_id, date, lag(recent / usual) OVER (PARTITION BY stock_id ORDER BY date) AS before FROM vv),
px AS (SELECT stock_id, close AS price, close - lag(close) OVER w AS ch, row_number() OVER w AS k FROM prices WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
em AS (SELECT stock_id, k, price AS e12, price AS e26 FROM px WHERE k = 1 UNION ALL SELECT px.stock_id, px.k, e.e12 * (1 - 2.0::DOUBLE / 13) + px.price * (2.0::DOUBLE / 13), e.e26 * (1 - 2.0::DOUBLE / 27) + px.price * (2.0::DOUBLE / 27) FROM em e JOIN px ON px.stock_id = e.stock_id AND px.k = e.k + 1),
rs AS (SELECT stock_id, count(*) FILTER (k >= 15 AND (up > 0 OR down > 0)) AS rsi_days FROM (SELECT *, avg(greatest(ch, 0)) OVER g AS up, avg(greatest(-ch, 0)) OVER g AS down FROM px WINDOW g AS (PARTITION BY stock_id ORDER BY k ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) GROUP BY 1), lm AS (SELECT stock_id, arg_max(e12 - e26, k) AS last_macd FROM em GROUP BY 1),
a AS (SELECT stock_id, count(*) AS events, avg(return_5d) AS mean_5d, avg(excess_10d) AS mean_excess FROM pf GROUP BY 1), b AS (SELECT ed.stock_id, count(*) AS days, CAST(coalesce(sum(n), 0) AS BIGINT) AS day_news, CAST(coalesce(sum(pos), 0) AS BIGINT) AS positive, count(*) AS last_number, CAST(sum(least(coalesce(n, 0), 5)) AS BIGINT) AS headlines, count(before) AS with_volatility FROM ed LEFT JOIN dc ON dc.stock_id = ed.stock_id AND dc.event_date = ed.event_date LEFT JOIN vb ON vb.stock_id = ed.stock_id AND vb.date = ed.market_date GROUP BY 1),
c AS (SELECT stock_id, count(DISTINCT date) AS news_days, count(*) AS news, count(*) FILTER (tone = 'Negative') AS negative FROM (SELECT DISTINCT lk.stock_id, tn.* FROM tn JOIN lk USING (keyword)) GROUP BY 1), m AS (SELECT stock_id, count(ar) AS moves, avg(abs(ar)) AS mean_move FROM ar GROUP BY 1), nr AS (SELECT stock_id, avg(excess_10d) AS normal_10d FROM perf WHERE date >= DATE '{fr.STUDY_START}' GROUP BY 1)
SELECT stock_id, events, {r6('mean_5d')}, {r6('mean_excess')}, {r6('normal_10d')}, days, day_news, positive, last_number, headlines, with_volatility, news_days, news, negative, moves, {r6('mean_move')}, {r6('last_macd')}, rsi_days FROM a JOIN b USING (stock_id) JOIN c USING (stock_id) JOIN m USING (stock_id) JOIN nr USING (stock_id) JOIN lm USING (stock_id) JOIN rs USING (stock_id)""").removeprefix("WITH ")


@book.add(ad.sql(fr.ALL, f"""{qr.PATHS} SELECT 'paths' AS part, kind, CAST(off AS VARCHAR) AS label, {r6('ap', 'value')}, n FROM ag UNION ALL SELECT 'events', NULL, 'quiet', NULL, count(*) FROM quiet
UNION ALL SELECT 'units', kind, 'units', NULL, count(*) FROM (SELECT DISTINCT kind, unit, day0 FROM fp) GROUP BY 2 UNION ALL SELECT 'period', NULL, '{fr.STUDY_START}/' || CAST(max(date) AS VARCHAR), NULL, count(*) FILTER (date >= DATE '{fr.STUDY_START}') FROM cal"""))
def g38_study(s: SparkSession, d: str) -> DataFrame:
    """Events, units and paths by kind, and the period with its trading days, of the whole study."""
    pairs, daily = fr.study(s, d)
    none = lambda k: F.lit(None).cast(k)
    p = rt.cumulative_paths(pairs, rt.path_windows(daily, fr.STUDY_START)).select(F.lit("paths").alias("part"), "kind", F.col("offset").cast("string").alias("label"), F.col("adjusted_path").alias("value"), "n")
    e = fr.quiet(s, d, fr.STUDY_START).agg(F.lit("events"), none("string"), F.lit("quiet"), none("double"), F.count("*"))
    u = rt.event_units(pairs).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("units"), "kind", F.lit("units"), none("double"), "n")
    days = ad.prices(s, d).where(F.col("stock_id") == ad.BENCHMARK).agg(F.max("date").alias("last"), F.count_if(F.col("date") >= F.lit(fr.STUDY_START).cast("date")).alias("n"))
    t = days.select(F.lit("period"), none("string"), F.concat(F.lit(f"{fr.STUDY_START}/"), F.col("last").cast("string")), none("double"), "n")
    return rounded(p.union(e).union(u).union(t), "value")


@book.add(ad.sql("bursts news links prices", f"""fe AS (SELECT stock_id, date, lead(close, 1) OVER w / close - 1 AS r1, lead(close, 3) OVER w / close - 1 AS r3, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 10) OVER w / close - 1 AS r10 FROM prices WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
ev AS (SELECT DISTINCT t.burst_id, n.news_id, l.stock_id, CAST(t.published_at AS DATE) AS date FROM bursts t JOIN news n USING (burst_id) JOIN links l USING (keyword) WHERE l.link_type = 'direct'), al AS (SELECT f.* FROM ev ASOF JOIN fe f ON ev.stock_id = f.stock_id AND ev.date <= f.date),
long AS (SELECT unnest([{{'h': 1, 'r': r1}}, {{'h': 3, 'r': r3}}, {{'h': 5, 'r': r5}}, {{'h': 10, 'r': r10}}]) AS x FROM al)
SELECT x.h AS holding_days, count(*) AS events, {r6('avg(x.r) * 100', 'mean_pct')}, {r6('avg(CASE WHEN x.r > 0 THEN 1.0 ELSE 0.0 END) * 100', 'win_rate_pct')}, {r6('max(x.r) * 100', 'max_gain_pct')}, {r6('min(x.r) * 100', 'max_loss_pct')} FROM long WHERE x.r IS NOT NULL GROUP BY 1"""))
def g40_event_study(s: SparkSession, d: str) -> DataFrame:
    """The event frame written as the analysis table (S21), read back and summarised (G1)."""
    rows = ad.bursts(s, d).join(ad.news(s, d, "burst_id", "news_sentiment"), "burst_id").join(ad.links(s, d).where("link_type = 'direct'"), "keyword").select("burst_id", "news_id", "keyword", "stock_id", F.to_date("published_at").alias("date"), "news_sentiment")
    table = jobs.event_analysis(rows, ad.prices(s, d), f"{sm.work_folder(s)}/event_analysis")
    return rounded(st.holding_summary(table, "future_return"), "mean_pct", "win_rate_pct", "max_gain_pct", "max_loss_pct")


NOBODY = "k % 5 = 0 OR k % 4 = 0"
#: Keywords that nobody has settled: those of three rests resolve to entities that are no companies, the others to none; rules then settle the even ones of the last rest.
UPDATE = f"""kb AS (SELECT DISTINCT c_custkey AS k, c_name AS keyword, c_mktsegment AS segment FROM customer JOIN bursts ON keyword = c_name WHERE {NOBODY}), rs AS (SELECT * FROM kb WHERE k % 3 < 2), ru AS (SELECT *, k % 6 = 2 AS hit FROM kb),
cz AS (SELECT keyword, theme_name, source FROM cl WHERE keyword NOT IN (SELECT keyword FROM ru) UNION ALL SELECT keyword, CASE WHEN hit THEN segment ELSE '其他' END, CASE WHEN hit THEN 'theme_mapping' ELSE 'fallback' END FROM ru),
td AS (SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS date, theme_name FROM bursts JOIN cz USING (keyword)), mapped AS (SELECT '其他' AS theme_name UNION SELECT segment FROM ru WHERE hit), dy AS (SELECT date FROM heat_px UNION SELECT date FROM td),
ke AS (SELECT date, theme_name FROM dy, mapped UNION SELECT date, theme_name FROM td UNION SELECT date, keyword FROM heat_px)"""


@book.add(ad.sql("bursts news heat_px", f"""{ad.CLASS}, {UPDATE}
SELECT 'mapping' AS step, (SELECT count(*) FROM (SELECT DISTINCT p_brand FROM part)) AS rows UNION ALL SELECT 'resolved', (SELECT count(*) FROM rs) UNION ALL SELECT 'entities', (SELECT count(*) FROM rs) UNION ALL SELECT 'rules', (SELECT count(*) FROM ru) UNION ALL SELECT 'classified', (SELECT count(*) FROM cz)
UNION ALL SELECT 'enriched', (SELECT count(*) FROM news WHERE news_sentiment IS NULL AND news_id % 3 = 0) UNION ALL SELECT 'rolled', (SELECT count(*) FROM news JOIN bursts USING (burst_id)) UNION ALL SELECT 'daily_stats', (SELECT count(*) FROM ke)
UNION ALL SELECT 'retired', (SELECT count(*) FROM cl JOIN customer ON c_name = keyword WHERE source = 'fallback' AND keyword IN (SELECT keyword FROM ru))
UNION ALL SELECT 'unclassified', (SELECT count(*) FROM (SELECT DISTINCT keyword FROM bursts) LEFT JOIN cz USING (keyword) WHERE source IS NULL OR source = 'fallback')"""))
def g41_daily_update(s: SparkSession, d: str) -> DataFrame:
    """The whole daily update over planted tables, and how many rows each step made."""
    c, k = ad.table(s, d, "customer"), F.col("c_custkey")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    none = lambda kind: F.lit(None).cast(kind)
    csv = ad.table(s, d, "part").select(F.lit("科技類").alias("theme_name"), F.col("p_brand").alias("keyword"), F.lit("1001").alias("stock_id"), F.lit("科技類").alias("category")).distinct()
    news = ad.news(s, d).withColumns({"sentiment_score": F.when(F.col("news_sentiment").isNotNull(), 0.5), "event_type": F.when(F.col("news_sentiment").isNotNull(), "kept")})
    suppliers = ad.table(s, d, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("keyword"), F.lit("company").alias("type"), ad.stock_code(F.col("s_suppkey")).alias("stock_id"))
    heat = ad.heat_px(s, d).select("date", F.col("keyword").alias("theme_name"), "keyword", F.col("heat").alias("trend_score"))
    tables = {
        "mapping": csv.where("keyword like '%1'").select("theme_name", "keyword", "stock_id", "category", F.lit("theme").alias("link_type")), "csv": csv, "bursts": ad.bursts(s, d), "news": news, "classified": ad.classes(s, d).select("keyword", "canonical_keyword", "theme_name", "source"), "aliases": suppliers,
        "seeds": c.where("c_custkey % 3 = 0").select(k.alias("ordinal"), name.alias("alias"), name.alias("entity_name"), F.lit("產業").alias("entity_type"), F.lit("").alias("stock_id"), F.lit("半導體").alias("industry"), none("string").alias("theme_name")),
        "official": suppliers.select("stock_id", F.col("keyword").alias("name")), "industries": ad.table(s, d, "nation").select(F.col("n_name").alias("keyword")),
        "predictions": c.where("c_custkey % 3 = 1").select(name.alias("keyword"), name.alias("canonical_entity"), F.lit("產業").alias("entity_type"), F.lit("").alias("stock_id"), F.lit("").alias("industry"), segment.alias("theme_name"), F.lit("0.9").alias("confidence_score")),
        "themes": c.where("c_custkey % 3 = 2 and c_custkey % 2 = 0").select(k.alias("ordinal"), name.alias("keyword"), segment.alias("theme_name"), F.lit("x").alias("sub_theme"), F.lit("1001").alias("stock_id")),
        "links": ad.classes(s, d).where("source = 'fallback'").select(F.lit("其他").alias("theme_name"), "keyword", none("string").alias("stock_id"), none("string").alias("link_type"), F.lit(1).alias("active")),
        "news_predictions": news.where("news_id % 3 = 0").select("news_id", F.lit("Neutral").alias("news_sentiment"), F.lit(0.25).alias("sentiment_score"), F.lit("model").alias("event_type")), "heat": heat, "prices": ad.prices(s, d),
    }
    segments = [r[0] for r in c.select("c_mktsegment").distinct().collect()]
    out = jobs.daily_update(tables, ["產業"], segments, F.expr("timestamp '1998-08-03 20:00:00'"), f"{sm.work_folder(s)}/theme_daily_stats")
    counted = {n: out[n] for n in ("mapping", "resolved", "entities", "rules", "classified", "rolled", "daily_stats")}
    counted["enriched"] = out["news"].where("event_type = 'model'")
    counted["retired"] = out["links"].where("active = 0")
    rows = cv.table_counts(counted).withColumnRenamed("table_name", "step")
    return rows.union(out["status"].select(F.lit("unclassified"), "unclassified_keywords"))


@book.add()
def s22_daily_stats_table(s: SparkSession, d: str) -> DataFrame:
    """Daily statistics written by partition twice; the second writing replaces only its own days."""
    heat = ad.heat_px(s, d).select("date", F.col("keyword").alias("theme_name"), F.col("heat").alias("burst_score"))
    rows = heat.groupBy("date", "theme_name").agg(F.avg("burst_score").alias("avg_score"))
    path = f"{sm.work_folder(s)}/stats"
    jobs.write_months(rows, path)
    jobs.write_months(rows.where("month(date) = 3").withColumn("avg_score", F.col("avg_score") + 1), path)
    return s.read.parquet(path).select("date", "theme_name", "avg_score")


book.oracles["s22_daily_stats_table"] = ad.sql("heat_px", "SELECT date, keyword AS theme_name, heat + CASE WHEN month(date) = 3 THEN 1 ELSE 0 END AS avg_score FROM heat_px")

QUERIES, ORACLES = book.queries, book.oracles
