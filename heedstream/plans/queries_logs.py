"""Registered queries: what the jobs' logs say, status, health and acceptance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedstream.operators import acceptance as ac
from heedstream.operators import coverage as cv
from heedstream.operators import logs as lg
from heedstream.plans._book import Book, r6, rounded
from heedstream.sources import adapters as ad
from heedstream.sources.shared import shared_dir, stage

book = Book()
NTZ = "timestamp_ntz"
BASELINE, CUTOVER, RESET_HOUR = "1993-01-01", "1995-06-01", 15


def job_log(s: SparkSession, d: str, etl: str = "etl", part: int | None = None) -> DataFrame:
    """Orders as runs of the update job, and every fifth as one of the price job too; ``part`` takes the orders of one rest by five."""
    o, k = ad.table(s, d, "orders"), F.col("o_orderkey")
    if part is not None:
        o = o.where(k % 5 == part)
    text = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    n = lambda c: c.cast("string")
    stamp = lambda minute: text("[", F.date_format("o_orderdate", "yyyy/MM/dd"), " ", F.lpad(n(k % 24), 2, " "), f":{minute}:00.10] ")
    busy = k % 5 != 0
    a, b, c = (F.when(busy, x).otherwise(0) for x in ((k % 4) * 10, (k % 3) * 15, (k % 7) * 100))
    code = F.when(k % 4 == 1, 3).when(k % 4 == 2, 1).otherwise(0)
    lines = F.array(
        text(stamp("00"), etl, " start"), F.lit("Gemini Stats"), text("Requests: ", n(k % 6)), text("Models: m-1.5 ", n(k % 6), ", m-2.0 ", n(k % 3)), text("Processed: ", n(a + b + c), " (entity ", n(a), ", keyword ", n(b), ", news ", n(c), ")"),
        F.when(k % 10 == 0, "Skipped: none").otherwise(text("Skipped: keywords ", n(k % 900), ", news ", n(k % 7000))), text("429 Count: ", n(k % 4)), text("503 Count: ", n(k % 3)),
        F.when(k % 9 == 0, "Stopped: all models unavailable (quota)").when(k % 11 == 0, "Stopped: daily limit").otherwise("Stopped: no"), F.when(k % 8 == 0, "[GEMINI] m-2.0 unavailable for this run: quota"), F.when(k % 13 == 0, text("News AI batch failed (20 items): timeout of ", n(k))),
        F.when(k % 17 == 0, "json.decoder.JSONDecodeError: Expecting value"), F.when(k % 14 == 0, "Traceback (most recent call last):"), F.when(k % 6 == 0, "Stopped: Google Trends rate limit").otherwise("Completed"), text("Success: ", n(k % 5)), F.when(k % 7 != 0, "Theme ETL completed: {'rows': 1}"),
        F.when(k % 3 != 0, text(stamp("30"), etl, " exit ", n(code))), F.lit("Requests: 99"))
    each = o.select(F.lit(etl).alias("job"), k.alias("k"), F.posexplode(lines).alias("p", "value"))
    price = F.array(text(stamp("00"), "stock_collector start"), F.when(k % 2 == 0, "寫入 75 筆行情"), F.when(k % 7 != 0, text(stamp("10"), "stock_collector exit ", F.when(k % 4 == 0, "2").otherwise("0"))))
    chosen = o if part is not None else o.where(k % 5 == 0)
    stock = chosen.select(F.lit("stock_collector").alias("job"), k.alias("k"), F.posexplode(price).alias("p", "value"))
    return each.union(stock).where("value is not null").select("job", (F.col("k") * 100 + F.col("p")).alias("line"), "value")


#: The same runs for the oracles.
RUNS = """er AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS run, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS started_at, CASE WHEN o_orderkey % 3 <> 0 THEN CASE o_orderkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END END AS exit_code,
  CASE WHEN o_orderkey % 3 = 0 THEN 99 ELSE o_orderkey % 6 END AS requests, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 * 10 ELSE 0 END AS ta, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 * 15 ELSE 0 END AS tb, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 * 100 ELSE 0 END AS tc,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 900 END AS kw, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 7000 END AS nw, o_orderkey % 4 AS s429, o_orderkey % 3 AS s503,
  CASE WHEN o_orderkey % 9 = 0 THEN 'all models unavailable (quota)' WHEN o_orderkey % 11 = 0 THEN 'daily limit' ELSE 'no' END AS stopped, CAST(o_orderkey % 13 = 0 AS INTEGER) AS failed, CAST(o_orderkey % 17 = 0 AS INTEGER) AS json FROM orders)"""
PERIODS = f"""{RUNS}, pe AS (SELECT *, ta + tb + tc AS processed, CASE WHEN started_at >= TIMESTAMP '{CUTOVER}' THEN 'after' ELSE 'before' END AS period FROM er WHERE started_at >= TIMESTAMP '{BASELINE}'),
sm AS (SELECT period, count(*) AS runs, count(DISTINCT CAST(started_at - INTERVAL {RESET_HOUR} HOUR AS DATE)) AS quota_days, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(processed) AS BIGINT) AS processed, coalesce(sum(processed) / nullif(sum(requests), 0), 0) AS items_per_request,
  CAST(sum(s503) AS BIGINT) AS s503, coalesce(100.0 * sum(s503) / nullif(sum(requests), 0), 0) AS s503_share, CAST(sum(s429) AS BIGINT) AS s429, 100.0 * count(*) FILTER (processed = 0) / count(*) AS zero_runs_share, count(*) FILTER (stopped LIKE 'all models unavailable%') AS all_models_out, count(*) FILTER (stopped <> 'no') AS stopped_runs,
  CAST(sum(failed) AS BIGINT) AS batch_failures, CAST(sum(json) AS BIGINT) AS json_errors, arg_min(k, k) AS k0, arg_max(k, k) AS k1 FROM pe GROUP BY 1),
su AS (SELECT sm.* EXCLUDE (k0, k1), sm.requests / quota_days AS requests_per_quota_day, sm.processed / quota_days AS processed_per_quota_day, a.nw AS news_backlog_first, b.nw AS news_backlog_last, a.kw AS keyword_backlog_first, b.kw AS keyword_backlog_last, greatest(epoch(b.started_at) - epoch(a.started_at), 21600) / 86400.0 AS span,
  (coalesce(b.nw, 0) - coalesce(a.nw, 0)) / (greatest(epoch(b.started_at) - epoch(a.started_at), 21600) / 86400.0) AS news_backlog_per_day, (coalesce(b.kw, 0) - coalesce(a.kw, 0)) / (greatest(epoch(b.started_at) - epoch(a.started_at), 21600) / 86400.0) AS keyword_backlog_per_day FROM sm JOIN pe a ON a.k = sm.k0 JOIN pe b ON b.k = sm.k1)"""
SHARES = ("items_per_request", "s503_share", "zero_runs_share", "requests_per_quota_day", "processed_per_quota_day", "news_backlog_per_day", "keyword_backlog_per_day")
COUNTS = ("runs", "quota_days", "requests", "processed", "s503", "s429", "all_models_out", "stopped_runs", "batch_failures", "json_errors", "news_backlog_first", "news_backlog_last", "keyword_backlog_first", "keyword_backlog_last")


def _periods(s: SparkSession, d: str) -> DataFrame:
    stats = ac.run_stats(job_log(s, d).where("job = 'etl'"))
    return stage(ac.periods(stats, F.lit(BASELINE).cast("timestamp"), F.lit(CUTOVER).cast("timestamp")), "periods")


@book.add(f"WITH {PERIODS} SELECT period, {', '.join(COUNTS)}, {', '.join(map(r6, SHARES))} FROM su")
def l4_cutover(s: SparkSession, d: str) -> DataFrame:
    """L4: runs before and after the cutover."""
    return rounded(ac.cutover_summary(_periods(s, d), RESET_HOUR), *SHARES)


@book.add(f"WITH {PERIODS} SELECT period, t.task, CAST(sum(t.n) AS BIGINT) AS n FROM pe, (SELECT unnest(['entity', 'keyword', 'news']) AS task, unnest([1, 2, 3]) AS i) x, LATERAL (SELECT x.task AS task, CASE x.i WHEN 1 THEN ta WHEN 2 THEN tb ELSE tc END AS n) t GROUP BY 1, 2")
def l4_task_counts(s: SparkSession, d: str) -> DataFrame:
    """L4: items by task, from the counts that lines list."""
    return ac.period_counts(_periods(s, d), ac.run_counts(job_log(s, d).where("job = 'etl'"), "Processed", "task"), "task")


@book.add(f"WITH {PERIODS} SELECT 'requests' AS kind, 'm-1.5' AS name, CAST(sum(k % 6) AS BIGINT) AS n FROM pe WHERE period = 'after' UNION ALL SELECT 'requests', 'm-2.0', CAST(sum(k % 3) AS BIGINT) FROM pe WHERE period = 'after' UNION ALL SELECT 'given up', 'm-2.0: quota', count(*) FROM pe WHERE period = 'after' AND k % 8 = 0")
def l7_models(s: SparkSession, d: str) -> DataFrame:
    """Requests by model after the cutover, and the reasons why models were given up."""
    after, lines = _periods(s, d).where("period = 'after'"), job_log(s, d).where("job = 'etl'")
    used = ac.period_counts(after, ac.run_counts(lines, "Models", "name"), "name").select(F.lit("requests").alias("kind"), "name", "n")
    gone = ac.given_up(lines).join(after.select("job", "run"), ["job", "run"]).groupBy(F.concat_ws(": ", "model", "reason").alias("name")).agg(F.count("*").alias("n"))
    return used.union(gone.select(F.lit("given up"), "name", "n"))


#: News with the time of their fetch, some without a score; needs bursts and news.
FETCHED = "nf AS (SELECT n.*, t.published_at AS fetched_at FROM news n JOIN bursts t USING (burst_id))"
SNAP = f"""{ad.CLASS}, {FETCHED}, mx AS (SELECT max(fetched_at) AS t FROM nf), sn AS (SELECT count(*) AS news_total, count(news_sentiment) AS news_analyzed, count(*) FILTER (fetched_at >= t - INTERVAL 24 HOUR) AS news_24h, count(news_sentiment) FILTER (fetched_at >= t - INTERVAL 24 HOUR) AS news_24h_analyzed, coalesce(100.0 * count(news_sentiment) / nullif(count(*), 0), 0) AS coverage FROM nf, mx),
tn AS (SELECT news_sentiment AS k, count(*) AS n FROM nf WHERE news_sentiment IS NOT NULL GROUP BY 1), so AS (SELECT source AS k, count(*) AS n FROM cl GROUP BY 1)"""


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    n = ad.news(s, d).join(ad.bursts(s, d).select("burst_id", F.col("published_at").cast("timestamp").alias("fetched_at")), "burst_id")
    newest = ad.bursts(s, d).join(ad.news(s, d).select("burst_id"), "burst_id", "left_semi").agg(F.max(F.col("published_at").cast("timestamp")).alias("_t"))
    return ac.snapshot(n.crossJoin(F.broadcast(newest)), ad.classes(s, d), F.col("_t"))


@book.add(ad.sql("bursts news", f"""{SNAP} SELECT taken_at, news_total, news_analyzed, news_24h, news_24h_analyzed, {r6('coverage')}, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM tn) AS sentiments, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM so) AS sources FROM sn, (SELECT unnest([DATE '1998-08-03', DATE '1998-08-04']) AS taken_at)"""))
def l5_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The snapshot with its histograms, taken on two days into the appended history."""
    path = f"{shared_dir(s)}/snapshots-{uuid.uuid4().hex}"
    snap = stage(_snapshot(s, d), "snapshot")
    for day in ("1998-08-03", "1998-08-04"):
        out = ac.append_snapshot(snap.select(F.lit(day).cast("date").alias("taken_at"), "*"), path)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return rounded(out.select("taken_at", "news_total", "news_analyzed", "news_24h", "news_24h_analyzed", "coverage", text("sentiments"), text("sources")), "coverage")


HOURS = (50, 100, 200)
CHECKS = [
    ("news backlog", "-nd >= 1000 AND (h < 72 OR (CASE WHEN coalesce(nl, 0) > 0 THEN nl ELSE 1e9 END) <= 5000)", "nd >= 0 OR (h >= 72 AND nl >= cut)", "runs >= 4", "nd"),
    ("keyword backlog", "kd < 0", "kd > 0", "runs >= 4", "kd"), ("share of 503", "s503_share <= 30", "s503_share >= 50", "runs >= 4", "s503_share"), ("runs without items", "zero_runs_share <= 10", "zero_runs_share >= 30", "runs >= 4", "zero_runs_share"),
    ("items per request", "items_per_request >= 100", "items_per_request < 50", "runs >= 4", "items_per_request"), ("items per quota day", "processed_per_quota_day >= 3000", "processed_per_quota_day < 1000", "runs >= 4 AND quota_days >= 2", "processed_per_quota_day"),
    ("all models out", "all_models_out <= quota_days", "all_models_out > 2 * greatest(quota_days, 1)", "runs >= 4", "all_models_out"), ("coverage", "coverage >= CASE WHEN h >= 168 THEN 60 ELSE 30 END", "h >= 72 AND coverage < 10", "h >= 72", "coverage"),
    ("whole answers", "json_errors = 0 AND batch_failures = 0", "json_errors > 0", "runs >= 1", "json_errors + batch_failures"), ("one sentiment", "top / total <= 0.8", "top / total > 0.8", "total >= 500", "100.0 * top / total"),
]


@book.add(ad.sql("bursts news", f"""{SNAP}, {PERIODS}, rw AS (SELECT h, a.*, coalesce(a.news_backlog_per_day, 0) AS nd, coalesce(a.keyword_backlog_per_day, 0) AS kd, coalesce(a.news_backlog_last, 0) AS nl, coalesce(b.news_backlog_last, 0) AS cut, coverage, (SELECT max(n) FROM tn) AS top, (SELECT sum(n) FROM tn) AS total FROM su a, su b, sn, (SELECT unnest({list(HOURS)}) AS h) WHERE a.period = 'after' AND b.period = 'before')
{' UNION ALL '.join(f"SELECT h AS hours, '{name}' AS check, CASE WHEN NOT ({enough}) THEN 'watching' WHEN {ok} THEN 'pass' WHEN {bad} THEN 'fail' ELSE 'short' END AS verdict, floor(({value}) * 1e6 + 0.5) / 1e6 AS value FROM rw" for name, ok, bad, enough, value in CHECKS)}""").replace(" AS check,", ' AS "check",'))
def l7_acceptance(s: SparkSession, d: str) -> DataFrame:
    """Ten checks, some time after the cutover, after three days and after a week."""
    summary, snap = stage(ac.cutover_summary(_periods(s, d), RESET_HOUR), "summary"), stage(_snapshot(s, d), "snapshot")
    out = [ac.acceptance(summary, snap, float(h)).select(F.lit(h).alias("hours"), "*") for h in HOURS]
    return rounded(out[0].union(out[1]).union(out[2]), "value")


@book.add(f"WITH {PERIODS} SELECT started_at, k * 100 + 10 AS line, 'News AI' AS kind, 20 AS items, 'timeout of ' || k AS message FROM pe WHERE period = 'after' AND failed = 1 ORDER BY k DESC LIMIT 10")
def l7_failures(s: SparkSession, d: str) -> DataFrame:
    """The latest ten failed batches after the cutover, a top-k report."""
    out = ac.latest_failures(job_log(s, d).where("job = 'etl'"), _periods(s, d).where("period = 'after'"))
    return out.withColumn("started_at", F.col("started_at").cast(NTZ))


# ---- status and health ----

#: Classes with entities, and news of which some lack a value; every scenario takes a part of them.
STATUS = f"""{ad.CLASS}, ce AS (SELECT cl.*, CASE WHEN c_custkey % 6 <> 1 THEN c_name END AS entity_name, CASE WHEN c_custkey % 6 = 2 THEN '其他' ELSE '上市公司' END AS entity_type FROM cl JOIN customer ON c_name = keyword), nn AS (SELECT news_id, burst_id, CASE WHEN news_id % 9 > 0 THEN news_title END AS news_title, news_sentiment, CASE WHEN news_id % 4 > 0 THEN 0.5 END AS sentiment_score, 'x' AS event_type FROM news),
good AS (SELECT * FROM ce WHERE source <> 'fallback' AND entity_name IS NOT NULL AND entity_type <> '其他'), gb AS (SELECT * FROM bursts WHERE keyword IN (SELECT keyword FROM good)), gn AS (SELECT * FROM nn WHERE news_sentiment IS NOT NULL AND sentiment_score IS NOT NULL), mt AS (SELECT max(published_at) AS t FROM bursts), mp AS (SELECT max(date) AS p FROM prices)"""


def _status_row(name: str, bursts: str, news: str, hours: int, stock: str, stats: int) -> str:
    return f"""SELECT '{name}' AS scenario, (SELECT count(DISTINCT keyword) FROM {bursts}) AS total_keywords, (SELECT count(DISTINCT keyword) FROM {bursts} JOIN ce USING (keyword)) AS classified_keywords, (SELECT count(DISTINCT b.keyword) FROM {bursts} b LEFT JOIN ce ON ce.keyword = b.keyword WHERE ce.keyword IS NULL OR (ce.source = 'fallback' AND ce.theme_name = '其他')) AS unclassified_keywords,
(SELECT count(DISTINCT b.keyword) FROM {bursts} b LEFT JOIN ce ON ce.keyword = b.keyword WHERE ce.entity_name IS NULL OR ce.entity_type IS NULL OR ce.entity_type = '其他') AS pending_entities, (SELECT count(*) FROM {bursts}) AS event_count, (SELECT count(*) FROM {news}) AS total_news, (SELECT count(*) FROM {news} WHERE news_sentiment IS NOT NULL AND sentiment_score IS NOT NULL AND event_type IS NOT NULL) AS analyzed_news,
(SELECT count(*) FROM {news} WHERE news_title IS NOT NULL AND (news_sentiment IS NULL OR sentiment_score IS NULL OR event_type IS NULL)) AS unanalyzed_news, (SELECT count(*) FROM prices) AS stock_rows, {stock} AS latest_stock_date, (SELECT count(DISTINCT theme_name) FROM links) AS theme_count, (SELECT count(DISTINCT stock_id) FROM links) AS tracked_stock_count, CAST(t AS DATE) - {stats} AS latest_stats_date,
(SELECT CAST(min(published_at) + INTERVAL 8 HOUR AS DATE) FROM {bursts}) AS history_start, (SELECT CAST(max(published_at) + INTERVAL 8 HOUR AS DATE) FROM {bursts}) AS history_end, CAST(t AS TIMESTAMP) + INTERVAL {hours} HOUR AS now FROM mt, mp"""


SCENARIOS = [("as it is", "bursts", "nn", 2, "CAST(t AS DATE)", 0), ("late", "gb", "gn", 60 * 24, "CAST(t AS DATE)", 0), ("settled", "gb", "gn", 2, "CAST(t AS DATE)", 0), ("old prices", "gb", "gn", 2, "CAST(t AS DATE) - 10", 0), ("old statistics", "gb", "gn", 2, "CAST(t AS DATE)", 2), ("open news", "gb", "nn", 2, "CAST(t AS DATE)", 0)]


@book.add(ad.sql("bursts links news prices", f"""{STATUS}, z AS ({' UNION ALL '.join(_status_row(*x) for x in SCENARIOS)})
SELECT * EXCLUDE (now), CASE WHEN now - (SELECT max(published_at) FROM gb) > INTERVAL 24 HOUR AND scenario <> 'as it is' OR now - (SELECT t FROM mt) > INTERVAL 24 HOUR THEN 'stale' WHEN unclassified_keywords > 0 OR unanalyzed_news > 0 OR pending_entities > 0 OR CAST(now + INTERVAL 8 HOUR AS DATE) - latest_stock_date > 3 OR CAST(now + INTERVAL 8 HOUR AS DATE) - latest_stats_date > 1 THEN 'pending' ELSE 'healthy' END AS health FROM z"""))
def g32_system_status(s: SparkSession, d: str) -> DataFrame:
    """G32 in six situations: as the tables are, long after, with everything settled, and with one thing open each."""
    c = ad.classes(s, d).join(ad.table(s, d, "customer").select(F.col("c_name").alias("keyword"), F.col("c_custkey").alias("k")), "keyword")
    c = c.withColumns({"entity_name": F.when(F.col("k") % 6 != 1, F.col("keyword")), "entity_type": F.when(F.col("k") % 6 == 2, "其他").otherwise("上市公司")}).drop("k")
    i = F.col("news_id")
    n = stage(ad.news(s, d).select("news_id", "burst_id", F.when(i % 9 > 0, F.col("news_title")).alias("news_title"), "news_sentiment", F.when(i % 4 > 0, 0.5).alias("sentiment_score"), F.lit("x").alias("event_type")), "news")
    t = ad.bursts(s, d).withColumn("fetched_at", F.col("published_at"))
    good = c.where("source <> 'fallback' and entity_name is not null and entity_type <> '其他'")
    gb, gn = t.join(good.select("keyword"), "keyword", "left_semi"), n.where("news_sentiment is not null and sentiment_score is not null")
    newest, links = t.agg(F.max(F.col("published_at").cast("timestamp")).alias("t")).first()["t"], ad.links(s, d)
    prices, shared = stage(ad.prices(s, d).select("date"), "prices"), {"bursts": t, "gb": gb, "nn": n, "gn": gn}
    at, day, out = F.lit(newest), F.to_date(F.lit(newest)), None
    for name, b, w, hours, stock, stats in SCENARIOS:
        p = prices.withColumn("date", F.date_sub(day, 10 if "- 10" in stock else 0))
        row = cv.system_status(shared[b], shared[w], c, p, links, s.range(1).select(F.date_sub(day, stats).alias("date")), at + F.make_interval(hours=F.lit(hours)))
        row = row.select(F.lit(name).alias("scenario"), "*").drop("latest_burst_at", "earliest_burst_at")
        out = row if out is None else out.union(row)
    return out


@book.add(ad.sql("bursts", f"""{RUNS}, le AS (SELECT arg_max(started_at + INTERVAL 30 MINUTE, k) AS e FROM er WHERE exit_code IS NOT NULL), m AS (SELECT unnest([10, 50, 70, 400, 500, 1500]) AS m, unnest([0, 1]) AS x), mm AS (SELECT a.m, b.x FROM (SELECT unnest([10, 50, 70, 400, 500, 1500]) AS m) a, (SELECT unnest([0, 1]) AS x) b)
SELECT m AS minutes, x = 1 AS ended, (SELECT count(DISTINCT keyword) FROM bursts) AS keywords, CASE WHEN m > 1440 THEN 'red' WHEN m > 60 OR x = 0 OR m / 60.0 > 7 THEN 'yellow' ELSE 'green' END AS light, CASE WHEN x = 1 THEN (SELECT e FROM le) END AS last_etl FROM mm"""))
def g33_live_status(s: SparkSession, d: str) -> DataFrame:
    """The light by the age of the newest burst and of the update job's last exit line, at several moments after both."""
    ended = lg.last_finished(job_log(s, d).where("job = 'etl'")).select(F.col("last_run").alias("last_etl"))
    rows = ended.crossJoin(ad.bursts(s, d).agg(F.count_distinct("keyword").alias("keywords")))
    rows = rows.select("*", F.explode(F.array(*[F.lit(m) for m in (10, 50, 70, 400, 500, 1500)])).alias("minutes")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("ended"))
    last = F.when(F.col("ended"), F.col("last_etl"))
    now = F.col("last_etl") + F.make_interval(mins=F.col("minutes"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 3600
    return rows.select("minutes", "ended", "keywords", cv.live_status(F.col("minutes"), hours).alias("light"), last.cast(NTZ).alias("last_etl"))


MOMENTS = (30, 1200, 3000)
PART = """SELECT {v} AS v, (SELECT arg_max({{'s': started_at, 'x': exit_code, 'k': k}}, k) FROM er WHERE k % 5 = {v}) AS e, (SELECT arg_max({{'x': CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END END}}, k) FROM er WHERE k % 5 = {v}) AS p,
(SELECT max(started_at) FILTER (k = (SELECT max(k) FROM er WHERE k % 5 = {v} AND CASE WHEN exit_code IS NOT NULL THEN exit_code IN (0, 3) ELSE k % 7 <> 0 AND k % 14 <> 0 END)) FROM er) AS etl_success, (SELECT max(started_at) FILTER (k = (SELECT max(k) FROM er WHERE k % 5 = {v} AND CASE WHEN k % 7 <> 0 THEN k % 4 <> 0 ELSE k % 2 = 0 END)) FROM er) AS stock_success,
(SELECT max(started_at) FILTER (k = (SELECT max(k) FROM er WHERE k % 5 = {v} AND k % 5 > 0)) FROM er) AS heat_success, (SELECT max(started_at) FILTER (k = (SELECT max(k) FROM er WHERE k % 5 = {v} AND ta + tb + tc > 0)) FROM er) AS models_success"""


@book.add(ad.sql("news", f"""{RUNS}, pt AS ({' UNION ALL '.join(PART.format(v=v) for v in (0, 1, 2, 3))}), nc AS (SELECT count(news_sentiment) AS a, count(*) AS t FROM news),
f AS (SELECT pt.*, m, e.s + to_minutes(m) AS now, CAST(e.s + to_minutes(m) AS DATE) AS day, pr.ta + pr.tb + pr.tc AS done, pr.stopped, e.k % 6 = 0 AS hs, (9 - 3 * v) / 10.0 AS ratio, CASE WHEN v = 3 THEN t * 3 ELSE t END AS t, a FROM pt JOIN er pr ON pr.k = e.k, nc, (SELECT unnest({list(MOMENTS)}) AS m)),
ex AS (SELECT *, day - CASE WHEN hour(now) * 60 + minute(now) >= 1110 THEN 0 ELSE 1 END AS e0 FROM f), ed AS (SELECT *, e0 - greatest(CAST(isodow(e0) AS INTEGER) - 5, 0) AS expected FROM ex),
g AS (SELECT v, now, stock_success, etl_success, heat_success, models_success, CASE WHEN m <= 30 THEN CASE WHEN v > 0 THEN 'WARN' ELSE 'OK' END WHEN m <= 120 THEN 'WARN' ELSE 'FAIL' END AS rss, CASE WHEN p.x <> 0 THEN 'FAIL' WHEN day - v >= expected THEN 'OK' WHEN day - v >= expected - (CASE isodow(expected) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END) THEN 'WARN' ELSE 'FAIL' END AS stocks,
  CASE WHEN day - 1 - v < day - 3 OR ratio < 0.2 THEN 'FAIL' WHEN v = 0 AND ratio >= 0.8 AND NOT hs THEN 'OK' ELSE 'WARN' END AS bursts, CASE WHEN stopped = 'no' THEN CASE WHEN a / t < 0.5 THEN 'WARN' ELSE 'OK' END WHEN done > 0 THEN 'WARN' ELSE 'FAIL' END AS models,
  CASE WHEN m > 26 * 60 THEN 'FAIL' WHEN CASE WHEN e.x IS NOT NULL THEN e.x IN (0, 3) ELSE e.k % 7 <> 0 AND e.k % 14 <> 0 END THEN CASE WHEN day - v < day - 1 THEN 'WARN' ELSE 'OK' END WHEN e.x IS NULL THEN 'WARN' ELSE 'FAIL' END AS etl FROM ed),
h AS (SELECT *, {' + '.join(f"CASE {c} WHEN 'OK' THEN 20 WHEN 'FAIL' THEN 0 ELSE 10 END" for c in cv.COMPONENTS)} AS score FROM g)
SELECT *, CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 60 THEN 'attention' ELSE 'failing' END AS grade, 'FAIL' IN ({', '.join(cv.COMPONENTS)}) AS failing FROM h"""))
def g35_component_health(s: SparkSession, d: str) -> DataFrame:
    """G35 of four systems (orders by their rest by five) at three moments after the last run, each with older data than the one before."""
    total = ad.news(s, d, "news_sentiment").agg(F.count("news_sentiment").alias("analyzed"), F.count("*").alias("total_news"))
    facts = None
    for v in (0, 1, 2, 3):
        one = cv.log_facts(job_log(s, d, part=v)).withColumn("v", F.lit(v))
        facts = one if facts is None else facts.unionByName(one)
    v = F.col("v")
    facts = facts.crossJoin(total).select("*", F.explode(F.array(*[F.lit(m) for m in MOMENTS])).alias("m")).withColumn("now", F.col("etl_started") + F.make_interval(mins=F.col("m")))
    day = F.to_date("now")
    facts = facts.withColumns({"rss_minutes": F.col("m").cast("double"), "warnings": v, "stock_day": F.date_sub(day, v), "heat_day": F.date_sub(day, v + 1), "fresh": 9 - 3 * v, "active": F.lit(10), "stats_day": F.date_sub(day, v), "total_news": F.col("total_news") * F.when(v == 3, 3).otherwise(1)})
    plain = lambda c: F.col(c).cast(NTZ).alias(c)
    return cv.component_health(facts).select("v", plain("now"), *[plain(c) for c in ("stock_success", "etl_success", "heat_success", "models_success")], *cv.COMPONENTS, "score", "grade", "failing")


QUERIES, ORACLES = book.queries, book.oracles
