"""Before and after a change of the update job: what its log says of each run, compared and judged.

Log lines are those of ``operators.logs``. A run here lasts from its start to
its exit line; what stands between runs belongs to none, and runs that printed no
request count are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedstream.operators.logs import sessions

# Fixed forms of the job's lines.
UNAVAILABLE = r"^\[GEMINI\] (\S+) unavailable for this run: (.*)$"
BATCH_FAILED = r"^(Entity AI|Keyword AI|Auto keyword classification|News AI) batch failed \((\d+) \w+\): (.*)$"
JSON_ERROR = r"JSONDecodeError|Expecting value|Unterminated string|Expecting ',' delimiter"
NUMBER = r"^{head}: (\d+)"


def run_lines(lines: DataFrame) -> DataFrame:
    """Lines of all runs that stand between start and exit."""
    return sessions(lines).where("run > 0 and mark = '' and (exit_line is null or line < exit_line)")


def run_stats(lines: DataFrame) -> DataFrame:
    """L4: one row for each run with a request count: what its last lines of each kind say, and how much went wrong.

    Everything about a run is one aggregation of its lines.
    """
    value = F.col("value")
    last = lambda head: F.max_by(F.regexp_extract(value, NUMBER.format(head=head), 1).try_cast("long"), F.when(value.rlike(NUMBER.format(head=head)), F.col("line")))
    skipped = r"keywords (\d+), news (\d+)"
    has = value.startswith("Skipped: ") & value.rlike(skipped)
    backlog = lambda k: F.max_by(F.regexp_extract(value, skipped, k).try_cast("long"), F.when(has, F.col("line")))
    stopped = value.startswith("Stopped: ") & ~value.startswith("Stopped: Google")
    zero = F.lit(0).cast("long")
    out = run_lines(lines).groupBy("job", "run").agg(
        F.max("started_at").alias("started_at"), F.max("exit_code").alias("exit_code"), last("Requests").alias("requests"), F.coalesce(last("Processed"), zero).alias("processed"),
        backlog(1).alias("keyword_backlog"), backlog(2).alias("news_backlog"), F.coalesce(last("429 Count"), zero).alias("s429"), F.coalesce(last("503 Count"), zero).alias("s503"),
        F.coalesce(F.max_by(F.trim(F.substr(value, F.lit(10))), F.when(stopped, F.col("line"))), F.lit("no")).alias("stopped"), F.count_if(value.rlike(BATCH_FAILED)).alias("batch_failures"), F.count_if(value.rlike(JSON_ERROR)).alias("json_errors"))
    return out.where("requests is not null")


def run_counts(lines: DataFrame, head: str, name: str) -> DataFrame:
    """L4: counts by name that lines such as ``Models: a 3, b 1`` or ``Processed: 4 (news 3, entity 1)`` list, summed by run."""
    value = F.col("value")
    listed = F.when(value.contains("("), F.substr(value, F.instr(value, "("))) if head == "Processed" else F.substr(value, F.lit(len(head) + 3))
    pair = r"(\w+) (\d+)" if head == "Processed" else r"([\w.-]+) (\d+)"
    rows = run_lines(lines).where(value.startswith(f"{head}: ")).select("job", "run", F.explode(F.arrays_zip(F.regexp_extract_all(listed, F.lit(pair), 1).alias("name"), F.regexp_extract_all(listed, F.lit(pair), 2).alias("n"))).alias("p"))
    return rows.groupBy("job", "run", F.col("p.name").alias(name)).agg(F.sum(F.col("p.n").cast("long")).alias("n"))


def periods(stats: DataFrame, baseline: Column, cutover: Column) -> DataFrame:
    """Runs since the baseline, marked ``before`` or ``after`` the cutover; earlier ones are left out."""
    at = F.col("started_at")
    return stats.withColumn("period", F.when(at >= cutover, "after").when(at >= baseline, "before")).where("period is not null")


def cutover_summary(stats: DataFrame, reset_hour: int) -> DataFrame:
    """L4: the measures of each period's runs in one row. A quota day begins at ``reset_hour``; changes of the backlog are by day between first and last run, of which a quarter counts at least."""
    day = F.to_date(F.col("started_at") - F.make_interval(hours=F.lit(reset_hour)))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    requests, processed, days = F.sum("requests"), F.sum("processed"), F.count_distinct(day)
    end = lambda c, pick: pick(F.struct(F.col(c).alias("v")), "run")["v"]  # noqa: E731  also where the value is null
    span = F.greatest((F.unix_timestamp(F.max_by("started_at", "run")) - F.unix_timestamp(F.min_by("started_at", "run"))) / 86400, F.lit(0.25))
    change = lambda c: (F.coalesce(end(c, F.max_by), F.lit(0)) - F.coalesce(end(c, F.min_by), F.lit(0))) / span
    return stats.groupBy("period").agg(
        F.count("*").alias("runs"), days.alias("quota_days"), requests.alias("requests"), processed.alias("processed"), share(processed, requests).alias("items_per_request"), (requests / days).alias("requests_per_quota_day"), (processed / days).alias("processed_per_quota_day"),
        F.sum("s503").alias("s503"), (share(F.sum("s503"), requests) * 100).alias("s503_share"), F.sum("s429").alias("s429"), (F.avg((F.col("processed") == 0).cast("double")) * 100).alias("zero_runs_share"),
        F.count_if(F.col("stopped").startswith("all models unavailable")).alias("all_models_out"), F.count_if(F.col("stopped") != "no").alias("stopped_runs"), F.sum("batch_failures").alias("batch_failures"), F.sum("json_errors").alias("json_errors"),
        end("news_backlog", F.min_by).alias("news_backlog_first"), end("news_backlog", F.max_by).alias("news_backlog_last"), end("keyword_backlog", F.min_by).alias("keyword_backlog_first"), end("keyword_backlog", F.max_by).alias("keyword_backlog_last"),
        change("news_backlog").alias("news_backlog_per_day"), change("keyword_backlog").alias("keyword_backlog_per_day"))


def period_counts(stats: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """L4: counts by name summed over each period's runs."""
    return stats.select("job", "run", "period").join(counts, ["job", "run"]).groupBy("period", name).agg(F.sum("n").alias("n"))


def given_up(lines: DataFrame) -> DataFrame:
    """(job, run, model, reason) of models that a run gave up."""
    value = F.col("value")
    return run_lines(lines).where(value.rlike(UNAVAILABLE)).select("job", "run", F.regexp_extract(value, UNAVAILABLE, 1).alias("model"), F.regexp_extract(value, UNAVAILABLE, 2).alias("reason"))


def latest_failures(lines: DataFrame, stats: DataFrame, most: int = 10) -> DataFrame:
    """The last failed batches of the runs in ``stats``."""
    value = F.col("value")
    part = lambda k: F.regexp_extract(value, BATCH_FAILED, k)
    rows = run_lines(lines).where(value.rlike(BATCH_FAILED)).select("job", "run", "line", part(1).alias("kind"), part(2).cast("long").alias("items"), F.substr(part(3), F.lit(1), F.lit(120)).alias("message"))
    return rows.join(stats.select("job", "run", "started_at"), ["job", "run"]).orderBy(F.col("line").desc()).limit(most).select("started_at", "line", "kind", "items", "message")


def snapshot(news: DataFrame, classified: DataFrame, now: Column) -> DataFrame:
    """One row: news, analysed news and their share, the same of the last day by fetch, and histograms of sentiments and class sources as maps."""
    tone = F.col("news_sentiment").isNotNull()
    recent = F.col("fetched_at") >= now - F.expr("interval 24 hours")
    n = news.agg(F.count("*").alias("news_total"), F.count_if(tone).alias("news_analyzed"), F.count_if(recent).alias("news_24h"), F.count_if(recent & tone).alias("news_24h_analyzed"))
    n = n.withColumn("coverage", F.coalesce(F.try_divide(100.0 * F.col("news_analyzed"), F.col("news_total")), F.lit(0.0)))
    counts = lambda df, key, name: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    sources = classified.withColumn("source", F.coalesce("source", F.lit("none")))
    return n.crossJoin(counts(news.where(tone), "news_sentiment", "sentiments")).crossJoin(counts(sources, "source", "sources"))


def append_snapshot(taken: DataFrame, path: str, most: int = 10) -> DataFrame:
    """The snapshot (with ``taken_at``) appended to the history at ``path``; returns the latest ``most`` of it."""
    taken.write.mode("append").parquet(path)
    return taken.sparkSession.read.schema(taken.schema).parquet(path).orderBy(F.col("taken_at").desc()).limit(most)


def acceptance(summary: DataFrame, snap: DataFrame, hours: Column | float) -> DataFrame:
    """Ten checks of the period after, each ``watching`` until enough was seen, then ``pass``, ``fail`` or ``short``.

    ``summary`` has one row a period (none is as good as no runs), ``snap`` is one row,
    ``hours`` the time since the cutover. The checks are a table of conditions over
    one row of measures.
    """
    after = summary.where("period = 'after'").drop("period")
    before = summary.where("period = 'before'").select(F.col("news_backlog_last").alias("cut_news"))
    one = snap.select("coverage", "sentiments", F.lit(hours).cast("double").alias("hours"))
    row = one.join(after, F.lit(True), "left").join(before, F.lit(True), "left")
    c = lambda name, missing=0.0: F.coalesce(F.col(name).cast("double"), F.lit(float(missing)))
    some = c("runs") >= 4
    three, seven = F.col("hours") >= 72, F.col("hours") >= 168
    tones = F.map_values("sentiments")
    total = F.aggregate(tones, F.lit(0).cast("long"), lambda a, x: a + x)
    largest = F.try_divide(F.coalesce(F.array_max(tones), F.lit(0)).cast("double"), F.when(total > 0, total).otherwise(1))
    checks = [
        ("news backlog", (-c("news_backlog_per_day") >= 1000) & (~three | (F.when(c("news_backlog_last") > 0, c("news_backlog_last")).otherwise(1e9) <= 5000)), (c("news_backlog_per_day") >= 0) | (three & (c("news_backlog_last") >= c("cut_news"))), some, c("news_backlog_per_day")),
        ("keyword backlog", c("keyword_backlog_per_day") < 0, c("keyword_backlog_per_day") > 0, some, c("keyword_backlog_per_day")),
        ("share of 503", c("s503_share", 100) <= 30, c("s503_share") >= 50, some, c("s503_share")),
        ("runs without items", c("zero_runs_share", 100) <= 10, c("zero_runs_share") >= 30, some, c("zero_runs_share")),
        ("items per request", c("items_per_request") >= 100, c("items_per_request") < 50, some, c("items_per_request")),
        ("items per quota day", c("processed_per_quota_day") >= 3000, c("processed_per_quota_day") < 1000, some & (c("quota_days") >= 2), c("processed_per_quota_day")),
        ("all models out", c("all_models_out") <= c("quota_days"), c("all_models_out") > 2 * F.greatest(c("quota_days"), F.lit(1.0)), some, c("all_models_out")),
        ("coverage", F.col("coverage") >= F.when(seven, 60).otherwise(30), three & (F.col("coverage") < 10), three, F.col("coverage")),
        ("whole answers", (c("json_errors") == 0) & (c("batch_failures") == 0), c("json_errors") > 0, c("runs") >= 1, c("json_errors") + c("batch_failures")),
        ("one sentiment", largest <= 0.8, largest > 0.8, total >= 500, largest * 100),
    ]
    verdict = lambda ok, bad, enough: F.when(~enough, "watching").when(ok, "pass").when(bad, "fail").otherwise("short")
    table = F.array(*[F.struct(F.lit(name).alias("check"), verdict(ok, bad, enough).alias("verdict"), value.alias("value")) for name, ok, bad, enough, value in checks])
    return row.select(F.explode(table).alias("r")).select("r.*")
