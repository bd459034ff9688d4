"""Polled collection as Structured Streaming jobs.

Sources are streams of observations with an event time; sinks are tables in
a folder that all machines share, with the checkpoint beside them, so that a
restart goes on where the last finished batch ended. All jobs can run to the
end of what has landed (``availableNow``) or continuously.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heedstream.operators.events import QUIET_DAYS
from heedstream.operators.upsert import fold_bursts
from heedstream.sources.shared import fresh_path


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return fresh_path(spark, "stream")


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run an append stream to the end of its input into a Parquet table and read the table."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


class Folded:
    """A table that each batch adds to, kept as runs of rows that ``fold`` brings together.

    ``fold`` gives the same table from the rows of all batches as from the
    folds of some of them. A batch writes its own rows as a run of level 0
    (``run-0-<batch>``); ``every`` runs of a level are folded into one of the
    next, so that a row is rewritten once a level and runs grow with the
    logarithm of the batches. A run is written by ``buckets`` parts of its keys.
    Which runs make up the table says the manifest of the last finished
    batch, a file that appears as a whole. Folders that it doesn't name are
    deleted when the next batch begins: by then the stream has committed the batch of
    that manifest, so a restart, which runs the batch after it again, still
    finds all that it reads. A batch that is run again starts from the manifest before its own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, fold: Callable[[DataFrame], DataFrame], every: int = 8, buckets: int = 8) -> None:  # noqa: ANN001
        self.spark, self.folder, self.schema, self.fold, self.every, self.buckets = spark, folder, schema, fold, every, buckets

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):  # noqa: ANN202
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return [f.getPath().getName() for f in self._store().globStatus(self._path(pattern)) or ()]

    def manifests(self) -> list[int]:
        """The batches of which a manifest exists."""
        return sorted(int(n[9:]) for n in self._names("manifest-*") if n[9:].isdigit())

    def runs(self, before: int | None = None) -> list[str]:
        """The runs of the last manifest (of a batch under ``before``)."""
        last = max((n for n in self.manifests() if before is None or n < before), default=None)
        return [] if last is None else [r["value"] for r in self.spark.read.text(f"{self.folder}/manifest-{last}").collect()]

    def _rows(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.fold(self._rows(self.runs()))

    def before(self, batch: int) -> DataFrame:
        """The table as it was before a batch, whether that has been run or not."""
        return self.fold(self._rows(self.runs(batch)))

    def _put(self, rows: DataFrame, name: str) -> str:
        names = [f.name for f in self.schema.fields]
        self.fold(rows.select(*names)).select(*names).coalesce(self.buckets).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name

    def write(self, df: DataFrame, batch: int) -> None:
        live = self.runs(batch)
        older = [n for n in self.manifests() if n < batch]
        for name in set(self._names("run-*")) - set(live):
            if int(name.split("-")[2]) <= batch:
                self._store().delete(self._path(name), True)
        for n in older[:-1]:
            self._store().delete(self._path(f"manifest-{n}"), False)
        live.append(self._put(df, f"run-0-{batch}"))
        level = 0
        while len(own := [r for r in live if r.startswith(f"run-{level}-")]) >= self.every:
            live = [r for r in live if r not in own]
            live.append(self._put(self._rows(own), f"run-{level + 1}-{batch}"))
            level += 1
        out = self._store().create(self._path(f"_manifest-{batch}"), True)
        out.write(bytearray("\n".join(live).encode()))
        out.close()
        self._store().delete(self._path(f"manifest-{batch}"), False)
        if not self._store().rename(self._path(f"_manifest-{batch}"), self._path(f"manifest-{batch}")):
            raise OSError(f"the manifest of batch {batch} could not be put in place")


def collect(stream: DataFrame, folder: str, every: int = 8) -> tuple[DataFrame, DataFrame]:
    """Polls (keyword, published_at, fetched_at, approx_traffic) to the table of bursts and the observation log.

    Polling again changes nothing but traffic. Called again with the same
    folder, the job goes on behind the last finished batch.
    """
    spark = stream.sparkSession
    key = ["keyword", "published_at", "fetched_at"]
    rows = stream.select(*key, "approx_traffic").withColumn("last_fetched_at", F.col("fetched_at"))
    bursts = Folded(spark, f"{folder}/bursts", rows.schema, fold_bursts, every)
    log = Folded(spark, f"{folder}/log", stream.select(*key).schema, lambda df: df.distinct(), every)

    def each(batch: DataFrame, number: int) -> None:
        bursts.write(batch, number)
        log.write(batch, number)

    drain_batches(rows, folder, each)
    return bursts.read().drop("last_fetched_at"), log.read()


COUNTERS = "batch long, items long, new_trends long, updated_trends long, new_news long, skipped_items long, failed_items long"


def collect_items(stream: DataFrame, folder: str, every: int = 8) -> dict[str, DataFrame]:
    """T1 with S5: feed items (batch, fetched_at, keyword, published_at, approx_traffic, usable, broken, news) to bursts, news and six counters a batch.

    The counters are observed while the batch's rows are written; what is new is what the
    tables before the batch don't have, so that a batch that is run again counts the same.
    """
    spark = stream.sparkSession
    key = ["keyword", "published_at"]
    burst = "keyword string, published_at timestamp, fetched_at timestamp, approx_traffic string, last_fetched_at timestamp"
    bursts = Folded(spark, f"{folder}/bursts", spark.createDataFrame([], burst).schema, fold_bursts, every)
    told = Folded(spark, f"{folder}/news", spark.createDataFrame([], "keyword string, published_at timestamp, news_url string, news_id struct<fetched_at:timestamp,position:int>, news_title string, news_source string").schema,
                  lambda df: df.groupBy(*key, "news_url").agg(F.min("news_id").alias("news_id"), F.min_by("news_title", "news_id").alias("news_title"), F.min_by("news_source", "news_id").alias("news_source")), every)
    counts = Folded(spark, f"{folder}/counts", spark.createDataFrame([], COUNTERS).schema, lambda df: df.groupBy("batch").agg(*[F.max(c).alias(c) for c in COUNTER_NAMES]), every, buckets=1)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        good = batch.where("usable and not broken")
        known = bursts.before(number).select(*key, F.lit(True).alias("_known"))
        items, news = Observation(f"items {number}"), Observation(f"news {number}")
        # of the items of a key the first one is new, if the key is
        first = F.row_number().over(Window.partitionBy(*key).orderBy("fetched_at")) == 1
        rows = good.join(known, key, "left").withColumn("_new", F.col("_known").isNull() & first)
        rows = rows.observe(items, F.count("*").alias("stored"), F.count_if("_new").alias("new"))
        bursts.write(rows.withColumn("last_fetched_at", F.col("fetched_at")), number)
        each_news = good.select(*key, "fetched_at", F.posexplode("news").alias("position", "n")).select(*key, F.col("n.news_item_url").alias("news_url"), F.struct("fetched_at", "position").alias("news_id"), F.col("n.news_item_title").alias("news_title"), F.col("n.news_item_source").alias("news_source"))
        fresh = told.fold(each_news).join(told.before(number).select(*key, "news_url"), [*key, "news_url"], "left_anti")
        told.write(fresh.observe(news, F.count("*").alias("new")), number)
        seen = batch.agg(F.count_if("usable").alias("items"), F.count_if(~F.col("usable")).alias("skipped"), F.count_if(F.col("usable") & F.col("broken")).alias("failed")).first()
        stored, new = items.get["stored"], items.get["new"]
        counts.write(spark.createDataFrame([(number, seen["items"], new, stored - new, news.get["new"], seen["skipped"], seen["failed"])], COUNTERS), number)
        batch.unpersist()

    drain_batches(stream, folder, each)
    return {"bursts": bursts.read().drop("last_fetched_at"), "news": told.read().drop("news_id"), "counts": counts.read()}


COUNTER_NAMES = [c.split()[0] for c in COUNTERS.split(", ")[1:]]


def dedupe(stream: DataFrame, keys: list[str], time: str, late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def list_sessions(stream: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Time on the list and growth of traffic of each burst; a session ends after an hour without the burst."""
    out = stream.withWatermark("observed_at", late).groupBy("burst_id", F.session_window("observed_at", gap).alias("w")).agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.min_by("traffic", "observed_at").alias("first_traffic"), F.max_by("traffic", "observed_at").alias("last_traffic"), F.count("*").alias("polls"))
    return out.drop("w")


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """T4: rows by burst and Taipei day (UTC days that begin at 16:00)."""
    out = stream.withWatermark("observed_at", late).groupBy("burst_id", F.window("observed_at", "1 day", startTime="16 hours").alias("w")).agg(F.count("*").alias("polls"))
    return out.select("burst_id", F.date_add(F.to_date("w.start"), 1).alias("day"), "polls")


def freshness(stream: DataFrame, folder: str) -> DataFrame:
    """T5: the newest row of each source, kept up to date batch by batch."""
    newest = stream.groupBy("source").agg(F.max("observed_at").alias("newest"))
    table = Folded(stream.sparkSession, f"{folder}/freshness", newest.schema, lambda df: df.groupBy("source").agg(F.max("newest").alias("newest")))
    drain_batches(newest, folder, table.write, "update")
    return table.read()


def new_listings(stream: DataFrame, late: str = "40 days", quiet: int = QUIET_DAYS) -> DataFrame:
    """(keyword, day) of listings after more than ``quiet`` days off the list.

    The state of a keyword is its last listed day; it is dropped once the
    watermark has passed the quiet days after it, when it can't hold back
    an event any more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        days = sorted({d for pdf in batches for d in pd.to_datetime(pdf["observed_at"]).dt.floor("D")})
        last = state.get[0] if state.exists else None
        out = []
        for d in days:
            number = d.toordinal()
            if last is None or number - last > quiet:
                out.append(d)
            last = number if last is None else max(last, number)
        state.update((last,))
        ends = (pd.Timestamp.fromordinal(last + quiet + 1).tz_localize("UTC").timestamp()) * 1000
        state.setTimeoutTimestamp(max(int(ends), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"keyword": [key[0]] * len(out), "day": out}).assign(day=lambda x: pd.to_datetime(x["day"]).dt.date)

    return stream.withWatermark("observed_at", late).groupBy("keyword").applyInPandasWithState(step, "keyword string, day date", "last int", "append", GroupStateTimeout.EventTimeTimeout)
