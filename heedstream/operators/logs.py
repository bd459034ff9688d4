"""Log lines as tables: runs, blocks of key and value, errors, summaries.

Lines are rows (job, line, value). A job's log may be long, so runs are
counted in two steps: the starts of every block of ``BLOCK`` lines first, then
the lines of a block from what came before it. Windows run within a block or
a run; over a whole job only one row for each block is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed forms of the markers.
RUN = r"^\[(\d{4}/\d{2}/\d{2})\s+(\d{1,2}:\d{2}:\d{2})[^\]]*\]\s+(\S+)\s+(start|exit)(?:\s+(-?\d+))?"
KEY_VALUE = r"^([A-Za-z0-9][A-Za-z0-9 ]*):\s*(.*)$"
#: Heads of blocks: (name, whole lines, beginnings of lines).
HEADS = (("gemini", ("Gemini Stats",), ()), ("history", ("Completed",), ("Stopped: Google Trends",)))
BLOCK = 4096
ERROR = r"(?i)\berror\b|exception|traceback|failed"


def sessions(lines: DataFrame) -> DataFrame:
    """L1: lines with the run they belong to, the run's start, its exit code and the line of its first exit; lines before a start have run 0."""
    text = F.trim("value")
    parts = [F.regexp_extract(text, RUN, k) for k in range(1, 6)]
    kind = parts[3]
    stamp = F.try_to_timestamp(F.concat_ws(" ", parts[0], F.lpad(parts[1], 8, "0")), F.lit("yyyy/MM/dd HH:mm:ss"))
    out = lines.withColumn("mark", kind).withColumn("_code", F.when(kind == "exit", parts[4].try_cast("int"))).withColumn("_start", F.when(kind == "start", stamp))
    out = out.withColumn("_block", F.floor(F.col("line") / BLOCK))
    blocks_ = out.groupBy("job", "_block").agg(F.count_if(F.col("mark") == "start").alias("_starts"))
    before = F.sum("_starts").over(Window.partitionBy("job").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    out = out.join(blocks_.select("job", "_block", F.coalesce(before, F.lit(0)).alias("_before")), ["job", "_block"])
    by = Window.partitionBy("job", "_block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("run", (F.col("_before") + F.sum((F.col("mark") == "start").cast("int")).over(by)).cast("long"))
    # what a run's marks say is summed and joined back, so that a run of any length needs no window of its own
    marks = out.where("mark <> '' and run > 0").groupBy("job", "run").agg(F.max("_start").alias("started_at"), F.max_by("_code", F.when(F.col("mark") == "exit", F.col("line"))).alias("exit_code"), F.min(F.when(F.col("mark") == "exit", F.col("line"))).alias("exit_line"))
    return out.drop("_code", "_start", "_block", "_before").join(marks, ["job", "run"], "left")


def runs(lines: DataFrame) -> DataFrame:
    """One row for each run."""
    return sessions(lines).where("run > 0").groupBy("job", "run").agg(F.max("started_at").alias("started_at"), F.max("exit_code").alias("exit_code"), F.count_if(F.col("mark") == "").alias("lines"))


def blocks(lines: DataFrame, heads: tuple = HEADS) -> DataFrame:
    """L2: (job, run, block, key, value) of ``Key: value`` lines behind a block's head; another line ends the block, the last value of a key counts."""
    text = F.trim("value")
    head = F.lit(None).cast("string")
    for name, whole, begins in heads:
        is_head = text.isin(*whole)
        for b in begins:
            is_head = is_head | text.startswith(b)
        head = F.coalesce(head, F.when(is_head, name))
    pair = text.rlike(KEY_VALUE) & ~text.startswith("[") & head.isNull()
    by = Window.partitionBy("job", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = sessions(lines).where("run > 0").withColumn("_head", head).withColumn("_pair", pair).withColumn("_text", text)
    rows = rows.withColumn("_part", F.sum((~F.col("_pair")).cast("int")).over(by))
    part = Window.partitionBy("job", "run", "_part")
    rows = rows.withColumn("block", F.max("_head").over(part)).where("block is not null")
    keyed = rows.select("job", "run", "block", "line", F.when(F.col("_head").isNotNull(), F.when(F.col("block") == "history", "status")).otherwise(F.trim(F.regexp_extract("_text", KEY_VALUE, 1))).alias("key"), F.when(F.col("_head").isNotNull(), F.col("_text")).otherwise(F.trim(F.regexp_extract("_text", KEY_VALUE, 2))).alias("value"))
    return keyed.where("key is not null").groupBy("job", "run", "block", "key").agg(F.max_by("value", "line").alias("value"))


def leading_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def result_values(lines: DataFrame, prefix: str) -> DataFrame:
    """L2: the dictionary that the run's last result line prints, as a map of texts."""
    found = sessions(lines).where(F.col("value").startswith(prefix)).groupBy("job", "run").agg(F.max_by("value", "line").alias("v"))
    body = F.regexp_replace(F.substr("v", F.lit(len(prefix) + 1)), r"[{}']", "")
    return found.select("job", "run", F.str_to_map(F.regexp_replace(body, r"\s*([,:])\s*", "$1"), F.lit(","), F.lit(":")).alias("result"))


def last_errors(lines: DataFrame, most: int = 5) -> DataFrame:
    """L3: the last distinct error lines of each job, by their first appearance, 200 characters each."""
    text = F.trim("value")
    seen = lines.where(text.rlike(ERROR)).groupBy("job", text.alias("text")).agg(F.min("line").alias("line"))
    newest = Window.partitionBy("job").orderBy(F.col("line").desc())
    return seen.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most).select("job", "line", F.substr("text", F.lit(1), F.lit(200)).alias("text"))


def recent_counts(lines: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """L3: warnings, errors and failed items of stamped lines (``yyyy-MM-dd HH:mm:ss LEVEL message``) of the last hours."""
    stamp = F.try_to_timestamp(F.substr("value", F.lit(1), F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss"))
    level = F.regexp_extract("value", r"^.{19}\S*\s+(\w+)", 1)
    failed = F.coalesce(F.regexp_extract("value", r"failed=(\d+)", 1).try_cast("int"), F.lit(0))
    rows = lines.where(stamp >= now - F.make_interval(hours=F.lit(hours)))
    return rows.groupBy("job").agg(F.count_if(level.isin("ERROR", "WARNING")).alias("warnings"), F.count_if(F.col("value").contains("collected:")).alias("runs"), F.sum(failed).alias("failed_items"))


def completed(exit_code: Column, marked: Column, traced: Column, codes: tuple[int, ...] = (0,)) -> Column:
    """Whether a run succeeded: it ended with one of the codes, or, without an exit line, printed its marker and no traceback."""
    return F.when(exit_code.isNotNull(), exit_code.isin(*codes)).otherwise(F.coalesce(marked & ~traced, F.lit(False)))


def job_runs(lines: DataFrame, marker: str, codes: tuple[int, ...] = (0,)) -> DataFrame:
    """One row for each run with whether it succeeded; ``marker`` is what it prints at its end."""
    text = F.col("value")
    own = sessions(lines).where("run > 0").groupBy("job", "run").agg(F.max("started_at").alias("started_at"), F.max("exit_code").alias("exit_code"), F.bool_or(text.contains(marker)).alias("_m"), F.bool_or(text.contains("Traceback")).alias("_t"))
    return own.withColumn("success", completed(F.col("exit_code"), F.col("_m"), F.col("_t"), codes)).drop("_m", "_t")


def last_runs(runs_: DataFrame) -> DataFrame:
    """By job: the last run, its start, exit code and success, and the start of the last successful one."""
    return runs_.groupBy("job").agg(F.max("run").alias("run"), F.max_by("started_at", "run").alias("started_at"), F.max_by(F.struct("exit_code"), "run")["exit_code"].alias("exit_code"), F.max_by("success", "run").alias("success"), F.max_by("started_at", F.when(F.col("success"), F.col("run"))).alias("last_success"))


def last_finished(lines: DataFrame) -> DataFrame:
    """The time of each job's last exit line, whatever its code."""
    text = F.trim("value")
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(text, RUN, 1), F.lpad(F.regexp_extract(text, RUN, 2), 8, "0")), F.lit("yyyy/MM/dd HH:mm:ss"))
    ends = lines.where(F.regexp_extract(text, RUN, 4) == "exit").select("job", "line", stamp.alias("at"))
    return ends.groupBy("job").agg(F.max_by("at", "line").alias("last_run"))


def next_slot(now: Column, hours: list[int]) -> Column:
    """The next of the daily slots after ``now``."""
    midnight = F.date_trunc("day", now)
    slots = F.array(*[midnight + F.make_interval(hours=F.lit(h + d * 24)) for d in (0, 1) for h in hours])
    return F.array_min(F.filter(slots, lambda s: s > now))
