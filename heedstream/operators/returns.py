"""Price features, returns around events, technicals and volatility.

Prices are long: one row for each stock and day. Every function adds
columns through windows over (stock_id, date), so one exchange by stock
serves a whole chain, or joins small per-date tables of the benchmark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from heedstream.functions.exprs import is_company_code
from heedstream.sources.shared import small, stage

HORIZONS = (1, 3, 5, 10)


def by_stock() -> WindowSpec:
    return Window.partitionBy("stock_id").orderBy("date")


def _rows(a: int, b: int) -> WindowSpec:
    return by_stock().rowsBetween(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b - 1, null where b is zero or either is null."""
    return F.try_divide(a, b) - 1


def price_features(prices: DataFrame) -> DataFrame:
    """Past and future returns over 1, 3, 5, 10 rows and the change of volume."""
    out = prices
    for n in HORIZONS:
        out = out.withColumn(f"return_{n}d", ratio(F.col("close"), F.lag("close", n).over(by_stock())))
        out = out.withColumn(f"future_return_{n}d", ratio(F.lead("close", n).over(by_stock()), F.col("close")))
    return out.withColumn("volume_change", ratio(F.col("volume").cast("double"), F.lag("volume").over(by_stock()).cast("double")))


def numbered(prices: DataFrame) -> DataFrame:
    """Row number of each trading day within its stock, from 1."""
    return prices.withColumn("ordinal", F.row_number().over(by_stock()))


def align(events: DataFrame, trading: DataFrame, side: str = "left", date: str = "date") -> DataFrame:
    """The first trading row of the event's stock on or after (``left``) or after (``right``) its date.

    ``trading`` has stock_id, date and any columns, which arrive in the
    struct ``day0`` (null where no trading day follows or the event has no
    date). Rows and events are united and the next trading row is carried back over descending
    dates: one exchange by stock, no range join. The stock comes back as the column that rows
    are dealt by, so that what follows by stock shuffles nothing.
    """
    struct = F.struct(*trading.columns)
    first = 0 if side == "left" else 1
    rows = trading.select("stock_id", F.col("date").alias("_d"), F.lit(first).alias("_k"), struct.alias("day0"), F.lit(None).cast(events.select(F.struct(*events.columns).alias("e")).schema["e"].dataType).alias("_e"))
    marks = events.select("stock_id", F.col(date).alias("_d"), F.lit(1 - first).alias("_k"), F.lit(None).cast(rows.schema["day0"].dataType).alias("day0"), F.struct(*events.columns).alias("_e"))
    back = Window.partitionBy("stock_id").orderBy(F.col("_d").desc(), F.col("_k").asc()).rowsBetween(Window.unboundedPreceding, 0)
    # of equal dates the row that is read first is the one that may be carried on
    found = rows.unionByName(marks).withColumn("day0", F.when(F.col("_d").isNotNull(), F.last("day0", ignorenulls=True).over(back)))
    return found.where("_e is not null").select(*["stock_id" if c == "stock_id" else F.col(f"_e.{c}").alias(c) for c in events.columns], "day0")


def with_performance(prices: DataFrame, benchmark: str) -> DataFrame:
    """W5-W10 for every trading row: forward, excess and normal excess returns, gain and loss, breakouts, first reaction.

    The benchmark's close of a row's day is joined once, from a broadcast
    calendar (one row a day); that of a later row is carried back with the row,
    so the rows keep their one exchange by stock.
    """
    bench = prices.where(F.col("stock_id") == benchmark).select("date", F.col("close").alias("_b"))
    out = numbered(prices.join(F.broadcast(bench), "date", "left"))
    for n in HORIZONS:
        out = out.withColumn(f"return_{n}d", F.when(F.col("close") != 0, ratio(F.lead("close", n).over(by_stock()), F.col("close"))))
    out = out.withColumn("max_gain_10d", ratio(F.max("high").over(_rows(1, 10)), F.col("close"))).withColumn("max_loss_10d", ratio(F.min("low").over(_rows(1, 10)), F.col("close")))
    for n in (20, 60):
        ma = F.avg("close").over(_rows(1 - n, 0))
        out = out.withColumn(f"ma{n}", ma)
        cross = (F.col("close") > F.col(f"ma{n}")) & (F.lag("close").over(by_stock()) <= F.lag(f"ma{n}").over(by_stock()))
        out = out.withColumn(f"_x{n}", F.when(cross, F.col("ordinal")))
        out = out.withColumn(f"ma{n}_breakout_day", F.min(f"_x{n}").over(_rows(0, 30)) - F.col("ordinal"))
    moved = lambda n: F.abs(F.try_divide(F.lead("close", n).over(by_stock()), F.col("close")) - 1) >= 0.01
    out = out.withColumn("reaction_days", F.coalesce(*[F.when(moved(n), n) for n in range(1, 31)]))
    for n in HORIZONS:
        out = out.withColumn(f"excess_{n}d", F.col(f"return_{n}d") - F.when(F.col("_b") != 0, ratio(F.lead("_b", n).over(by_stock()), F.col("_b"))))
    out = out.withColumns({f"normal_{n}d": F.avg(f"excess_{n}d").over(Window.partitionBy("stock_id")) for n in HORIZONS})
    return out.drop("_b", "_x20", "_x60")


def normal_excess(performance: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean excess return of each stock over all start days of a period."""
    rows = performance
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows.groupBy("stock_id").agg(*[F.avg(f"excess_{n}d").alias(f"normal_{n}d") for n in HORIZONS], F.count("*").alias("days"))


@F.pandas_udf(ArrayType(IntegerType()))
def _first_on_or_after(days: pd.Series, wanted: pd.Series) -> pd.Series:
    """For each of ``wanted`` the index, from 0, of the first of the ascending ``days`` that isn't before it; their number if there is none."""
    return pd.Series([np.searchsorted(d, w).astype("int32") for d, w in zip(days, wanted)])


def aligned_returns(dates: DataFrame, baskets: DataFrame, prices: DataFrame, offsets: tuple[int, ...] = (0, 1, 3, 5, 10)) -> DataFrame:
    """Events (cluster, date) of clusters with their stocks (cluster, stock_id) to (cluster, date, stock_id, day0_date, returns): the returns from day 0 at each offset, in their order; a zero base is skipped.

    A cluster's dates stay one array until they stand beside its stocks' closes, which are one array
    a stock: what is shuffled and sorted grows with clusters, stocks and prices, not with
    their product, and events become rows where they are written. An array is bounded by the calendar.
    """
    own = dates.where("date is not null").select("cluster", F.unix_date("date").alias("_d")).repartition("cluster").distinct()
    own = own.groupBy("cluster").agg(F.collect_list("_d").alias("_wanted"))
    marks = own.join(baskets.distinct(), "cluster")
    line = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("d"), F.col("close").alias("c"))))
    lines = prices.where("date is not null").groupBy("stock_id").agg(line.alias("_l")).select("stock_id", F.col("_l.d").alias("_days"), F.col("_l.c").alias("_closes"))
    met = marks.join(lines, "stock_id").withColumn("_at", _first_on_or_after("_days", "_wanted"))
    price = lambda i: F.get("_closes", i)
    found = F.transform("_at", lambda i, k: F.struct(F.get("_wanted", k).alias("d"), F.get("_days", i).alias("d0"), price(i).alias("base"), F.array(*[price(i + n) for n in offsets]).alias("p")))
    met = met.select("cluster", "stock_id", F.explode(F.filter(found, lambda e: e["base"] != 0)).alias("e"))
    day = lambda c: F.date_from_unix_date(c)
    return met.select("cluster", day(F.col("e.d")).alias("date"), "stock_id", day(F.col("e.d0")).alias("day0_date"), F.array(*[ratio(F.col("e.p")[k], F.col("e.base")) for k in range(len(offsets))]).alias("returns"))


def return_comparison(aligned: DataFrame, keys: list[str], offsets: tuple[int, ...] = (0, 1, 3, 5, 10)) -> DataFrame:
    """Offsets as columns day1..day10, best first. The rows are written once, as ranges for the order are drawn from them before they are dealt."""
    wide = aligned.select(*keys, *[F.col("returns")[offsets.index(n)].alias(f"day{n}") for n in HORIZONS])
    return stage(wide, "compared").orderBy(F.col("day1").desc_nulls_last(), *keys)


def relative(prices: DataFrame, adjusted: bool = True) -> DataFrame:
    """Adjusted close (else close), or the close itself, with the stock's first value as 100."""
    price = F.coalesce("adj_close", "close") if adjusted else F.col("close")
    return prices.dropDuplicates(["stock_id", "date"]).withColumn("price", price).where("price is not null").withColumn("base_100", F.col("price") / F.first("price").over(by_stock()) * 100)


def technicals(prices: DataFrame) -> DataFrame:
    """Base 100, moving averages, RSI over 14 changes by simple means, MACD 12/26 and its signal over 9, and the volume, all on closes.

    The recursive averages run once over each stock's ordered closes, in the
    partitioning of the windows before them; a stock's history is bounded by
    its trading days.
    """
    out = relative(prices, adjusted=False).select("stock_id", "date", "price", "base_100", "volume")
    first = F.first("price").over(by_stock())
    for n in (5, 20, 60):
        frame = _rows(1 - n, 0)
        out = out.withColumn(f"ma{n}", F.when(F.count("price").over(frame) >= n, F.avg("price").over(frame) / first * 100))
    change = F.col("price") - F.lag("price").over(by_stock())
    out = out.withColumn("_up", F.greatest(change, F.lit(0.0))).withColumn("_down", F.greatest(-change, F.lit(0.0)))
    out = out.withColumn("_up", F.when(F.row_number().over(by_stock()) > 1, F.col("_up"))).withColumn("_down", F.when(F.row_number().over(by_stock()) > 1, F.col("_down")))
    frame = _rows(-13, 0)
    gain, loss = F.avg("_up").over(frame), F.avg("_down").over(frame)
    rsi = F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    out = out.withColumn("rsi14", F.when(F.count("_up").over(frame) >= 14, rsi)).drop("_up", "_down")
    fields = out.schema.fields

    def macd(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        fast, slow = (pdf["price"].ewm(span=n, adjust=False).mean() for n in (12, 26))
        pdf["macd"] = fast - slow
        pdf["macd_signal"] = pdf["macd"].ewm(span=9, adjust=False).mean()
        return pdf

    return out.groupBy("stock_id").applyInPandas(macd, StructType([*fields, StructField("macd", DoubleType()), StructField("macd_signal", DoubleType())]))


def post_news(articles: DataFrame, prices: DataFrame, rows: int = 5) -> DataFrame:
    """Articles (news_id, stock_id, date): mean return from the first day after to ``rows`` rows on, and of how many stocks; an article without any has a null and 0."""
    ahead = prices.where("close is not null").select("stock_id", "date", "close", F.lead("close", rows).over(by_stock()).alias("exit"))
    met = align(articles, ahead, "right")
    gain = F.when((F.col("day0.close") != 0) & F.col("day0.exit").isNotNull(), ratio(F.col("day0.exit"), F.col("day0.close")))
    return met.groupBy("news_id").agg(F.avg(gain).alias("return_after"), F.count(gain).alias("stocks"))


def daily_abnormal(prices: DataFrame, benchmark: str, price: str = "adj_close") -> DataFrame:
    """Each stock on the benchmark's days, its return minus the benchmark's; missing days stay null.

    The calendar (one row a day) is broadcast to the stocks' rows. Each row
    stands for the calendar days up to the stock's next one, so that missing days
    are made where the rows are, in the one partitioning by stock that all
    windows share, and no day without a price is shuffled. ``prices`` has one row
    for each stock and day.
    """
    rows = prices.select("stock_id", "date", F.col(price).alias("price"))
    line = Window.orderBy("date")
    calendar = rows.where(F.col("stock_id") == benchmark).select("date", F.col("price").alias("bench"))
    calendar = calendar.withColumn("day", F.row_number().over(line)).withColumn("bench_return", ratio(F.col("bench"), F.lag("bench").over(line)))
    calendar = stage(calendar, "calendar")
    last = calendar.agg(F.coalesce(F.max("day"), F.lit(0)).alias("_end"))
    own = rows.where(F.col("stock_id") != benchmark).join(F.broadcast(calendar.select("date", "day")), "date", "left")
    # a day off the calendar counts for nothing, but its stock has all calendar days: such rows stand last
    order = Window.partitionBy("stock_id").orderBy(F.col("day").asc_nulls_last())
    own = own.crossJoin(F.broadcast(last)).withColumn("_n", F.row_number().over(order)).withColumn("_to", F.coalesce(F.lead("day").over(order) - 1, "_end"))
    own = own.withColumn("_from", F.when(F.col("_n") == 1, 1).otherwise(F.col("day"))).where("_from <= _to")
    full = own.select("stock_id", F.explode(F.sequence("_from", "_to")).alias("_d"), F.col("day").alias("_own"), "price")
    full = full.select("stock_id", F.col("_d").alias("day"), F.when(F.col("_own") == F.col("_d"), F.col("price")).alias("price")).join(F.broadcast(calendar), "day")
    full = full.select("stock_id", "date", "day", "bench", "bench_return", "price")
    return full.withColumn("ar", ratio(F.col("price"), F.lag("price").over(by_stock())) - F.col("bench_return"))


def volatility(prices: DataFrame, benchmark: str) -> DataFrame:
    """Recent 20 days against the 40 before, the ratio a day earlier, and the five days after; a stock without any adjusted close goes by its closes."""
    adjusted = F.count("adj_close").over(Window.partitionBy("stock_id")) > 0
    closes = prices.select("stock_id", "date", F.when(adjusted, F.col("adj_close")).otherwise(F.col("close")).alias("price"))
    out = daily_abnormal(closes, benchmark, "price").withColumn("move", F.abs("ar"))
    recent, usual, after = _rows(-19, 0), _rows(-59, -20), _rows(1, 5)
    out = out.withColumn("recent", F.when(F.count("move").over(recent) >= 15, F.avg("move").over(recent)))
    out = out.withColumn("usual", F.when(F.count("move").over(usual) >= 25, F.avg("move").over(usual)))
    out = out.withColumn("ratio", F.try_divide("recent", "usual"))
    out = out.withColumn("before", F.lag("ratio").over(by_stock()))
    five = F.when(F.count("move").over(after) >= 5, F.avg("move").over(after))
    return out.withColumn("after5", F.try_divide(five, F.lag("usual").over(by_stock())))


def volatility_panel(prices: DataFrame, benchmark: str) -> DataFrame:
    """Moves as multiples of the usual level (t-60..t-21), what follows and what went before."""
    out = daily_abnormal(prices, benchmark, "adj_close").withColumn("move", F.abs("ar"))
    frame = _rows(-60, -21)
    out = out.withColumn("usual", F.when(F.count("move").over(frame) >= 25, F.avg("move").over(frame)))
    out = out.withColumn("today", F.try_divide("move", "usual"))
    for name, a, b in (("future5", 1, 5), ("future10", 6, 10)):
        out = out.withColumn(name, F.when(F.count("today").over(_rows(a, b)) >= 5, F.avg("today").over(_rows(a, b))))
    out = out.withColumn("past20", F.when(F.count("today").over(_rows(-20, -1)) >= 15, F.avg("today").over(_rows(-20, -1))))
    return out.withColumn("big5", F.when(F.count("today").over(_rows(1, 5)) >= 5, F.max("today").over(_rows(1, 5)) >= 2).otherwise(F.lit(False)))


def forward_abnormal(calendar: DataFrame, rows: int, mode: str = "after", name: str = "forward_ar") -> DataFrame:
    """Abnormal return over ``rows`` calendar rows from the day's close, or from the close before it (``same``); ``calendar`` is that of ``daily_abnormal``."""
    own, base = (F.col("price"), F.col("bench")) if mode == "after" else (F.lag("price").over(by_stock()), F.lag("bench").over(by_stock()))
    ahead = rows if mode == "after" else rows - 1
    later = lambda c: F.lead(c, ahead).over(by_stock()) if ahead else F.col(c)
    return calendar.withColumn(name, ratio(later("price"), own) - ratio(later("bench"), base))


def trading_day_map(trading_days: DataFrame) -> DataFrame:
    """(date, day0, day): the first trading day on or after each calendar day between the first and the last; one row a calendar day."""
    before = F.lag("date").over(Window.orderBy("date"))
    spans = trading_days.select(F.col("date").alias("day0"), "day", F.coalesce(F.date_add(before, 1), F.col("date")).alias("_from"))
    return spans.select(F.explode(F.sequence("_from", "day0")).alias("date"), "day0", "day")


def on_trading_days(events: DataFrame, trading_days: DataFrame) -> DataFrame:
    """Events with ``day0`` and ``day`` of a broadcast map of calendar days; one before the first belongs to the first, one after the last is left out."""
    first = trading_days.agg(F.min("date").alias("_first"))
    own = events.crossJoin(F.broadcast(first)).withColumn("_d", F.greatest("date", "_first"))
    return own.join(F.broadcast(trading_day_map(trading_days).withColumnRenamed("date", "_d")), "_d").drop("_d", "_first")


def event_pairs(events: DataFrame, trading_days: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """Events (keyword, stock_id, link_type, theme_name, date, tone, traffic) to what units are made of.

    One row for each (stock, day 0) of kind direct and each (theme, day 0,
    stock) of kind theme; where several events meet there, that of the first
    keyword and day counts. Only company codes of the home market take part (F7), and of these
    only the stocks of ``priced``. ``trading_days`` (date, day) are broadcast as a map of calendar days; an
    event before the first belongs to the first, one after the last to none.
    """
    own = events.where(is_company_code(F.col("stock_id")) & F.col("link_type").isin("direct", "theme"))
    if priced is not None:
        own = own.join(priced.select("stock_id").distinct(), "stock_id", "left_semi")
    met = on_trading_days(own, trading_days)
    theme = F.when(F.col("link_type") == "theme", F.col("theme_name"))
    rows = met.groupBy(F.col("link_type").alias("kind"), theme.alias("theme_name"), "stock_id", "day0", "day").agg(F.min(F.struct("keyword", "date", "tone", "traffic")).alias("e"))
    return rows.select("kind", F.coalesce("theme_name", "stock_id").alias("unit"), "stock_id", "day0", "day", "e.keyword", "e.tone", "e.traffic")


def event_units(pairs: DataFrame) -> DataFrame:
    """Units (kind, unit, day0, day) with their stocks, keywords, summed tone and greatest traffic."""
    return pairs.groupBy("kind", "unit", "day0", "day").agg(F.sort_array(F.collect_set("stock_id")).alias("stock_ids"), F.sort_array(F.collect_set("keyword")).alias("keywords"), F.sum("tone").alias("tone"), F.max("traffic").alias("traffic"))


def path_windows(daily: DataFrame, start: str | None = None) -> DataFrame:
    """Each stock's abnormal returns in calendar order as one array, which the calendar bounds, with its last day and its normal level from ``start`` on (if None of all days).

    ``daily`` is that of ``daily_abnormal``: all calendar days of a stock, numbered from 1, in one partition.
    """
    counted = F.when(F.col("date") >= F.lit(start).cast("date"), F.col("ar")) if start else F.col("ar")
    out = daily.groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("day", "ar"))).alias("_line"), F.avg(counted).alias("normal"))
    return out.select("stock_id", F.transform("_line", lambda x: x["ar"]).alias("line"), "normal", F.element_at("_line", -1)["day"].alias("last"))


def cumulative_paths(pairs: DataFrame, windows: DataFrame, before: int = 5, after: int = 10) -> DataFrame:
    """For each kind of unit the mean cumulative abnormal path at offsets -before..after.

    A unit's AR of a day is the mean of its stocks' non-null ARs; ``windows``
    are those of ``path_windows``, which pairs meet by stock: no stock's day is
    shuffled by itself. Days without a full window and a row before it are left
    out. The adjusted path takes the units' normal
    level off, o + 1 days of it at offset o; the path at -1 is 0, before that
    it is minus what is still to come. All offsets of a unit are sums of one aggregation.
    """
    size = before + after + 1
    met = pairs.select("kind", "unit", "day", "stock_id").join(windows, "stock_id").where((F.col("day") - before - 1 >= 1) & (F.col("day") + after <= F.col("last")))
    met = met.select("kind", "unit", "day", "normal", F.slice("line", F.col("day") - before, size).alias("around"))
    unit = met.groupBy("kind", "unit", "day").agg(*[F.avg(F.col("around")[k]).alias(f"_a{k}") for k in range(size)], F.avg("normal").alias("normal"))
    add = lambda first, last: sum((F.coalesce(f"_a{k}", F.lit(0.0)) for k in range(first, last)), F.lit(0.0))
    path = lambda o: add(before, before + o + 1) if o >= 0 else -add(before + o + 1, before)
    points = F.array(*[F.struct(F.lit(o).alias("offset"), path(o).alias("path"), (path(o) - F.col("normal") * (o + 1)).alias("adjusted")) for o in range(-before, after + 1)])
    each = unit.select("kind", F.explode(points).alias("p")).select("kind", "p.*")
    return each.groupBy("kind", "offset").agg(F.avg("path").alias("mean_path"), F.avg("adjusted").alias("adjusted_path"), F.try_divide(F.stddev_samp("adjusted"), F.sqrt(F.count("adjusted"))).alias("se"), F.count("*").alias("n"))


def price_lines(prices: DataFrame) -> DataFrame:
    """(stock_id, dates, prices): the known prices (stock_id, date, price) of each stock in the order of their days, days as numbers since 1970; one row a stock, which the calendar bounds."""
    line = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("d"), F.col("price").alias("p"))))
    known = prices.where("date is not null").groupBy("stock_id").agg(line.alias("_l"))
    return known.select("stock_id", F.col("_l.d").alias("dates"), F.col("_l.p").alias("prices"))


def line_calendar(lines: DataFrame, benchmark: str) -> DataFrame:
    """(date, day, price): the benchmark's days of ``price_lines``, numbered from 1."""
    own = lines.where(F.col("stock_id") == benchmark).select("prices", F.posexplode("dates").alias("k", "d"))
    return own.select(F.date_from_unix_date("d").alias("date"), (F.col("k") + 1).alias("day"), F.get("prices", F.col("k")).alias("price"))


def _dense(line: Column | str, day: str, value: str, first: Column | int) -> Column:
    """The array of ``value`` from day ``first`` on, of an array of structs in the order of ``day``; null on days between them."""
    before = lambda x, k: F.coalesce(F.get(line, k - 1)[day], F.lit(first) - 1)
    return F.flatten(F.transform(line, lambda x, k: F.array_append(F.array_repeat(F.lit(None), x[day] - before(x, k) - 1), x[value])))


def study_returns(lines: DataFrame, calendar: DataFrame, benchmark: str, start: str) -> DataFrame:
    """(stock_id, line, start, base1, base3, base5, base10): forward abnormal returns (W17) over 1, 3, 5 and 10 calendar days.

    ``line`` has (day, ar1, ar3, ar5, ar10) of the stock's days that have any; the bases are
    their means from the date ``start`` on, whose day number is given back. A return needs a price at both its ends, so days
    without one are no rows: each price finds its later ones in the stock's own row. ``lines`` and
    ``calendar`` are those of ``price_lines`` and ``line_calendar``; the calendar is broadcast as one row.
    """
    days = F.sort_array(F.collect_list(F.struct("day", F.unix_date("date").alias("d"), "price")))
    cal = calendar.agg(days.alias("_c"), F.min(F.when(F.col("date") >= F.lit(start).cast("date"), F.col("day"))).alias("start"))
    first = F.col("_c")[0]["d"]
    later = lambda n: F.transform("_c", lambda x, k: ratio(F.get("_c", k + n)["price"], x["price"]))
    cal = cal.select("start", first.alias("_first"), _dense("_c", "d", "day", first).alias("_numbers"), *[later(n).alias(f"_b{n}") for n in HORIZONS])
    own = lines.where(F.col("stock_id") != benchmark).join(F.broadcast(cal.select("_first", "_numbers")), how="left")
    placed = F.transform("dates", lambda d, k: F.struct(F.get("_numbers", d - F.col("_first")).alias("day"), F.get("prices", k).alias("p")))
    own = own.select("stock_id", F.filter(placed, lambda x: x["day"].isNotNull() & x["p"].isNotNull()).alias("_l"))
    own = own.select("stock_id", F.col("_l.day").alias("_days"), _dense("_l", "day", "p", 1).alias("_p")).join(F.broadcast(cal.drop("_first", "_numbers")), how="left")
    names = [f"ar{n}" for n in HORIZONS]
    ahead = lambda d, n: ratio(F.get("_p", d + (n - 1)), F.get("_p", d - 1)) - F.get(f"_b{n}", d - 1)
    line = F.transform("_days", lambda d: F.struct(d.alias("day"), *[ahead(d, n).alias(f"ar{n}") for n in HORIZONS]))
    own = own.select("stock_id", "start", F.filter(line, lambda x: F.coalesce(*[x[c] for c in names]).isNotNull()).alias("line"))
    counts = lambda x, c: (x["day"] >= F.col("start")) & x[c].isNotNull()
    total = lambda c: F.aggregate("line", F.lit(0.0), lambda s, x: F.when(counts(x, c), s + x[c]).otherwise(s))
    number = lambda c: F.aggregate("line", F.lit(0), lambda s, x: F.when(counts(x, c), s + 1).otherwise(s))
    return own.select("stock_id", "line", "start", *[F.try_divide(total(f"ar{n}"), number(f"ar{n}")).alias(f"base{n}") for n in HORIZONS])


def event_days(events: DataFrame, links: DataFrame, trading_days: DataFrame, priced: DataFrame) -> DataFrame:
    """The pairs of ``event_pairs`` by stock: (kind, unit, stock_id, days, tones), without tones, which are null.

    Days are collected by keyword before they meet the links, so that what is shuffled
    are links with their keyword's days, not the events of every stock.
    """
    days = on_trading_days(events.select("keyword", "date"), trading_days).groupBy("keyword").agg(F.collect_set("day").alias("days"))
    own = links.where(is_company_code(F.col("stock_id")) & F.col("link_type").isin("direct", "theme")).join(priced, "stock_id", "left_semi")
    theme = F.when(F.col("link_type") == "theme", F.col("theme_name"))
    met = own.select("keyword", F.col("link_type").alias("kind"), F.coalesce(theme, "stock_id").alias("unit"), "stock_id").join(days, "keyword").drop("keyword")
    out = met.repartition("stock_id").groupBy("kind", "unit", "stock_id").agg(F.array_distinct(F.flatten(F.collect_list("days"))).alias("days"))
    return out.withColumn("tones", F.lit(None).cast("array<bigint>"))


def pair_days(pairs: DataFrame) -> DataFrame:
    """Pairs of ``event_pairs`` by stock: (kind, unit, stock_id, days, tones)."""
    out = pairs.repartition("stock_id").groupBy("kind", "unit", "stock_id").agg(F.collect_list(F.struct("day", F.col("tone").cast("long").alias("tone"))).alias("_e"))
    return out.select("kind", "unit", "stock_id", F.col("_e.day").alias("days"), F.col("_e.tone").alias("tones"))


def study_units(days: DataFrame, ahead: DataFrame) -> DataFrame:
    """Units (kind, unit, day, tone) with excess and normal level for each of the four horizons, as the array ``q`` of (n, excess, normal).

    A stock's normal level is its own mean over the period, a basket's the
    mean over days of the day's mean over all stocks that the theme ever had.
    ``days`` are those of ``event_days`` or ``pair_days``, of stocks with prices, ``ahead`` is that of
    ``study_returns``; an event's day that a stock has no returns of counts. Events find
    their returns in the stock's own row; baskets receive their stocks' events as one array a stock.
    """
    names, bases = [f"ar{n}" for n in HORIZONS], [f"base{n}" for n in HORIZONS]
    met = days.join(ahead.select("stock_id", "line", *bases), "stock_id", "left").withColumn("line", F.coalesce("line", F.array().cast(ahead.schema["line"].dataType)))
    met = met.withColumn("_own", F.col("line.day")).withColumn("_at", _first_on_or_after("_own", "days"))

    def event(d: Column, k: Column) -> Column:
        found = F.get("line", F.get("_at", k))
        return F.struct(d.alias("day"), F.get("tones", k).alias("tone"), *[F.when(found["day"] == d, found[c]).alias(c) for c in names])

    met = met.select("kind", "unit", F.transform("days", event).alias("_e"), *bases)
    direct = met.where("kind = 'direct'").select("kind", "unit", *bases, F.explode("_e").alias("e")).select("kind", "unit", "e.*", *bases)
    theme = met.where("kind = 'theme'").select("unit", "_e").repartition("unit").select("unit", F.explode("_e").alias("e")).select("unit", "e.*")
    theme = theme.groupBy("unit", "day").agg(F.sum("tone").alias("tone"), *[F.avg(c).alias(c) for c in names])
    baskets = days.where("kind = 'theme'").select("unit", "stock_id").join(ahead.select("stock_id", "line", "start"), "stock_id").select("unit", "line", "start").repartition("unit")
    usual = baskets.select("unit", "start", F.explode("line").alias("p")).where("p.day >= start").groupBy("unit", "p.day").agg(*[F.avg(f"p.{c}").alias(c) for c in names])
    usual = usual.groupBy("unit").agg(*[F.avg(f"ar{n}").alias(f"base{n}") for n in HORIZONS])
    both = direct.unionByName(theme.join(small(usual), "unit", "left").withColumn("kind", F.lit("theme")))
    return both.select("kind", "unit", "day", "tone", F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"ar{n}").alias("excess"), F.col(f"base{n}").alias("normal")) for n in HORIZONS]).alias("q"))


def path_band(paths: DataFrame) -> DataFrame:
    """The 95 % band of the adjusted path and its t value, for each kind and offset."""
    return paths.withColumn("low", F.col("adjusted_path") - 1.96 * F.col("se")).withColumn("high", F.col("adjusted_path") + 1.96 * F.col("se")).withColumn("t", F.try_divide("adjusted_path", "se"))


def end_table(paths: DataFrame, last: int = 10) -> DataFrame:
    """Where the paths of each kind end."""
    return paths.where(F.col("offset") == last).select("kind", F.col("n").alias("events"), F.col("mean_path").alias("car"), F.col("adjusted_path").alias("car_adjusted"), F.try_divide("adjusted_path", "se").alias("t"))


def event_components(events: DataFrame, windows: DataFrame, trading_days: DataFrame) -> DataFrame:
    """Sums of AR minus the stock's normal level before, on and after day 0; needs 5 days before and 10 after.

    Events take day 0 from a broadcast map of ``trading_days`` (date, day) and meet their
    stock's line of ``path_windows`` by stock: no stock's day is shuffled by itself.
    """
    first = trading_days.agg(F.min("date").alias("_first"))
    found = events.crossJoin(F.broadcast(first)).withColumn("_d", F.greatest("date", "_first"))
    found = found.join(F.broadcast(trading_day_map(trading_days).withColumnRenamed("date", "_d")), "_d").drop("_d", "_first")
    met = found.join(windows, "stock_id").where("day > 5 and day + 10 <= last")
    off = lambda a, n: F.aggregate(F.slice("line", F.col("day") + a, F.lit(n)), F.lit(0.0), lambda s, x: s + F.coalesce(x - F.col("normal"), F.lit(0.0)))
    return met.select("stock_id", "day0", *[c for c in events.columns if c != "stock_id"], off(-5, 5).alias("pre"), (F.element_at("line", F.col("day")) - F.col("normal")).alias("day0_ar"), off(1, 5).alias("post5"), off(1, 10).alias("post10"))


def attention_profile(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts (stock_id, date, count; every day) around events over the mean of days -37..-8 plus a half."""
    base = counts.withColumn("usual", F.avg("count").over(_rows(-37, -8)) + 0.5)
    spread = events.select("stock_id", F.col("date").alias("event"), F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("offset")).withColumn("date", F.expr("date_add(event, offset)"))
    level = base.select("stock_id", F.col("date").alias("event"), "usual")
    met = spread.join(counts.select("stock_id", "date", "count"), ["stock_id", "date"]).join(level, ["stock_id", "event"]).where("usual is not null")
    return met.groupBy("offset").agg(F.avg(F.col("count") / F.col("usual")).alias("attention"), F.count("*").alias("n"))


def path_segments(events: DataFrame, prices: DataFrame, rows: int = 10) -> DataFrame:
    """Day 0 and the next closes of each event with the event's outcome.

    Events carry the ``ordinal`` of their day 0 among their stock's rows; they meet the stock's closes
    as one array, so that no path of a day is built or shuffled unless an event begins there.
    """
    from heedstream.functions.exprs import outcome

    lines = prices.groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("_line"))
    met = events.join(lines, "stock_id")
    own = [c for c in events.columns if c != "ordinal"]
    path = F.slice("_line", F.col("ordinal"), F.lit(rows + 1))
    return met.select(*own, outcome(F.col("excess_10d"), F.col("excess_5d")).alias("outcome"), F.posexplode(path).alias("step", "p")).select(*own, "outcome", "step", F.col("p.date").alias("date_at"), F.col("p.close").alias("close"))
