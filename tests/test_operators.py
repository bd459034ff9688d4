"""Hand-computed cases: windows and their edges, names, zones, rules, repair and logs."""

import datetime as dt
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heedstream import registry
from heedstream.functions import exprs as ex
from heedstream.operators import coverage as cv
from heedstream.operators import events as ev
from heedstream.operators import logs as lg
from heedstream.operators import repair as rp
from heedstream.operators import resolve as rs
from heedstream.operators import returns as rt
from heedstream.operators import stats as st
from heedstream.operators import upsert as up
from heedstream.plans import frames as fr
from heedstream.sources import adapters as ad


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", dt.datetime: "timestamp", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "full", "digits"), [("2,000+", 2000, 2000), ("2K+", 2000, 2), ("1.5M", 1.5e6, 1), ("", 0, None), ("x", 0, None)])
def test_traffic(spark, text, full, digits):
    assert one(spark, ex.traffic_number(F.col("t")), t=text) == full
    assert one(spark, ex.traffic_digits(F.col("t")), t=text) == digits


@pytest.mark.parametrize(("a", "b", "want"), [("中信金", "中國信託金融控股", True), ("網家", "網路家庭", True), ("台積電", "聯電", False), ("", "聯電", False), ("ABC公司", "abc", True)])
def test_names(spark, a, b, want):
    assert one(spark, ex.names_match(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("text", "want"), [("2330 台積電股價", "台積電"), ("妖股ABC_股票走勢", "abc"), ("Straße!", "strasse"), ("ΟΔΟΣ", "οδοσ"), ("ﬁn ſo µ", "finsoμ"), ("ıI", "ıi"), ("Cafe\u0301", "cafe")])
def test_entity_form(spark, text, want):
    assert one(spark, ex.entity_form(F.col("t")), t=text) == want


def test_casefold_of_latin_greek_cyrillic(spark):
    """As Python folds them, letter by letter."""
    text = [chr(i) for i in [*range(0x20, 0x870), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)]]
    df = spark.createDataFrame([(c, c.casefold()) for c in text], "t string, want string")
    assert df.where(ex.casefold(F.col("t")) != F.col("want")).collect() == []


def test_local_times(spark):
    zone = "America/Los_Angeles"
    got = [one(spark, ex.local_to_utc(F.col("t"), zone), t=t) for t in (dt.datetime(2026, 3, 8, 2, 30), dt.datetime(2026, 11, 1, 1, 30), dt.datetime(2026, 7, 1, 0, 0))]
    assert [g["problem"] for g in got] == ["nonexistent", "ambiguous", None]
    assert got[2]["utc"] == dt.datetime(2026, 7, 1, 7, 0)


def test_market_days(spark):
    friday, sunday = dt.datetime(2026, 11, 6, 19, 0), dt.datetime(2026, 11, 8, 10, 0)
    assert one(spark, ex.expected_trading_day(F.col("t")), t=friday) == dt.date(2026, 11, 6)
    assert one(spark, ex.expected_trading_day(F.col("t")), t=sunday) == dt.date(2026, 11, 6)
    assert one(spark, ex.effective_day(F.col("t")), t=friday) == dt.date(2026, 11, 7)
    assert one(spark, ex.previous_weekday(F.col("t")), t=dt.date(2026, 11, 9)) == dt.date(2026, 11, 6)


def days(n, start=dt.date(2026, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_performance(spark):
    d = days(12)
    closes = [100.0 + i for i in range(12)]
    rows = [(x, "1", c, 120.0 if i == 4 else c, 91.0 if i == 6 else c) for i, (x, c) in enumerate(zip(d, closes, strict=True))]
    rows += [(x, "0050", 100.0, 100.0, 100.0) for x in d]
    p = spark.createDataFrame(rows, "date date, stock_id string, close double, high double, low double")
    r = rt.with_performance(p, "0050").where(F.col("stock_id") == "1").orderBy("date").first()
    assert (round(r["return_1d"], 9), round(r["return_3d"], 9), round(r["max_gain_10d"], 9), round(r["max_loss_10d"], 9)) == (0.01, 0.03, 0.2, -0.09)
    assert round(r["excess_5d"], 9) == 0.05 and r["reaction_days"] == 1 and r["ma20_breakout_day"] is None or r["ma20_breakout_day"] >= 0


def test_align_sides(spark):
    d = days(5)
    p = spark.createDataFrame([(d[0], "1"), (d[2], "1"), (d[4], "1")], "date date, stock_id string")
    e = spark.createDataFrame([(d[1], "1"), (d[2], "1"), (d[4], "1"), (d[0], "2"), (None, "1")], "date date, stock_id string")
    at = lambda side: {(r["date"], r["stock_id"]): r["day0"]["date"] if r["day0"] else None for r in rt.align(e, p, side).collect()}
    assert at("left") == {(d[1], "1"): d[2], (d[2], "1"): d[2], (d[4], "1"): d[4], (d[0], "2"): None, (None, "1"): None}
    assert at("right") == {(d[1], "1"): d[2], (d[2], "1"): d[4], (d[4], "1"): None, (d[0], "2"): None, (None, "1"): None}


def test_rising_stock_is_no_success(spark):
    rows = [(x, s, v) for i, x in enumerate(days(80)) for s, v in (("1", 1.01**i), ("0050", 100.0))]
    p = spark.createDataFrame([(x, s, v, v, v) for x, s, v in rows], "date date, stock_id string, close double, high double, low double")
    perf = rt.with_performance(p, "0050").where(F.col("stock_id") == "1")
    h = st.hypotheses(perf.withColumn("news_sentiment", F.lit("Positive")), ["stock_id"]).first()
    assert h["h1"] == "不成立" and abs(h["mean"]) < 1e-9


def test_detection(spark):
    d = days(10, dt.date(2026, 9, 1))
    heat = spark.createDataFrame([(d[i], "k", 40.0 if i == 8 else 20.0) for i in range(9)], "date date, keyword string, heat double")
    news = spark.createDataFrame([(d[i], "k", i) for i in range(7)] + [(d[7], "k", 100 + i) for i in range(3)], "date date, keyword string, news_id int")
    rss = spark.createDataFrame([(d[0], "r", "200+"), (d[1], "r", "2,000+"), (d[9], "r", "1000+")], "date date, keyword string, approx_traffic string")
    got = {(r["keyword"], r["date"]): (r["triggers"], r["traffic"]) for r in ev.detect(heat, news, rss).collect()}
    assert got == {("k", d[8]): ("heat", None), ("k", d[7]): ("news", None), ("r", d[0]): ("listing", 200.0), ("r", d[9]): ("listing", 1000.0)}


def test_volatility(spark):
    rng = np.random.default_rng(1)
    closes, c = [], 100.0
    for i in range(81):
        closes.append(c)
        c *= 1 + (0.01 if i < 60 else 0.02) * (1 if rng.random() < 0.5 else -1)
    rows = [(x, s, v) for x, y in zip(days(81), closes, strict=True) for s, v in (("1", y), ("0050", 100.0))]
    p = spark.createDataFrame([(x, s, v, v) for x, s, v in rows], "date date, stock_id string, close double, adj_close double")
    last = rt.volatility(p, "0050").orderBy(F.col("date").desc()).first()
    assert round(last["ratio"], 2) == 2.0


def test_macd_and_rsi(spark):
    p = spark.createDataFrame([(x, "1", float(10 + i), 99.0, 7) for i, x in enumerate(days(20))], "date date, stock_id string, close double, adj_close double, volume long")
    rows = rt.technicals(p).orderBy("date").collect()
    e12 = e26 = 10.0
    for i in range(1, 20):
        e12, e26 = e12 + (10 + i - e12) * 2 / 13, e26 + (10 + i - e26) * 2 / 27
    assert abs(rows[-1]["macd"] - (e12 - e26)) < 1e-9 and rows[-1]["rsi14"] == 100.0 and rows[13]["rsi14"] is None
    # technicals run on closes, whatever the adjusted ones
    assert rows[1]["base_100"] == pytest.approx(110) and rows[1]["volume"] == 7


def test_planted_lag(spark):
    rng = np.random.default_rng(11)
    h = rng.normal(size=140)
    heat = spark.createDataFrame([(x, "k", float(v)) for x, v in zip(days(140), h, strict=True)], "date date, keyword string, heat double")
    r = spark.createDataFrame([(x, "1", float(h[i - 3]) if i >= 3 else 0.0) for i, x in enumerate(days(140))], "date date, stock_id string, r double")
    mapping = spark.createDataFrame([("s", "k", "1", 1), ("s", "k", " ", 1), ("t", "k", "1", 0)], "sub_theme string, keyword string, stock_id string, active int")
    best = st.theme_cross(heat, r, mapping).collect()
    assert [(b["sub_theme"], b["stock_id"], b["best_lag"], b["grade"]) for b in best] == [("s", "1", 3, "A")]


def test_lags_count_trading_rows(spark):
    """Heat on half of the days: lag 3 is three rows of the stock, not three days with heat."""
    rng = np.random.default_rng(5)
    dates = days(200)
    h = {i: float(rng.normal()) for i in range(200) if rng.random() < 0.5}
    r = [h.get(i - 3, float(rng.normal())) for i in range(200)]
    heat = spark.createDataFrame([(dates[i], "k", v) for i, v in h.items()] + [(dates[i], "thin", 1.0 * i) for i in range(20)], "date date, keyword string, heat double")
    returns = spark.createDataFrame([(dates[i], "1", v if i else None) for i, v in enumerate(r)], "date date, stock_id string, r double")
    pairs = spark.createDataFrame([("1", "k"), ("1", "thin"), ("2", "k")], "stock_id string, keyword string")
    got = {(x["stock_id"], x["keyword"]): (x["best_lag"], x["r"], x["n"]) for x in st.cross_correlation(heat, returns, pairs).collect()}
    n = sum(1 for i in h if i + 3 < 200)
    assert got[("1", "k")] == (3, pytest.approx(1.0), n)
    assert got[("1", "thin")] == got[("2", "k")] == (None, None, 0)


def test_normal_p(spark):
    for t in (0.0, 0.5, 1.96, 3.3, 3.96, 4.5, 8.0):
        assert one(spark, st.normal_p(F.col("t")), t=t) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9, abs=1e-15)


def test_clustered_ols(spark):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(200, 2)), rng.integers(0, 20, 200)
    y = 1 + x @ [0.5, -2] + rng.normal(size=200)
    got = st.clustered_ols(spark.createDataFrame([(float(a), float(b), float(c), int(k)) for a, (b, c), k in zip(y, x, g, strict=True)], "y double, a double, b double, g int"), "y", ["a", "b"], "g").collect()
    full = np.column_stack([np.ones(200), x])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    e, inv = y - full @ beta, np.linalg.inv(full.T @ full)
    s = np.array([full[g == k].T @ e[g == k] for k in np.unique(g)])
    se = np.sqrt(np.diag(inv @ (s.T @ s) @ inv) * (20 / 19 * 199 / 197))
    assert np.allclose([r["beta"] for r in got], beta) and np.allclose([r["se"] for r in got], se)
    single = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 2.0, 1), (2.0, 3.0, 1)], "y double, a double, g int")
    assert [(r["se"], r["t"], r["clusters"]) for r in st.clustered_ols(single, "y", ["a"], "g").collect()] == [(None, None, 1)] * 2


def test_likeness():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("taiwan", "twan"), ("abc", "xbyc"), ("", "a"), ("台積電股", "台積電"), ("kitten", "sitting")):
        assert rs.common_length(a, b) == lcs(a, b)
    assert rs.window_likeness("abc", "xxabcxx") == 100.0


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    once = up.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, up.upsert(once, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_repair(spark):
    rows = spark.createDataFrame([("2026-09-01 20:00:00.000000", "2026-09-01 04:00:00.000000"), ("2026-09-01 12:00:00", "2026-09-01 04:00:00"), ("2026-09-01", "2026-09-01"), ("2026-11-01 20:00:00.000000", "2026-11-01 01:30:00.000000")], "fetched_at string, published_at string")
    got = rp.repair_times(rows).collect()
    assert [r["problem"] for r in got] == [None, None, "layout", "ambiguous"] and [r["lag_seconds"] for r in got][:2] == [3600, 3600]


def test_log_runs(spark):
    lines = ["noise", "[2026/09/01  8:00:00.10] etl start", "Gemini Stats", "Requests: 5", "Processed: 3 items", "other", "Requests: 9", "[2026/09/01  8:10:00.10] etl exit 3", "[2026/09/01  9:00:00.10] etl start"]
    df = spark.createDataFrame([("etl", i, v) for i, v in enumerate(lines)], "job string, line int, value string")
    runs = lg.runs(df).orderBy("run").collect()
    assert [(r["run"], r["exit_code"]) for r in runs] == [(1, 3), (2, None)]
    assert {r["key"]: r["value"] for r in lg.blocks(df).collect()} == {"Requests": "5", "Processed": "3 items"}


def test_quiet_rules_agree(spark, sf_dir):
    """The listing trigger (three empty days) and the quiet-period rule say the same."""
    from heedstream.sources import adapters as ad

    listed = ad.listed(spark, sf_dir)
    quiet = ev.quiet_starts(listed, ["keyword"]).select("keyword", "date")
    none = lambda c: listed.limit(0).select("keyword", "date", F.lit(None).cast("double").alias(c))
    found = ev.detect(none("heat"), none("news_id"), listed.withColumn("approx_traffic", F.lit("1+"))).select("keyword", "date")
    assert quiet.exceptAll(found).isEmpty() and found.exceptAll(quiet).isEmpty()


def test_heat_price_of_every_stock(spark, tmp_path):
    """G10 and G11 against brute force over stocks on both sides of 1050 and one of five digits."""
    from heedstream import registry

    rng = np.random.default_rng(3)
    dates = days(60)
    heat = rng.integers(1, 9, 60)
    price = {k: rng.uniform(50, 150, 60) for k in (20, 60, 9500)}
    at = lambda d: dt.datetime(d.year, d.month, d.day)
    lines = [(k * 100 + i, 1, k, 1, 1.0, float(price[k][i]), 0.0, at(dates[i])) for k in price for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, at(dates[i])) for i in range(60) for _ in range(heat[i])], "o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "A")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in (0, 1)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    same, best = {}, {}
    for k in price:
        r, h = price[k][1:] / price[k][:-1] - 1, heat[1:].astype(float)
        # a lag before the first return meets heat of the first day too
        full = heat.astype(float)
        c = {lag: np.corrcoef(*zip(*[(full[i], r[i + lag - 1]) for i in range(60) if 1 <= i + lag < 60], strict=True))[0, 1] for lag in range(-10, 11)}
        n = {lag: sum(1 <= i + lag < 60 for i in range(60)) for lag in range(-10, 11)}
        lag = max(c, key=lambda x: (abs(c[x]), -abs(x), -x))
        same[str(1000 + k)], best[str(1000 + k)] = (59, c[0]), (lag, c[lag], n[lag])
    rows = {n: {r["stock_id"]: r for r in registry.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("g10_heat_price", "g11_cross_correlation")}
    assert {k: (r["n"], r["r"]) for k, r in rows["g10_heat_price"].items()} == {k: pytest.approx(v, abs=2e-6) for k, v in same.items()}
    assert {k: (r["best_lag"], r["r"], r["n"]) for k, r in rows["g11_cross_correlation"].items()} == {k: pytest.approx(v, abs=2e-6) for k, v in best.items()}


def test_fuzzy_match_against_all_pairs(spark):
    """The candidates by pieces hold every term at the threshold, for short and long forms on either side."""
    rng = np.random.default_rng(9)
    letters = "abcd"
    word = lambda n: "".join(letters[i] for i in rng.integers(0, 4, n))
    terms = list(dict.fromkeys(word(rng.integers(2, 14)) for _ in range(60)))
    asked = set(terms[:5])
    for t in terms:
        w = list(t)
        for _ in range(rng.integers(0, 3)):
            p = rng.integers(0, len(w) + 1)
            w[p : p + rng.integers(0, 2)] = word(rng.integers(0, 2))
        asked |= {"".join(w), word(4) + t, t[1:], "ab"}
    dictionary = spark.createDataFrame([(i, t, "company" if i % 3 else "industry", str(i)) for i, t in enumerate(terms)], "ordinal long, keyword string, type string, stock_id string")
    for threshold in (88, 75):
        got = {r["keyword"]: (r["canonical"], r["type"], r["stock_ids"], r["score"]) for r in rs.fuzzy_match(spark.createDataFrame([(a,) for a in sorted(asked)], "keyword string"), dictionary, threshold).collect()}
        hits = 0
        for a in asked:
            best = None
            if a in terms:
                best = (100, terms.index(a))
            elif len(a) >= 3:
                x = max(((max(rs.likeness(a, t), rs.window_likeness(a, t) if len(t) >= 3 else 0), len(t), -i) for i, t in enumerate(terms)))
                best = (int(x[0]), -x[2]) if int(x[0]) >= threshold else None
            want = (terms[best[1]], "company" if best[1] % 3 else "industry", [str(best[1])], best[0]) if best else (a.strip(), None, [], 0)
            assert got[a] == want
            hits += best is not None
        assert 40 < hits < len(asked)


def test_rules_and_mentions(spark):
    """J10 finds exact, company and longest inner words in turn; J18 takes the longest name first and codes between non-digits, whatever the block."""
    themes = spark.createDataFrame([(1, "chip", "T", "s", "1"), (2, "chipset", "U", "s", ""), (3, "x", "V", "s", "2")], "ordinal long, keyword string, theme_name string, sub_theme string, stock_id string")
    companies = spark.createDataFrame([(1, "Acme Corporation", "company", "9")], "ordinal long, keyword string, type string, stock_id string")
    asked = spark.createDataFrame([("Chip",), ("new chipset maker",), ("acme corporatio",), ("x y z",), ("nothing",)], "keyword string")
    got = {r["keyword"]: (r["canonical_keyword"], r["theme_name"], r["link_type"], r["confidence_score"], r["classification_source"]) for r in rs.rule_classify(asked, themes, companies, spark.createDataFrame([], "stock_id string")).collect()}
    assert got == {
        "Chip": ("chip", "T", "industry", 1.0, "theme_mapping"), "new chipset maker": ("chipset", "U", "industry", 0.5, "mapping_normalizer"), "acme corporatio": ("Acme Corporation", "其他", "company", 0.7, "mapping_normalizer"),
        "x y z": ("x y z", "其他", "none", 0.0, "fallback"), "nothing": ("nothing", "其他", "none", 0.0, "fallback"),
    }
    aliases = spark.createDataFrame([("abc", "1"), ("abcd", "2"), ("cd", "3"), ("2330", "4"), ("d e", "5"), ("a", "6")], "alias string, stock_id string")
    texts = spark.createDataFrame([(1, "abcd e"), (2, "xabcxcd"), (3, "2330"), (4, "12330 a2330b"), (5, "23301"), (6, None), (7, "cd e"), (8, "")], "id long, text string")
    for block in (100, 2, 1):
        got = sorted((r["id"], r["stock_id"]) for r in rs.mentions(texts, aliases, block).collect())
        assert got == [(1, "2"), (2, "1"), (2, "3"), (3, "4"), (4, "4"), (4, "6"), (7, "3")]


def test_decile_edges(spark):
    rng = np.random.default_rng(2)
    for values in (rng.lognormal(size=333), rng.integers(-3, 4, 100).astype(float), np.array([2.0]), np.array([0.0, 1e-9, -1e-9, 5.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        edges = st.decile_edges(df, "v").first()["edges"]
        assert np.allclose(edges, np.unique(np.quantile(values, np.arange(11) / 10)), atol=1e-12)


HEALTH = "now string, rss_minutes double, warnings int, stock_day string, stock_exit int, heat_day string, fresh int, active int, history_status string, models_seen boolean, models_processed double, models_stopped string, analyzed int, total_news int, etl_started string, etl_exit int, etl_ok boolean, stats_day string"


def test_components_of_health(spark):
    """Every status of the five components, by rules that shift one fact each."""
    good = {"now": "2026-11-06 19:00:00", "rss_minutes": 20.0, "warnings": 0, "stock_day": "2026-11-06", "stock_exit": 0, "heat_day": "2026-11-05", "fresh": 9, "active": 10, "history_status": "Completed", "models_seen": True, "models_processed": 5.0,
            "models_stopped": "no", "analyzed": 8, "total_news": 10, "etl_started": "2026-11-06 12:00:00", "etl_exit": 3, "etl_ok": True, "stats_day": "2026-11-06"}
    cases = [
        ({}, ("OK", "OK", "OK", "OK", "OK"), 100, "healthy"), ({"warnings": 1}, ("WARN", "OK", "OK", "OK", "OK"), 90, "healthy"), ({"rss_minutes": 121.0, "stock_exit": 1}, ("FAIL", "FAIL", "OK", "OK", "OK"), 60, "attention"),
        ({"stock_day": "2026-11-05", "stock_exit": None}, ("OK", "WARN", "OK", "OK", "OK"), 90, "healthy"), ({"history_status": "Stopped: Google Trends rate limit"}, ("OK", "OK", "WARN", "OK", "OK"), 90, "healthy"), ({"fresh": 1}, ("OK", "OK", "FAIL", "OK", "OK"), 80, "attention"),
        ({"models_seen": None}, ("OK", "OK", "OK", "UNKNOWN", "OK"), 90, "healthy"), ({"models_stopped": "quota", "models_processed": 0.0}, ("OK", "OK", "OK", "FAIL", "OK"), 80, "attention"), ({"models_stopped": "quota"}, ("OK", "OK", "OK", "WARN", "OK"), 90, "healthy"), ({"analyzed": 4}, ("OK", "OK", "OK", "WARN", "OK"), 90, "healthy"),
        ({"stats_day": "2026-11-04"}, ("OK", "OK", "OK", "OK", "WARN"), 90, "healthy"), ({"etl_ok": False, "etl_exit": None}, ("OK", "OK", "OK", "OK", "WARN"), 90, "healthy"), ({"etl_ok": False, "etl_exit": 1}, ("OK", "OK", "OK", "OK", "FAIL"), 80, "attention"), ({"etl_started": "2026-11-05 16:00:00"}, ("OK", "OK", "OK", "OK", "FAIL"), 80, "attention"),
        ({"rss_minutes": None, "stock_day": None, "heat_day": None, "models_stopped": "x", "models_processed": None, "etl_started": None}, ("FAIL", "FAIL", "FAIL", "FAIL", "FAIL"), 0, "failing"),
    ]
    facts = spark.createDataFrame([tuple((good | change)[c.split()[0]] for c in HEALTH.split(", ")) + (i,) for i, (change, *_) in enumerate(cases)], HEALTH + ", i int")
    facts = facts.withColumns({c: F.col(c).cast("timestamp" if c in ("now", "etl_started") else "date") for c in ("now", "stock_day", "heat_day", "etl_started", "stats_day")})
    for r in cv.component_health(facts).collect():
        change, statuses, score, grade = cases[r["i"]]
        assert (tuple(r[c] for c in cv.COMPONENTS), r["score"], r["grade"], r["failing"]) == (statuses, score, grade, "FAIL" in statuses), change


def test_status(spark):
    """Healthy only while nothing is open; each open thing alone makes it pending, old bursts stale."""
    now = F.expr("timestamp '2026-11-06 12:00:00'")
    at, day = dt.datetime(2026, 11, 6, 3), dt.date(2026, 11, 6)
    base = {"bursts": [(1, "a", at, at)], "news": [(1, "t", "Positive", 0.5, "x")], "classes": [("a", "T", "rule", "A", "上市公司")], "prices": [(dt.date(2026, 11, 3),)], "links": [("T", "1", 1)], "stats": [(dt.date(2026, 11, 5),)]}
    schemas = {"bursts": "burst_id int, keyword string, published_at timestamp, fetched_at timestamp", "news": "news_id int, news_title string, news_sentiment string, sentiment_score double, event_type string", "classes": "keyword string, theme_name string, source string, entity_name string, entity_type string", "prices": "date date", "links": "theme_name string, stock_id string, active int", "stats": "date date"}
    old = dt.datetime(2026, 11, 5, 11)
    for change, want in (({}, "healthy"), ({"bursts": [(1, "a", old, old)]}, "stale"), ({"bursts": []}, "stale"), ({"bursts": [*base["bursts"], (2, "b", at, at)]}, "pending"), ({"bursts": [*base["bursts"], (2, " ", at, at)]}, "healthy"), ({"classes": [("a", "其他", "fallback", "A", "上市公司")]}, "pending"),
                         ({"classes": [("a", "T", "rule", None, "上市公司")]}, "pending"), ({"classes": [("a", "T", "rule", "A", "其他")]}, "pending"), ({"news": [(1, "t", "Positive", None, "x")]}, "pending"), ({"news": [(1, None, "Positive", None, "x")]}, "healthy"), ({"prices": [(dt.date(2026, 11, 2),)]}, "pending"), ({"prices": []}, "pending"), ({"stats": [(dt.date(2026, 11, 4),)]}, "pending")):
        t = {k: spark.createDataFrame((base | change)[k], schemas[k]) for k in schemas}
        r = cv.system_status(t["bursts"], t["news"], t["classes"], t["prices"], t["links"], t["stats"], now).first()
        assert r["health"] == want, change
    assert r["history_start"] == day and r["tracked_stock_count"] == 1


def test_live_status(spark):
    rows = spark.createDataFrame([(10.0, 1.0, "green"), (61.0, 1.0, "yellow"), (10.0, 7.5, "yellow"), (10.0, None, "yellow"), (1441.0, 1.0, "red"), (None, 1.0, "red")], "m double, h double, want string")
    assert rows.where(cv.live_status(F.col("m"), F.col("h")) != F.col("want")).collect() == []


def test_empty_forms_match_nothing(spark):
    dictionary = spark.createDataFrame([(1, "---", "company", "9"), (2, "acme", "company", "1"), (3, "acme", "company", "0")], "ordinal long, keyword string, type string, stock_id string")
    got = {r["keyword"]: (r["canonical"], r["type"], r["stock_ids"], r["score"]) for r in rs.fuzzy_match(spark.createDataFrame([("!!!",), ("ACME",), (" ",)], "keyword string"), dictionary).collect()}
    assert got == {"!!!": ("!!!", None, [], 0), "ACME": ("acme", "company", ["1", "0"], 100), " ": ("", None, [], 0)}


def test_repair_with_nulls(spark):
    """Rows without a key come through singly, a survivor keeps its own score and type, conflicts are settled by nobody."""
    at = lambda h: dt.datetime(2026, 9, 1, h)
    bursts = spark.createDataFrame([(1, "a", at(0), "1", at(1)), (2, "a", at(0), "2", at(2)), (3, None, at(0), "3", at(1)), (4, None, at(0), "4", at(1)), (5, "a", None, "5", at(1)), (6, "a", None, "6", at(1)), (7, "", at(0), "7", at(1)), (8, "b", at(0), "8", at(9)), (9, "b", at(0), "9", at(1))], "burst_id long, keyword string, published_at timestamp, approx_traffic string, fetched_at timestamp")
    got = sorted((r["burst_id"], r["approx_traffic"], r["rows"], r["earliest"]) for r in rp.dedupe_bursts(bursts).collect())
    assert got == [(1, "2", 2, True), (3, "3", 1, True), (4, "4", 1, True), (5, "5", 1, True), (6, "6", 1, True), (7, "7", 1, True), (8, "9", 2, False)]
    n = [(1, 1, "u", None, 0.7, "kept"), (2, 2, "u", None, None, None), (3, 1, None, "Positive", 1.0, "x"), (4, 1, None, "Negative", 1.0, "x"), (5, 1, " ", None, None, None), (6, 2, "v", "", 0.1, "own"), (7, 1, "v", "Neutral", 0.2, "donor"), (8, 1, "w", "Positive", 0.3, "p"), (9, 2, "w", "Negative", 0.4, "n"), (10, None, "u", None, None, None)]
    news = spark.createDataFrame(n, "news_id long, burst_id long, news_url string, news_sentiment string, sentiment_score double, event_type string")
    out = {r["news_id"]: tuple(r)[1:] for r in rp.dedupe_news(news, rp.survivor_map(bursts)).collect()}
    assert out == {1: (1, "u", None, 0.7, "kept", 2, False), 3: (1, None, "Positive", 1.0, "x", 1, False), 4: (1, None, "Negative", 1.0, "x", 1, False), 5: (1, " ", None, None, None, 1, False), 6: (1, "v", "Neutral", 0.2, "donor", 2, False), 8: (1, "w", "Positive", 0.3, "p", 2, True), 10: (None, "u", None, None, None, 1, False)}
    odd = sorted(map(tuple, rp.quarantine(bursts, news).collect()))
    assert odd == [("bursts", i, "no key") for i in (3, 4, 5, 6, 7)] + [("bursts", 8, "survivor not fetched first")] + [("news", 3, "no url"), ("news", 4, "no url"), ("news", 5, "no url"), ("news", 8, "sentiments differ")]
    deduped = rp.dedupe_bursts(bursts)
    assert rp.settled(deduped.where("keyword = 'a'"), F.col("earliest"), "late").count() == 3
    with pytest.raises(Exception, match="late"):
        rp.settled(deduped, F.col("earliest"), "late").collect()


def test_link_types(spark):
    """Curated triples, entities' pairs, retired aliases; what is off or has no stock is left alone."""
    links = spark.createDataFrame([(1, "T", "chip", "1", 1, None), (2, "U", "chip", "1", 1, None), (3, "T", "acme", "2", 1, None), (4, "T", "acme", "3", 1, None), (5, "T", "old", "2", 1, "direct"), (6, "T", "chip", "9", 0, None), (7, "T", "none", None, 1, None), (8, "T", "none", "", 1, None)], "id int, theme_name string, keyword string, stock_id string, active int, link_type string")
    curated = spark.createDataFrame([("T", "chip", "1"), ("T", "chip", "9"), ("T", "none", "")], "theme_name string, keyword string, stock_id string")
    entities = spark.createDataFrame([("acme", "2"), ("old", "2"), ("chip", None)], "entity_name string, stock_id string")
    classes = spark.createDataFrame([("old", None, "T", "s", 1, "rule", 0.9), ("older", "old", "T", "s", 1, "rule", 0.9), ("acme", "acme", "T", "s", 1, "rule", 0.9)], "keyword string, canonical_keyword string, theme_name string, sub_theme string, stock_related int, source string, confidence_score double")
    actions, requeue = rs.plan_link_types(links, curated, entities, spark.createDataFrame([("old",)], "keyword string"), classes)
    assert {r["id"]: r["action"] for r in actions.collect()} == {1: "theme", 2: "deactivate", 3: "direct", 4: "deactivate", 5: "deactivate"}
    s = rs.link_type_summary(actions, requeue).first()
    assert tuple(s) == (5, 1, 1, 3, 3, 2, 1, 2, ["old"])
    after = rs.apply_link_types(links, actions)
    assert {r["id"]: (r["link_type"], r["active"]) for r in after.collect()} == {1: ("theme", 1), 2: (None, 0), 3: ("direct", 1), 4: (None, 0), 5: ("direct", 0), 6: (None, 0), 7: (None, 1), 8: (None, 1)}
    assert rs.verify_link_types(after, actions).collect() == []
    assert {tuple(r) for r in rs.verify_link_types(links, actions).collect()} == {("untyped", 0, 4), ("typed", 2, 1)}
    new = {r["keyword"]: tuple(r)[2:] for r in rs.apply_requeue(classes, requeue).collect()}
    assert new["old"] == new["older"] == ("其他", "未分類", 0, "fallback", 0.0) and new["acme"][0] == "T"


def test_paths_by_kind(spark):
    """One path for direct stocks and one for baskets, normal levels from the start on, windows that are cut off left out."""
    d = days(40)
    rng = np.random.default_rng(3)
    ar = {s: rng.normal(size=40) / 100 for s in ("1101", "1102", "1103")}
    ar["1103"][20] = np.nan
    rows = [(x, s, k + 1, None if np.isnan(v[k]) else float(v[k])) for s, v in ar.items() for k, x in enumerate(d)]
    daily = spark.createDataFrame(rows, "date date, stock_id string, day int, ar double")
    calendar = spark.createDataFrame([(x, k + 1) for k, x in enumerate(d)], "date date, day int")
    e = [("k1", "1101", "direct", "X", d[19], 1, 5.0), ("k0", "1101", "direct", "Y", d[19], -3, 2.0), ("k1", "1101", "direct", "X", d[2], 1, 1.0), ("k1", "1102", "theme", "T", d[19], 2, 5.0), ("k2", "1102", "theme", "T", d[19], 7, 9.0), ("k2", "1103", "theme", "T", d[19], 7, 9.0), ("k1", "0050", "direct", "X", d[19], 1, 1.0), ("k9", "1102", "theme", "T", dt.date(2030, 1, 1), 1, 1.0), ("k1", "1101", "direct", "X", dt.date(1990, 1, 1), 1, 1.0)]
    pairs = rt.event_pairs(spark.createDataFrame(e, "keyword string, stock_id string, link_type string, theme_name string, date date, tone int, traffic double"), calendar, daily)
    units = {(r["kind"], r["unit"], r["day"]): (r["stock_ids"], r["keywords"], r["tone"], r["traffic"]) for r in rt.event_units(pairs).collect()}
    assert units == {("direct", "1101", 20): (["1101"], ["k0"], -3, 2.0), ("direct", "1101", 3): (["1101"], ["k1"], 1, 1.0), ("direct", "1101", 1): (["1101"], ["k1"], 1, 1.0), ("theme", "T", 20): (["1102", "1103"], ["k1", "k2"], 9, 9.0)}
    start = d[10]
    got = {(r["kind"], r["offset"]): r for r in rt.cumulative_paths(pairs, rt.path_windows(daily, str(start))).collect()}
    assert len(got) == 32
    for kind, stocks in (("direct", ["1101"]), ("theme", ["1102", "1103"])):
        window = np.nanmean([ar[s][14:30] for s in stocks], axis=0)
        level = np.mean([np.nanmean(ar[s][10:]) for s in stocks])
        for i, o in enumerate(range(-5, 11)):
            car = window[5 : i + 1].sum() if o >= 0 else -window[i + 1 : 5].sum()
            r = got[kind, o]
            assert r["n"] == 1 and r["se"] is None and r["mean_path"] == pytest.approx(car, abs=1e-12) and r["adjusted_path"] == pytest.approx(car - level * (o + 1), abs=1e-12)
    ends = {r["kind"]: r["car"] for r in rt.end_table(rt.cumulative_paths(pairs, rt.path_windows(daily, str(start)))).collect()}
    assert set(ends) == {"direct", "theme"}


def test_event_days_count_news_once(spark):
    """A news of two keywords of the day counts once, the first keyword's returns stand, even where they are null."""
    day = dt.date(2026, 9, 1)
    e = spark.createDataFrame([("1", day, day, "b", "theme", "news、listing", 5.0, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2), ("1", day, day, "a", "direct", "heat", 9.0, None, 0.1, 0.1, 0.1, 0.1, 0.1), ("1", dt.date(2026, 9, 2), day, "a", "direct", "heat", None, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1)],
                              "stock_id string, date date, market_date date, keyword string, link_type string, triggers string, traffic double, " + ", ".join(f"{c} double" for c in ev.RETURNS))
    n = [(i, k, day, f"t{i}", "s", f"u{i}", tone, kind) for i, k, tone, kind in ((1, "a", "Positive", "x"), (1, "b", "Positive", "x"), (2, "b", "Negative", "y"), (3, "a", "Neutral", "y"), (4, "c", "Positive", "z"), (5, "a", "Unanalyzed", "其他"), (6, "a", "Positive", None), (7, "a", "Positive", "w"), (8, "a", "Positive", "v"))]
    news = spark.createDataFrame(n, "news_id int, keyword string, date date, news_title string, news_source string, news_url string, news_sentiment string, event_type string")
    a, b = ev.merge_days(e, news).orderBy("number").collect()
    assert (a["keywords"], a["link_types"], a["triggers"], a["traffic"], a["return_1d"], a["return_5d"]) == (["a", "b"], ["direct", "theme"], ["heat", "listing", "news"], 9.0, None, 0.1)
    assert (a["news_count"], a["positive"], a["neutral"], a["negative"], a["event_types"]) == (7, 4, 1, 1, ["y", "v", "w"])
    assert [h["news_title"] for h in a["headlines"]] == ["t1", "t2", "t3", "t5", "t6"] and a["headlines"][1]["news_sentiment"] == "Negative"
    assert (b["number"], b["news_count"], b["headlines"], b["traffic"]) == (2, 0, None, None)


def test_last_exit_counts(spark):
    lines = ["[2026/09/01  8:00:00.10] etl start", "[2026/09/01  8:10:00.10] etl exit 0", "[2026/09/01  9:00:00.10] etl start", "[2026/09/01  9:30:00.10] etl exit 3", "[2026/09/01 10:00:00.10] etl start"]
    df = spark.createDataFrame([("etl", i, v) for i, v in enumerate(lines)], "job string, line int, value string")
    assert lg.last_finished(df).first()["last_run"] == dt.datetime(2026, 9, 1, 9, 30)


def test_acceptance(spark):
    """What stands after the exit line doesn't count; every verdict is reached."""
    from heedstream.operators import acceptance as ac

    lines, n = [], 0
    for day, requests, items, backlog in ((1, 10, 100, 9000), (2, 10, 0, 9500), (11, 20, 4000, 8000), (12, 20, 4000, 6000), (13, 20, 4000, 5000), (14, 20, 4000, 3000)):
        lines += [f"[2026/10/{day:02d}  8:00:00.10] etl start", f"Requests: {requests}", f"Processed: {items} (news {items})", f"Skipped: keywords {backlog // 10}, news {backlog}", f"503 Count: {requests // (2 if day < 10 else 5)}", "Stopped: no" if day < 14 else "Stopped: all models unavailable now"]
        lines += ["News AI batch failed (20 items): timeout"] * (day == 14) + [f"[2026/10/{day:02d}  8:30:00.10] etl exit 0", "Requests: 777"]
    df = spark.createDataFrame([("etl", i, v) for i, v in enumerate(lines)], "job string, line int, value string")
    stats = ac.periods(ac.run_stats(df), F.expr("timestamp '2026-10-02 00:00:00'"), F.expr("timestamp '2026-10-10 00:00:00'"))
    r = {x["period"]: x for x in ac.cutover_summary(stats, 15).collect()}
    assert (r["before"]["runs"], r["before"]["news_backlog_per_day"], r["before"]["zero_runs_share"]) == (1, 0.0, 100.0)
    a = r["after"]
    assert (a["runs"], a["quota_days"], a["requests"], a["items_per_request"], a["s503_share"], a["all_models_out"], a["batch_failures"], a["news_backlog_first"], a["news_backlog_last"]) == (4, 4, 80, 200.0, 20.0, 1, 1, 8000, 3000)
    assert a["news_backlog_per_day"] == pytest.approx(-5000 / 3)
    snap = spark.createDataFrame([(25.0, {"Positive": 450, "Negative": 50})], "coverage double, sentiments map<string,bigint>")
    judged = lambda summary, hours: {x["check"]: x["verdict"] for x in ac.acceptance(summary, snap, hours).collect()}
    got = judged(ac.cutover_summary(stats, 15), 80.0)
    assert got == {"news backlog": "pass", "keyword backlog": "pass", "share of 503": "pass", "runs without items": "pass", "items per request": "pass", "items per quota day": "pass", "all models out": "pass", "coverage": "short", "whole answers": "short", "one sentiment": "fail"}
    assert set(judged(ac.cutover_summary(stats.where("period = 'before'"), 15), 10.0).values()) == {"watching", "fail"}
    assert [x["message"] for x in ac.latest_failures(df, stats).collect()] == ["timeout"]


def test_folded_tables_stay_small(spark, tmp_path):
    """Files stay few, a batch may run again at any time, and readers see whole batches."""
    from heedstream.streaming.streams import Folded

    schema = spark.createDataFrame([], "k int, n long").schema
    table = Folded(spark, str(tmp_path), schema, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), every=3, buckets=1)
    want = {}
    for batch in range(14):
        for again in range(1 + (batch % 4 == 1)):
            table.write(spark.createDataFrame([(batch % 5, 1), (9, batch)], schema), batch)
        for k, n in ((batch % 5, 1), (9, batch)):
            want[k] = want.get(k, 0) + n
        if batch % 5 == 3:
            assert {r["k"]: r["n"] for r in table.read().collect()} == want
    assert {r["k"]: r["n"] for r in table.read().collect()} == want
    assert sum(r["n"] for r in table.before(13).collect()) == sum(want.values()) - 14
    names = sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("run-"))
    assert len(names) <= 10 and len(table.runs()) <= 6 and len(table.manifests()) <= 2


def test_counters_of_the_stream(spark, tmp_path):
    """The counters that the stream observes are those of the batch form, batch by batch, and again after a restart."""
    from heedstream.streaming import streams as sm

    at = lambda h: dt.datetime(2026, 9, 1, h)
    schema = "batch long, fetched_at timestamp, keyword string, published_at timestamp, approx_traffic string, usable boolean, broken boolean, news array<struct<news_item_title:string,news_item_url:string,news_item_source:string>>"
    item = lambda b, h, k, news, usable=True, broken=False: (b, at(h), k, at(0), f"{h}+", usable, broken, [(u, u, "s") for u in news])
    polls = [[item(0, 1, "a", "xy"), item(0, 1, "b", "x"), item(0, 1, None, "z", False)], [item(1, 2, "a", "xz"), item(1, 2, "c", "", True, True), item(1, 2, "d", "x"), item(1, 3, "d", "xx")], [item(2, 4, "a", "x")]]
    folder = f"{tmp_path}/in"
    for rows in polls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        out = sm.collect_items(sm.read_files(spark, folder, spark.createDataFrame([], schema).schema), f"{tmp_path}/job", every=2)
    every = spark.createDataFrame([x for rows in polls for x in rows], schema)
    none = every.select("keyword", "published_at").limit(0)
    want = sorted(map(tuple, up.collect_counts(none, none.withColumn("news_url", F.lit("")), every).collect()))
    assert sorted(map(tuple, out["counts"].collect())) == want == [(0, 2, 2, 0, 3, 1, 0), (1, 4, 2 - 1, 2, 2, 0, 1), (2, 1, 0, 1, 0, 0, 0)]
    assert sorted((r["keyword"], r["approx_traffic"]) for r in out["bursts"].collect()) == [("a", "4+"), ("b", "1+"), ("d", "3+")]
    assert out["news"].count() == 5


def test_set_columns(spark):
    old = spark.createDataFrame([("a", 1, "x", "n"), (None, 2, "x", "n")], "k string, v int, w string, note string")
    new = spark.createDataFrame([("a", 5, "y", "lost"), ("b", 6, "z", "new"), (None, 7, "q", "new")], "k string, v int, w string, note string")
    got = sorted(map(tuple, up.upsert_columns(old, new, ["k"], ["v", "w"]).collect()), key=str)
    assert got == sorted([("a", 5, "y", "n"), ("b", 6, "z", "new"), (None, 2, "x", "n"), (None, 7, "q", "new")], key=str)


def test_streams_survive_a_restart(spark, tmp_path):
    """T1 and T5, stopped and started again between files, end as one run over all of them does."""
    from heedstream.streaming import streams as sm

    schema = "keyword string, published_at timestamp, fetched_at timestamp, approx_traffic string, source string"
    at = lambda h: dt.datetime(2026, 9, 1, h)
    polls = [[("a", at(0), at(1), "1", "x"), ("b", at(0), at(1), "1", "y")], [("a", at(0), at(3), "3", "x"), ("a", at(0), at(1), "1", "x")], [("a", at(0), at(2), "2", "y"), ("c", at(5), at(6), "9", "x")], []]
    folder = f"{tmp_path}/in"

    def run(where):
        stream = sm.read_files(spark, folder, spark.createDataFrame([], schema).schema)
        bursts, log = sm.collect(stream, f"{tmp_path}/{where}", every=2)
        fresh = sm.freshness(stream.select("source", F.col("fetched_at").alias("observed_at")), f"{tmp_path}/{where}-fresh")
        return [sorted(map(tuple, df.collect())) for df in (bursts, log, fresh)]

    for rows in polls:
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        steps = run("many")
    assert steps == run("one") == run("many")
    assert steps[0] == [("a", at(0), at(1), "3"), ("b", at(0), at(1), "1"), ("c", at(5), at(6), "9")] and len(steps[1]) == 5
    assert steps[2] == [("x", at(6)), ("y", at(2))]


def test_session_shares(spark):
    rows = spark.createDataFrame([(dt.datetime(2026, 11, 6, h, m), s) for h, m, s in ((8, 59, "1"), (9, 0, "1"), (13, 29, "2"), (13, 30, "1"))] + [(dt.datetime(2026, 11, 7, 10), "3")], "when timestamp, stock_id string")
    r = ev.session_shares(rows).first()
    assert [r[f"{k}_share"] for k in ("pre", "in", "after", "weekend")] == pytest.approx([0.2, 0.4, 0.2, 0.2])
    assert [(x["stock_id"], x["mentions"]) for x in ev.most_mentioned(rows, 2).collect()] == [("1", 3), ("2", 1)]


def test_flags_leave_rows_in_the_partitions_of_their_stock(spark):
    """usable days meet the panel by stock alone."""
    d0 = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([(s, d0 + dt.timedelta(k), k + 1) for s in "12" for k in range(12)], "stock_id string, date date, day int")
    calendar = daily.where("stock_id = '1' and day <> 3").select("date", "day")
    events = spark.createDataFrame([("1", d0 - dt.timedelta(3)), ("1", d0 + dt.timedelta(2)), ("2", d0 + dt.timedelta(40))], "stock_id string, date date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = ev.near(ev.flag_days(daily, ev.usable_days(events, calendar, 1), "flag"), "flag")
    assert sorted((r["stock_id"], r["day"]) for r in out.where("flag").collect()) == [("1", 2), ("1", 5)]
    assert out.where("near_event").count() == 10
    assert not re.search(r"hashpartitioning\(stock_id#\d+, day", out._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_windows_are_not_shuffled_by_day(spark):
    """values around chosen rows come from one array a stock."""
    rows = [(s, k, float(k), k == 10, k < 3, 0) for s in "12" for k in range(1, 41)]
    panel = spark.createDataFrame(rows, "stock_id string, day int, today double, flag boolean, near_event boolean, bucket int")
    got = {r["offset"]: r["event"] for r in st.event_profile(panel, panel.drop("bucket"), "flag", F.col("day")).collect()}
    assert got == {o: 10.0 + o for o in range(-5, 21)}


def test_missing_days_are_made_in_the_partitions_of_their_stock(spark):
    """One exchange of the stocks' own rows makes the calendar of each; a stock that only has other days has all days without a price."""
    d0 = dt.date(2024, 1, 1)
    day = lambda *ks: [d0 + dt.timedelta(k) for k in ks]
    rows = [("0050", d, 10.0 + k) for k, d in enumerate(day(0, 1, 3, 4))] + [("1", d, p) for d, p in zip(day(1, 2, 4), (5.0, 9.0, 6.0), strict=True)] + [("2", d0 + dt.timedelta(2), 1.0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = rt.daily_abnormal(spark.createDataFrame(rows, "stock_id string, date date, adj_close double"), "0050")
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(r["stock_id"], r["day"]): (r["date"], r["price"]) for r in out.collect()}
    assert got == {(s, k + 1): (d, {("1", 2): 5.0, ("1", 4): 6.0}.get((s, k + 1))) for s in "12" for k, d in enumerate(day(0, 1, 3, 4))}
    assert plan.count("Exchange hashpartitioning") == 1
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_news_common_to_a_day_count_as_if_told_under_each_keyword(spark):
    """common news are one row a day, and give what a row for each keyword gives."""
    e = spark.createDataFrame([(s, dt.date(2024, 1, d), k) for s, d, k in (("1", 2, "a"), ("1", 2, "b"), ("2", 2, "b"), ("2", 3, "c"))], "stock_id string, date date, keyword string")
    e = e.select("*", F.col("date").alias("market_date"), F.lit("direct").alias("link_type"), F.lit("listing").alias("triggers"), F.lit(1.0).alias("traffic"), *[F.lit(0.5).alias(c) for c in ev.RETURNS])
    columns = "news_id long, keyword string, date date, news_title string, news_source string, news_url string, news_sentiment string, event_type string"
    row = lambda i, k, d: (i, k, dt.date(2024, 1, d), f"t{i}", "s", "u", "Positive" if i % 2 else "Negative", f"type{i % 4}" if i % 3 else None)
    own = [row(i, "ab"[i % 2], 2) for i in range(0, 8)]
    shared = [row(i, None, 2) for i in range(4, 20, 4)] + [row(30, None, 3)]
    own = [r for r in own if r[0] not in {x[0] for x in shared}]
    spread = own + [(r[0], k, *r[2:]) for r in shared for k in "abc"]
    rows = lambda df: sorted(df.collect(), key=lambda r: (r["stock_id"], r["date"]))
    want = rows(ev.merge_days(e, spark.createDataFrame(spread, columns)))
    got = rows(ev.merge_days(e, spark.createDataFrame(own, columns), common=spark.createDataFrame(shared, columns).drop("keyword")))
    assert got == want and got[0]["news_count"] == 11


def test_heat_meets_the_rows_of_pairs_without_a_shuffle(spark):
    """rows with the returns around them are not dealt by keyword and day."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(40)]
    r = spark.createDataFrame([("1", d, float(k % 7)) for k, d in enumerate(days)], "stock_id string, date date, r double")
    heat = spark.createDataFrame([("a", d, float(k % 5)) for k, d in enumerate(days)], "keyword string, date date, heat double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = st.cross_correlation(heat, r, spark.createDataFrame([("1", "a")], "stock_id string, keyword string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((keyword#\d+, date|date#\d+, keyword)", plan)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_decimal_is_that_of_the_value_itself(spark):
    """0.35 is less than its decimal text, and 0.25 is a tie that goes to the even digit."""
    from heedstream.functions.exprs import one_decimal

    values = [0.25, 0.35, 2.675, 12.35, 0.05, 99.95, -1.45, 0.0, 1e13, *[k / 20 for k in range(400)]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in got} == {v: "%.1f" % v for v in values}


def test_terms_that_a_keyword_holds_whole_are_compared_with_nothing_else(spark):
    """whole forms meet by an equi-join; likeness is worked out only for keywords that hold no term and stand in none."""
    terms = spark.createDataFrame([(k, f"Supplier#{k:09d}", "company", str(1000 + k)) for k in range(40)], "ordinal long, keyword string, type string, stock_id string")
    asked = spark.createDataFrame([(f"SUPPLIER#{k:09d}x",) for k in range(40)] + [("000000007",), ("Suplier#00000003y",)], "keyword string")
    plain = rs.likeness
    got = {r["keyword"]: (r["canonical"], r["score"]) for r in rs.fuzzy_match(asked, terms).collect()}
    form = lambda x: x.lower().replace("#", "")
    for k, (canonical, score) in got.items():
        each = {t: max(plain(form(k), form(t)), rs.window_likeness(form(k), form(t))) for t in (f"Supplier#{i:09d}" for i in range(40))}
        best = max(each, key=lambda t: (each[t], len(t), [-i for i in range(40) if t.endswith(f"{i:09d}")]))
        assert (canonical, score) == (best, int(each[best]))
    nodes = rs.fuzzy_match(asked, terms)._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" in nodes


def test_theme_statistics_of_many_themes_are_not_made_in_one_task(spark):
    day = dt.date(2024, 1, 1)
    heat = spark.createDataFrame([(day, "t0", "k", 2.0), (day + dt.timedelta(2), "t0", "k", None), (day + dt.timedelta(1), "loose", "k", 1.0)], "date date, theme_name string, keyword string, trend_score double")
    bursts = spark.createDataFrame([(1, day, "t0"), (2, day, "t0")], "burst_id long, date date, theme_name string")
    news = spark.createDataFrame([(1, day + dt.timedelta(2), "t1")], "news_id long, date date, theme_name string")
    mapping = spark.createDataFrame([(f"t{k}", "1001", 1) for k in range(50)] + [("off", "1001", 0)], "theme_name string, stock_id string, active int")
    out = cv.theme_daily_stats(heat, bursts, news, mapping)
    rows = {(r["theme_name"], (r["date"] - day).days): tuple(r)[2:] for r in out.collect()}
    assert len(rows) == 50 * 3 + 1 and rows["loose", 1] == (1, 0, 0, 0, 1.0, 1.0)
    assert rows["t0", 0] == (1, 2, 0, 1, 2.0, 2.0) and rows["t0", 1] == (0, 0, 0, 1, None, None) and rows["t0", 2] == (1, 0, 0, 1, None, None) and rows["t1", 2] == (0, 0, 1, 1, None, None)
    parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1


def test_numbered_names_are_compared_only_where_their_patterns_are_alike(spark):
    # 4 million pairs share a piece of digits
    names = spark.range(2000).select(F.format_string("Customer#%09d", "id").alias("keyword"))
    firms = spark.range(2000).select((F.col("id") + 10).alias("ordinal"), F.format_string("Supplier#%09d", "id").alias("keyword"), F.lit("company").alias("type"), F.lit("1001").alias("stock_id"))
    near = spark.createDataFrame([(1, "Customer#00000001x", "company", "1002")], firms.schema)
    start = time.monotonic()
    got = {r["keyword"]: (r["canonical"], r["score"]) for r in rs.fuzzy_match(names, firms.union(near)).where("type is not null").collect()}
    form = "customer00000001x"
    want = {k: int(max(rs.likeness(k.lower().replace("#", ""), form), rs.window_likeness(k.lower().replace("#", ""), form))) for k in (f"Customer#{k:09}" for k in range(100))}
    assert {k: ("Customer#00000001x", v) for k, v in want.items() if v >= 88} == {k: v for k, v in got.items() if k in want}
    assert time.monotonic() - start < 60


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prices_are_dealt_by_stock_once(spark, sf_dir):
    rows = rt.numbered(ad.prices(spark, sf_dir))
    assert plan(rows).count("hashpartitioning(stock_id") == 1
    assert {r["stock_id"] == ad.BENCHMARK for r in rows.select("stock_id").distinct().collect()} == {True, False}


def test_news_are_dealt_with_what_a_reader_asks_for(spark, sf_dir):
    assert "p_name" not in plan(fr.quiet(spark, sf_dir)) and "p_name" in plan(ad.news(spark, sf_dir))


@pytest.mark.parametrize("name", ["w20_components", "g30_component_report", "g36_volatility_at_events"])
def test_days_of_a_stock_meet_events_by_stock(spark, sf_dir, name):
    assert not re.search(r"hashpartitioning\(stock_id#\d+, (day0|date)#", plan(registry.QUERIES[name](spark, sf_dir)))


def test_paths_are_cut_where_events_begin(spark, sf_dir):
    text = plan(registry.QUERIES["w23_path_segments"](spark, sf_dir))
    assert not re.search(r"Window \[collect_list", text) and "max_gain_10d" not in text


def test_event_units_read_no_prices(spark, sf_dir):
    text = plan(registry.QUERIES["w18_event_units"](spark, sf_dir))
    assert "/prices-" not in text and "l_discount" not in text


def test_news_of_merged_days_are_dealt_by_stock_and_day_alone(spark):
    events = spark.createDataFrame([], "stock_id string, date date, market_date date, keyword string, link_type string, triggers string, traffic double, " + ", ".join(f"{c} double" for c in ev.RETURNS))
    news = spark.createDataFrame([], "news_id long, keyword string, date date, news_title string, news_source string, news_url string, news_sentiment string, event_type string")
    rows = spark.createDataFrame([("1001", dt.date(2024, 1, 1))], "stock_id string, date date").join(events.drop("stock_id", "date"), how="left").select(*events.columns)
    text = ev.merge_days(rows, news.union(spark.range(1).selectExpr("id", "'k'", "date '2024-01-01'", "'t'", "'s'", "'u'", "'Neutral'", "'x'")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(stock_id#\d+, date#\d+, news_id", text)


def test_w4_events_meet_their_baskets_as_arrays(spark):
    prices = spark.createDataFrame([(s, dt.date(2020, 1, 1 + 2 * k), c) for s, line in (("1101", (10.0, 11.0, 0.0, 22.0, 5.0)), ("1102", (4.0, 2.0, None, 8.0, 1.0))) for k, c in enumerate(line)], "stock_id string, date date, close double")
    dates = spark.createDataFrame([("A", dt.date(2020, 1, d)) for d in (1, 2, 2, 4, 7, 9, 10)] + [("A", None), ("B", dt.date(2019, 12, 1)), ("C", dt.date(2020, 1, 1))], "cluster string, date date")
    baskets = spark.createDataFrame([("A", "1101"), ("A", "1102"), ("A", "1102"), ("B", "1102"), ("B", "1103"), ("B", None)], "cluster string, stock_id string")
    aligned = rt.aligned_returns(dates, baskets, prices, (0, 1, 3))
    got = {(r["cluster"], r["stock_id"], r["date"].day): (r["day0_date"].day, r["returns"]) for r in aligned.collect()}
    # the third close of one stock is zero, of the other unknown: events of its day have no base
    assert got == {
        ("A", "1101", 1): (1, [0.0, 11 / 10 - 1, 22 / 10 - 1]), ("A", "1101", 2): (3, [0.0, -1.0, 5 / 11 - 1]), ("A", "1101", 7): (7, [0.0, 5 / 22 - 1, None]), ("A", "1101", 9): (9, [0.0, None, None]),
        ("A", "1102", 1): (1, [0.0, -0.5, 1.0]), ("A", "1102", 2): (3, [0.0, None, -0.5]), ("A", "1102", 7): (7, [0.0, 1 / 8 - 1, None]), ("A", "1102", 9): (9, [0.0, None, None]),
        ("B", "1102", 1): (1, [0.0, -0.5, 1.0])}
    lines = plan(aligned).splitlines()
    first = next(k for k, x in enumerate(lines) if re.search(r"Exchange|Sort |Window", x))
    assert any("Generate explode" in x for x in lines[:first])  # no row of an event and a stock is shuffled or sorted


def test_forward_returns_of_the_study_are_those_of_all_calendar_days(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    rng = np.random.default_rng(5)
    rows = [("0050", day(2 * k), None if k == 7 else 0.0 if k == 9 else 50.0 + k) for k in range(40)]
    rows += [(str(1101 + i), day(k), p) for i in range(6) for k in range(-3, 85) if rng.random() < 0.1 + 0.18 * i for p in [None if k == 6 else 0.0 if k == 20 else float(rng.integers(5, 99))]]
    rows += [("1109", day(1), 3.0), ("1109", day(3), 3.0), ("1108", None, 4.0), ("1108", day(0), 1.0), ("1108", day(2), 2.0)]  # two days that the calendar has not, and a price of no day
    prices = spark.createDataFrame(rows, "stock_id string, date date, price double")
    daily = rt.daily_abnormal(prices.where("date is not null"), "0050", "price")
    for n in rt.HORIZONS:
        daily = rt.forward_abnormal(daily, n, "after", f"ar{n}")
    names = [f"ar{n}" for n in rt.HORIZONS]
    want = {(r["stock_id"], r["day"]): tuple(r[c] for c in names) for r in daily.collect() if any(r[c] is not None for c in names)}
    lines = rt.price_lines(prices)
    found = rt.study_returns(lines, rt.line_calendar(lines, "0050"), "0050", "2020-02-10")
    text = plan(found)
    assert text.count("Generate") <= 2 and "sequence(" not in text  # of the benchmark's days alone
    got = found.collect()
    mine = {(r["stock_id"], x["day"]): tuple(x[c] for c in names) for r in got for x in r["line"]}
    assert mine.keys() == want.keys() and len(want) > 100
    assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-12)) for k in want for a, b in zip(mine[k], want[k]))
    assert {r["start"] for r in got} == {21}
    for r in got:
        for n in rt.HORIZONS:
            known = [v[names.index(f"ar{n}")] for (s, d), v in want.items() if s == r["stock_id"] and d >= 21 and v[names.index(f"ar{n}")] is not None]
            assert r[f"base{n}"] is None if not known else math.isclose(r[f"base{n}"], sum(known) / len(known), abs_tol=1e-12)


def test_study_reads_no_news_and_deals_no_event_of_a_stock_by_itself(spark, sf_dir):
    text = plan(registry.QUERIES["g6_excess_table"](spark, sf_dir))
    assert "/days-" in text and "/lines-" not in text and not re.search(r"hashpartitioning\(stock_id#\d+, day#", text)


def _broadcasts(plan: str) -> list[str]:
    """The subtree of each broadcast of hashed rows in a printed plan; single rows are broadcast as they are."""
    lines, out = plan.split("\n"), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange HashedRelation" in line:
            n = next((k for k, x in enumerate(lines[i + 1 :]) if depth(x) <= depth(line)), len(lines))
            out.append("\n".join(lines[i : i + 1 + n]))
    return out


@pytest.mark.parametrize("name", ["j3_fuzzy_match", "j10_rule_classify", "g41_daily_update"])
def test_pieces_of_names_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    """Pieces and stretches are many times their table, which the plan's estimate doesn't see; gathered for a broadcast they filled the driver."""
    plans, real = [], rs.stage

    def staged(df, to):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, to)

    monkeypatch.setattr(rs, "stage", staged)
    out = registry.QUERIES[name](spark, sf_dir)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Generate explode" in p for p in plans) >= 2
    assert not [b for p in plans for b in _broadcasts(p) if "Generate explode" in b]


def test_fuzzy_match_asks_for_every_name(spark, sf_dir):
    """j3 asks for all names, changed names and codes of suppliers, all nations, brands and types."""
    got = {r["keyword"] for r in registry.QUERIES["j3_fuzzy_match"](spark, sf_dir).collect()}
    table = lambda name, c: {r[c] for r in ad.table(spark, sf_dir, name).select(c).collect()}
    names = table("supplier", "s_name")
    want = names | {x.upper() + "x" for x in names} | {str(k + 1000) for k in table("supplier", "s_suppkey")} | table("nation", "n_name") | table("part", "p_brand") | table("part", "p_type")
    assert got == want


def test_log_facts_deal_lines_once_without_their_texts(spark, monkeypatch):
    """runs and blocks that go over the stretches in which lines are dealt are those of ``logs.job_runs`` and ``logs.blocks``."""
    rng = np.random.default_rng(4)
    staged, real = [], cv.stage
    monkeypatch.setattr(cv, "stage", lambda df, name: (staged.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    for size in (3, 7, 4096):
        monkeypatch.setattr(lg, "BLOCK", size)
        made = ["[2024/01/{d:02d}  9:00:00.10] etl start", "[2024/01/{d:02d} 10:30:00.10] etl exit {x}", "Gemini Stats", "Processed: {x} (news {x})", "Stopped: no", "Stopped: daily", "Requests: {x}", "Completed", "Stopped: Google Trends limit", "Success: {x}", "Theme ETL completed: 1", "Traceback (most recent call last):", "other line"]
        chances = np.array([3, 2, 4, 4, 3, 3, 6, 3, 2, 4, 1, 1, 1]) / 37
        log = [("etl", i, made[k].format(d=int(rng.integers(1, 28)), x=int(rng.integers(0, 4)))) for i, k in enumerate(rng.choice(13, 120, p=chances))]
        log += [("stock_collector", i, v) for i, v in enumerate(["[2024/01/02  9:00:00.10] stock_collector start", "寫入 75 筆行情", "[2024/01/03  9:00:00.10] stock_collector start", "[2024/01/03  9:10:00.10] stock_collector exit 2"])]
        lines = spark.createDataFrame(log, "job string, line long, value string")
        got = cv.log_facts(lines).first()
        runs = {r["run"]: r for r in lg.job_runs(lines.where("job = 'etl'"), "Theme ETL completed", (0, 3)).collect()}
        said: dict = {}
        for r in lg.blocks(lines.where("job = 'etl'")).collect():
            said.setdefault(r["run"], {})[r["block"], r["key"]] = r["value"]
        number = lambda run, key: float(re.match(r"\d*", said.get(run, {}).get(key) or "0")[0] or 0)
        newest = lambda of: runs[max(of)]["started_at"] if of else None
        last = max(runs)
        assert (got["etl_started"], got["etl_exit"], got["etl_ok"]) == (runs[last]["started_at"], runs[last]["exit_code"], runs[last]["success"])
        assert got["etl_success"] == newest([k for k, r in runs.items() if r["success"]])
        assert got["heat_success"] == newest([k for k in runs if number(k, ("history", "Success")) > 0]) and got["models_success"] == newest([k for k in runs if number(k, ("gemini", "Processed")) > 0])
        own = said.get(last, {})
        assert (got["history_status"], got["models_stopped"]) == (own.get(("history", "status")), own.get(("gemini", "Stopped")))
        assert bool(got["models_seen"]) == any(b == "gemini" for b, _ in own) and (got["models_processed"] or 0) == number(last, ("gemini", "Processed"))
        assert (got["stock_exit"], got["stock_success"]) == (2, dt.datetime(2024, 1, 2, 9))
    assert len(staged) == 3 and all(len(re.findall(r"Exchange hashpartitioning", p)) == 1 for p in staged)
