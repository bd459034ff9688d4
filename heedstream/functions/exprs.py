"""Scalar expressions on columns: text and name forms, days and zones, grades and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
THEME_ALIASES = {"能源與原物料": "能源與原物料類", "電商與零售": "電商與零售類", "綠能環保": "綠能環保類"}
INDUSTRY_RULES = (
    ("金融類", ("金融", "銀行", "金控", "證券", "保險", "etf")),
    ("生技醫療類", ("生技", "醫療", "製藥", "藥品", "醫材")),
    ("科技類", ("科技", "電子", "半導體", "asic", "ai", "伺服器", "網通", "記憶體", "pcb", "電腦", "銅箔基板", "光電", "光學", "通信", "通訊", "網路", "電路板", "被動元件", "資訊", "軟體", "矽智財", "電機機械", "機械電機")),
    ("能源與原物料類", ("航運", "能源", "原物料", "石化", "鋼鐵", "銅價", "煤", "原油", "化學", "塑膠", "水泥", "玻璃")),
    ("食品與消費類", ("食品", "餐飲", "消費", "零售")),
    ("電商與零售類", ("電商", "物流", "網購")),
    ("綠能環保類", ("綠能", "環保", "太陽能", "風電", "電動車", "重電")),
    ("遊戲娛樂類", ("遊戲", "娛樂", "影視", "電競", "觀光遊樂", "文化創意")),
)
OTHER_THEME = "其他"
COMPANY_NOISE = r"股份有限公司|有限公司|公司|-KY|KY|-創|\*|\s"
ENTITY_SUFFIXES = ("股價分析", "股票走勢", "股價", "股票", "股市")
ENTITY_PREFIXES = ("妖股", "飆股")
SENTIMENTS = ("Positive", "Neutral", "Negative")
UNANALYZED = "Unanalyzed"
LISTED_CODE, YEAR_LIKE = r"^\d{4,6}[A-Z]?$", r"^20[23]\d$"


def traffic_number(c: Column) -> Column:
    """F1: "2,000+" or "1.5K+" to a number; without a number 0."""
    text = F.regexp_replace(F.upper(c), ",", "")
    number = F.regexp_extract(text, r"([\d.]+)\s*([KMB]?)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([\d.]+)\s*([KMB]?)", 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce(number * scale, F.lit(0.0))


def traffic_digits(c: Column) -> Column:
    """the first whole number without regard to units; null without one."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+)", 1).try_cast("double")


def casefold(c: Column) -> Column:
    """Unicode case folding (Cherokee letters become small): ß as ss, every sigma as σ, ligatures and letter-like signs as letters.

    Upper case undoes what lower case leaves apart (and the other way round). The dotless i, whose upper
    case is I, waits as a private character; sigma is folded by itself, for
    lower case has another one for the end of words.
    """
    upper = F.translate(F.upper(F.translate(F.lower(c), "ı", "\ue000")), "Σ", "σ")
    return F.translate(F.lower(upper), "\ue000", "ı")


def keyword_form(c: Column) -> Column:
    """case folded, letters and digits only (no combining marks)."""
    return F.regexp_replace(casefold(c), r"[^\p{L}\p{N}]+", "")


def entity_form(c: Column) -> Column:
    """without a leading code, stock-talk prefixes and one suffix, then F3."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\d{4,6}\s*", "")
    for p in ENTITY_PREFIXES:
        text = F.regexp_replace(text, f"^{p}", "")
    return keyword_form(F.regexp_replace(text, f"({'|'.join(ENTITY_SUFFIXES)})$", ""))


def theme_form(c: Column) -> Column:
    """without white space, legacy names renamed."""
    text = F.regexp_replace(c, r"\s+", "")
    return reduce(lambda acc, kv: acc.when(text == kv[0], kv[1]), THEME_ALIASES.items(), F.when(F.lit(False), "")).otherwise(text)


def industry_theme(c: Column) -> Column:
    """the first rule one of whose terms the industry contains, else other."""
    text = F.replace(F.lower(c), F.lit(" "), F.lit(""))
    out = F.when(F.lit(False), "")
    for theme, terms in INDUSTRY_RULES:
        out = out.when(text.rlike("|".join(terms)), theme)
    return out.otherwise(OTHER_THEME)


def is_company_code(c: Column) -> Column:
    """a code that is no ETF."""
    return c.rlike(LISTED_CODE) & ~c.startswith("00")


def is_bare_code(c: Column) -> Column:
    """a whole keyword that is a code and doesn't read as a year."""
    return c.rlike(LISTED_CODE) & ~c.rlike(YEAR_LIKE)


def names_match(a: Column, b: Column) -> Column:
    """F8: without corporate noise, the shorter name's characters stand in order in the longer one."""
    x, y = (F.upper(F.regexp_replace(c, COMPANY_NOISE, "")) for c in (a, b))
    short, full = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (F.length(x) > 0) & (F.length(y) > 0) & _subsequence(short, full)


def _subsequence(short: Column, full: Column) -> Column:
    """Characters are dropped from the front of ``full`` up to each character's place; failure leaves null."""
    rest = F.aggregate(
        F.filter(F.split(short, ""), lambda ch: ch != ""), full,
        lambda left, ch: F.when(F.contains(left, ch), F.substr(left, F.position(ch, left) + 1)),
    )
    return rest.isNotNull()


def taipei_day(c: Column) -> Column:
    """the Taipei calendar day of a UTC time."""
    return F.to_date(F.from_utc_timestamp(c.cast("timestamp"), "Asia/Taipei"))


def day_start_utc(c: Column) -> Column:
    """the UTC time at which a Taipei day begins."""
    return F.to_utc_timestamp(c.cast("timestamp"), "Asia/Taipei")


def local_to_utc(c: Column, zone: str) -> Column:
    """struct (utc, problem) of a wall time; ambiguous and nonexistent times have a problem and no value."""
    utc = F.to_utc_timestamp(c.cast("timestamp"), zone)
    gap = F.from_utc_timestamp(utc, zone) != c.cast("timestamp")
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, zone) == c.cast("timestamp")) | (F.from_utc_timestamp(utc - hour, zone) == c.cast("timestamp"))
    problem = F.when(gap, "nonexistent").when(twice, "ambiguous")
    return F.struct(F.when(problem.isNull(), utc).alias("utc"), problem.alias("problem"))


def strict_time(c: Column) -> Column:
    """one of two layouts by length (19 or 26), else null."""
    return F.when(F.length(c) == 19, F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))).when(F.length(c) == 26, F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sentiment_form(c: Column) -> Column:
    """one of three labels, else unanalysed."""
    text = F.initcap(F.trim(c))
    return F.when(text.isin(*SENTIMENTS), text).otherwise(UNANALYZED)


def clamp_confidence(c: Column) -> Column:
    """a number in 0..1, bad values 0."""
    number = c.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))))


def correlation_grade(r: Column, n: Column) -> Column:
    """F15."""
    a = F.abs(r)
    return F.when((n >= 90) & (a >= 0.6), "A").when((n >= 60) & (a >= 0.4), "B").when((n >= 30) & (a >= 0.3), "C")


def volatility_level(c: Column) -> Column:
    """F16."""
    return F.when(c.isNull(), None).when(c >= 1.5, "high").when(c >= 1.2, "raised").when(c > 0.8, "normal").otherwise("calm")


def breakout_label(c: Column) -> Column:
    """null N/A, 0 Day0, else the number."""
    return F.when(c.isNull(), "N/A").when(c == 0, "Day0").otherwise(c.cast("int").cast("string"))


def event_label(keyword: Column, day: Column) -> Column:
    name = F.coalesce(F.when(keyword != "", keyword), F.lit("事件"))
    return F.when(day.isNull(), name).otherwise(F.concat(name, F.lit("（"), F.date_format(day, "yyyy-MM-dd"), F.lit("）")))


def one_decimal(c: Column) -> Column:
    """``%.1f`` of the value itself, half to even: format_string rounds the shortest decimal text of a value, 0.35 up though it is less than that.

    Ten times the value is split into its rounded product and the error of
    that, which Dekker's halves give without loss.
    """
    x = F.abs(c)
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    product = x * 10
    error = (high * 10 - product) + (x - high) * 10
    tenths = F.floor(product)
    over = (product - (tenths + F.lit(0.5))) + error
    n = tenths + F.when((over > 0) | ((over == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when(x < 1e12, text).otherwise(F.format_string("%.1f", c))


def metric_text(c: Column, suffix: str) -> Column:
    return F.when(c.isNull(), "資料不足").otherwise(F.concat(one_decimal(c), F.lit(suffix)))


def coverage_text(analyzed: Column, total: Column) -> Column:
    share = F.when(total > 0, F.concat(one_decimal(analyzed / total * 100), F.lit("%"))).otherwise("N/A")
    return F.concat(F.format_number(analyzed, 0), F.lit(" / "), F.format_number(total, 0), F.lit("（"), share, F.lit("）"))


def previous_weekday(c: Column) -> Column:
    back = F.when(F.weekday(c) == 0, 3).when(F.weekday(c) == 6, 2).otherwise(1)
    return F.date_sub(c, back)


def expected_trading_day(now: Column) -> Column:
    """today from 18:30 on, else yesterday; weekends go back to Friday."""
    late = F.hour(now) * 60 + F.minute(now) >= 18 * 60 + 30
    day = F.date_sub(F.to_date(now), F.when(late, 0).otherwise(1))
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def quota_day(c: Column, reset_hour: int) -> Column:
    """the day of a time by a reset hour."""
    return F.to_date(c - F.make_interval(hours=F.lit(reset_hour)))


def effective_day(local: Column) -> Column:
    """a weekday before 13:30 counts for itself, anything later for the next day."""
    minutes = F.hour(local) * 60 + F.minute(local)
    same = (F.weekday(local) < 5) & (minutes < 13 * 60 + 30)
    return F.date_add(F.to_date(local), F.when(same, 0).otherwise(1))


def market_session(local: Column) -> Column:
    """pre, in, after market or weekend."""
    minutes = F.hour(local) * 60 + F.minute(local)
    return F.when(F.weekday(local) >= 5, "weekend").when(minutes < 9 * 60, "pre").when(minutes < 13 * 60 + 30, "in").otherwise("after")


def post_side(title: Column) -> Column:
    """F21."""
    return F.when(title.contains("空"), "short").when(title.contains("多"), "long").otherwise("other")


def target_code(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"^\[標的\]\s*(\d{4,6})", 1), F.lit(""))


def is_reply(title: Column) -> Column:
    return title.startswith("Re:") | title.startswith("Fw:")


def outcome(ten: Column, five: Column) -> Column:
    """the sign of the ten-day excess, else of the five-day one."""
    x = F.coalesce(ten, five)
    return F.when(x > 0, "up").when(x < 0, "down").otherwise("neutral")


def against_normal(excess: Column, normal: Column) -> Column:
    """better, worse or the same within one percentage point."""
    d = excess - normal
    return F.when(d > 0.01, "better").when(d < -0.01, "worse").when(d.isNotNull(), "same")


def ticker(c: Column) -> Column:
    """A Taiwan code with its exchange suffix, other codes unchanged."""
    return F.when(c.rlike(LISTED_CODE), F.concat(c, F.lit(".TW"))).otherwise(c)


def push_score(c: Column) -> Column:
    """爆 100, XX -100, X1..X9 minus tens, digits themselves, else 0."""
    return F.when(c == "爆", 100).when(c.startswith("XX"), -100).when(c.rlike(r"^X\d+$"), -10 * F.substr(c, F.lit(2)).try_cast("int")).when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(0)
