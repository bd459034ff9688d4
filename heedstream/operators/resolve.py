"""Dictionary resolution: keywords to names, companies, industries and themes.

Dictionaries are small tables that people keep; they are joined by normal
form. Only the distinct keywords that no exact form settles are compared
with every dictionary term.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedstream.functions.exprs import OTHER_THEME, clamp_confidence, entity_form, industry_theme, is_bare_code, keyword_form, names_match, theme_form
from heedstream.sources.shared import stage

ENTITY_KINDS_WITH_CODE = ("上市公司", "ETF")
AMBIGUOUS_WORDS = ("創意", "全新")
THRESHOLD = 88
#: Dictionary terms that one pass holds in a task.
DICTIONARY_BLOCK = 50_000

#: The theme of companies that a rule recognises as technology.
TECH_THEME = "科技類"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|)."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def window_likeness(a: str, b: str) -> float:
    """Best likeness of the shorter text and any stretch of the longer one of at most its length."""
    short, full = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0
    best = 0.0
    for start in range(1 - n, len(full)):
        best = max(best, likeness(short, full[max(0, start) : start + n]))
        if best == 100.0:
            break
    return best


def _cut(n: int, threshold: int) -> int:
    """Into how many pieces a form of n characters is cut: one more than the characters that can differ at this likeness."""
    return int(n * (200 / threshold - 2)) + 1


def _grams(form: Column, sizes: list[int]) -> Column:
    """The distinct stretches of a text of the given lengths."""

    def of(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(form) - size + 1), lambda i: F.substr(form, i, F.lit(size)))
        return F.when(F.length(form) >= size, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def _pieces(form: Column, threshold: int) -> Column:
    """A form in pieces of nearly equal length, of which any text that is like it holds at least one unchanged."""
    n = F.length(form)
    m = F.floor(n * F.lit(200 / threshold - 2)).cast("int") + 1
    at = lambda k: (n * k / m).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.substr(form, at(k) + 1, at(k + 1) - at(k))))


def _stretches(form: Column, sizes: Column) -> Column:
    """The distinct stretches of a text that have one of the given lengths."""
    n = F.length(form)
    fit = F.filter(sizes, lambda k: (k >= 3) & (k <= n))
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(form, i, k)))))


def fuzzy_match(keywords: DataFrame, dictionary: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Keywords (keyword) to (keyword, canonical, type, stock_ids, score); dictionary (ordinal, keyword, type, stock_id).

    The first exact normal form scores 100. Others of three letters or more
    take the best of whole and window likeness, ties to the longer term and
    then the earlier row. Unmatched keywords come back trimmed with a null type
    and score 0: likeness under the threshold isn't worked out. An empty normal
    form is like none. Stocks stand in the dictionary's order.

    Only candidates are compared. At the threshold the shorter of two forms and
    what it is like in the longer one differ by fewer inserted or deleted
    characters than the shorter one has pieces, so one piece stands unchanged
    in the longer form: an equi-join of pieces with stretches of text.
    Where one form holds the other whole, the likeness is 100 and no other term can win: these
    pairs come from equi-joins of whole forms, and their keywords are compared with nothing else.
    Numbered names share pieces of digits by the thousand. With all digits made alike two forms are at
    least as like as they are, so the few distinct patterns of forms are compared first, and forms
    only with those of patterns that reach the threshold.
    Pieces and stretches are many times their table, which a plan's estimate doesn't see: they
    are merged, so that none are gathered for a broadcast. Of stretches only those of a length that the other side has are made.
    """
    terms = dictionary.groupBy(F.col("keyword").alias("term"), "type").agg(F.min("ordinal").alias("ordinal")).withColumn("term_form", keyword_form(F.col("term"))).where("term_form <> ''")
    asked = keywords.select("keyword").distinct().withColumn("form", keyword_form(F.col("keyword")))
    first = terms.groupBy("term_form").agg(F.min_by(F.struct("term", "type"), "ordinal").alias("hit"))
    exact = asked.join(first.withColumnRenamed("term_form", "form"), "form", "left").select("keyword", "form", "hit.term", "hit.type", F.when(F.col("hit").isNotNull(), 100).alias("score"))
    exact = stage(exact, "exact")
    rest = exact.where("score is null and length(form) >= 3").select("keyword", "form")
    known = terms.where("length(term_form) >= 3")
    lengths = lambda df, c: F.broadcast(df.agg(F.collect_set(F.length(c)).alias("_sizes")))
    within = rest.crossJoin(lengths(known, "term_form")).withColumn("term_form", F.explode(_stretches(F.col("form"), F.col("_sizes")))).hint("merge").join(known, "term_form")
    around = known.crossJoin(lengths(rest, "form")).withColumn("form", F.explode(_stretches(F.col("term_form"), F.col("_sizes")))).hint("merge").join(rest, "form")
    columns = ["keyword", "form", "term", "type", "ordinal", "term_form"]
    whole = within.select(*columns).union(around.select(*columns))
    whole = stage(whole.groupBy("keyword").agg(F.max_by(F.struct("form", "term", "type", "ordinal", "term_form"), F.struct(F.length("term_form"), -F.col("ordinal"))).alias("n")).select("keyword", "n.*", F.lit(100.0).alias("exact")), "whole")
    rest = rest.join(whole.select("keyword").hint("merge"), "keyword", "left_anti")
    # a term of two letters is like none of three at more than 80
    least = 3 if threshold > 80 else 1
    sizes = sorted({size for n in range(least, 400) for m in [_cut(n, threshold)] for size in (n // m, -(-n // m)) if size})

    def meet(asked: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
        shorter = asked.withColumn("piece", F.explode(_pieces(F.col("form"), threshold))).hint("merge").join(held.withColumn("piece", F.explode(_grams(F.col("term_form"), sizes))), ["piece", *on]).where("length(form) <= length(term_form)")
        longer = asked.withColumn("piece", F.explode(_grams(F.col("form"), sizes))).hint("merge").join(held.where(F.length("term_form") >= least).withColumn("piece", F.explode(_pieces(F.col("term_form"), threshold))), ["piece", *on]).where("length(form) > length(term_form)")
        return shorter.union(longer).drop("piece", *on).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["exact"] = [max(likeness(a, b), window_likeness(a, b) if len(b) >= 3 else 0.0) for a, b in zip(pdf["form"], pdf["term_form"], strict=True)]
            yield pdf[pdf["exact"].astype(int) >= threshold]

    pattern = lambda c: F.regexp_replace(c, r"\p{Nd}", "0")
    alike = meet(rest.select(pattern("form").alias("form")).distinct(), terms.select(pattern("term_form").alias("term_form")).distinct(), [])
    alike = stage(alike.select("form", "term_form").mapInPandas(run, "form string, term_form string, exact double").select(F.col("form").alias("_own"), F.col("term_form").alias("_pattern")), "alike")
    asked_for = rest.withColumn("_own", pattern("form")).join(alike, "_own").drop("_own")
    near = meet(asked_for, terms.withColumn("_pattern", pattern("term_form")), ["_pattern"]).select(*columns)
    scored = near.mapInPandas(run, "keyword string, form string, term string, type string, ordinal long, term_form string, exact double").unionByName(whole)
    best = scored.groupBy("keyword").agg(F.max_by(F.struct("term", "type", F.col("exact").cast("int").alias("score")), F.struct("exact", F.length("term_form"), (-F.col("ordinal")).alias("o"))).alias("n"))
    out = exact.join(best, "keyword", "left").select("keyword", F.coalesce("term", "n.term").alias("term"), F.coalesce("type", "n.type").alias("type"), F.coalesce("score", "n.score", F.lit(0)).cast("int").alias("score"))
    stocks = dictionary.where("stock_id <> ''").groupBy(F.col("keyword").alias("term"), "type", "stock_id").agg(F.min("ordinal").alias("o"))
    stocks = stocks.groupBy("term", "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "stock_id"))), lambda x: x["stock_id"]).alias("stock_ids"))
    out = out.join(stocks, ["term", "type"], "left")
    return out.select("keyword", F.coalesce("term", F.trim("keyword")).alias("canonical"), "type", F.coalesce("stock_ids", F.array().cast("array<string>")).alias("stock_ids"), "score")


def known_companies(aliases: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row for each entity form: seeds first, then company aliases with their stock's shortest name and industry.

    ``aliases`` has (ordinal, keyword, type, stock_id), ``seeds`` (ordinal,
    alias, entity_name, entity_type, stock_id, industry, theme_name); the later seed alias wins.
    """
    seed = seeds.withColumn("form", entity_form(F.col("alias"))).where("form <> ''").groupBy("form").agg(F.max_by(F.struct("entity_name", "entity_type", "stock_id", "industry", "theme_name"), "ordinal").alias("s"))
    by_rule = industry_theme(F.coalesce("s.industry", F.lit("")))
    seed = seed.select("form", F.col("s.entity_name").alias("canonical"), F.col("s.entity_type").alias("entity_type"), F.col("s.stock_id").alias("stock_id"), F.col("s.industry").alias("industry"), F.when(by_rule != OTHER_THEME, by_rule).otherwise(theme_form(F.coalesce("s.theme_name", F.lit(OTHER_THEME)))).alias("theme_name"), F.lit("seed").alias("source"))
    company = aliases.where("type = 'company'").withColumn("form", entity_form(F.col("keyword")))
    foreign = F.col("keyword").rlike(r"[^\x00-\x7F]") & ~F.col("keyword").rlike("股價|妖股|掃描器")
    shortest = lambda when: F.min_by(F.when(when, F.col("keyword")), F.when(when, F.struct(F.length("keyword"), "ordinal")))
    names = company.groupBy("stock_id").agg(F.coalesce(shortest(foreign), shortest(F.lit(True))).alias("canonical"))
    industry = aliases.where("type = 'industry'").groupBy("stock_id").agg(F.min_by("keyword", F.struct(F.length("keyword"), "ordinal")).alias("industry"))
    known = company.groupBy("form").agg(F.max_by("stock_id", "ordinal").alias("stock_id")).join(names, "stock_id").join(industry, "stock_id", "left")
    etf = F.col("stock_id").startswith("00")
    label = F.when(etf, "ETF").otherwise(F.coalesce("industry", F.lit("")))
    known = known.select("form", "canonical", F.when(etf, "ETF").otherwise("上市公司").alias("entity_type"), "stock_id", label.alias("industry"), F.when(etf, "金融類").otherwise(industry_theme(F.coalesce("industry", F.lit("")))).alias("theme_name"), F.lit("alias").alias("source"))
    return seed.unionByName(known.join(seed.select("form"), "form", "left_anti"))


def resolve(keywords: DataFrame, known: DataFrame, official: DataFrame, industries: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Seed and alias, then the official code, then the industry, then a gated prediction; source null is unresolved."""
    asked = keywords.select("keyword").distinct().withColumn("form", entity_form(F.col("keyword"))).withColumn("code", F.upper(F.trim("keyword")))
    struct = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("canonical", "entity_type", "stock_id", "industry", "theme_name", "source", "confidence_score"), strict=True)])
    k = known.select("form", struct(*[F.col(c) for c in ("canonical", "entity_type", "stock_id", "industry", "theme_name", "source")], F.lit(1.0)).alias("a"))
    etf = F.col("code").startswith("00")
    o = official.select(F.col("stock_id").alias("code"), "name")
    i = industries.select(entity_form(F.col("keyword")).alias("form"), F.col("keyword").alias("industry")).groupBy("form").agg(F.min("industry").alias("industry"))
    out = asked.join(k, "form", "left").join(o, "code", "left").join(i, "form", "left")
    by_code = F.when(is_bare_code(F.col("code")) & F.col("name").isNotNull(), struct(F.col("name"), F.when(etf, "ETF").otherwise("上市公司"), F.col("code"), F.when(etf, "ETF").otherwise(""), F.when(etf, "金融類").otherwise(OTHER_THEME), F.lit("code"), F.lit(1.0)))
    by_industry = F.when(F.col("industry").isNotNull(), struct(F.col("industry"), F.lit("產業"), F.lit(""), F.col("industry"), industry_theme(F.col("industry")), F.lit("industry"), F.lit(0.95)))
    found = [F.col("a"), by_code, by_industry]
    if predictions is not None:
        p = predictions.select("keyword", struct(*[F.col(c) for c in ("canonical", "entity_type", "stock_id", "industry", "theme_name")], F.lit("prediction"), F.col("confidence_score")).alias("p"))
        out = out.join(p, "keyword", "left")
        found.append(F.col("p"))
    return out.select("keyword", F.coalesce(*found).alias("r")).select("keyword", "r.*")


def gate_predictions(predictions: DataFrame, official: DataFrame, kinds: list[str], themes: list[str], least: float = 0.6) -> DataFrame:
    """Predictions that may be used: a known kind and a name, enough confidence, a code where one is due that isn't another company's."""
    kind, name = F.trim(F.coalesce("entity_type", F.lit(OTHER_THEME))), F.trim(F.coalesce("canonical_entity", F.lit("")))
    coded = kind.isin(*ENTITY_KINDS_WITH_CODE)
    code = F.upper(F.trim(F.coalesce("stock_id", F.lit(""))))
    proposed = theme_form(F.coalesce("theme_name", F.lit(OTHER_THEME)))
    industry = F.trim(F.coalesce("industry", F.lit("")))
    rows = predictions.select(
        "keyword", name.alias("canonical"), kind.alias("entity_type"), F.when(coded, code).otherwise("").alias("stock_id"), F.substr(industry, F.lit(1), F.lit(100)).alias("industry"),
        F.when(kind == "ETF", "金融類").when(coded, industry_theme(industry)).when(proposed.isin(*themes), proposed).otherwise(OTHER_THEME).alias("theme_name"), clamp_confidence(F.col("confidence_score")).alias("confidence_score"),
    )
    rows = rows.where(F.col("entity_type").isin(*kinds) & (F.col("canonical") != "") & (F.col("confidence_score") >= least) & (~F.col("entity_type").isin(*ENTITY_KINDS_WITH_CODE) | F.col("stock_id").rlike(r"^\d{4,6}[A-Z]?$")))
    rows = rows.where(~(entity_form(F.col("keyword")).isin(*AMBIGUOUS_WORDS) & F.col("entity_type").isin(*ENTITY_KINDS_WITH_CODE)))
    met = rows.join(official.select("stock_id", F.col("name").alias("_official")), "stock_id", "left")
    return met.where(F.col("_official").isNull() | names_match(F.col("canonical"), F.col("_official"))).drop("_official").select("keyword", "canonical", "entity_type", "stock_id", "industry", "theme_name", "confidence_score")


def entity_save(resolved: DataFrame, links: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved keywords to entity rows, classification rows, and links as they stand afterwards.

    A company (or fund) becomes a direct link of its canonical name to its
    stock; links under the other theme of the keyword, and of the canonical names
    that ``classified`` has for it so far, are switched off first. Keywords that aren't
    companies stay under the other theme as fallbacks. Of several keywords of one entity the last one's values count.
    """
    rows = resolved.where("source is not null").withColumn("_company", F.col("entity_type").isin(*ENTITY_KINDS_WITH_CODE))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    entities = rows.groupBy(F.col("canonical").alias("entity_name")).agg(F.max_by(F.struct("entity_type", blank("stock_id"), blank("industry"), blank("theme_name"), "confidence_score", "source"), "keyword").alias("r")).select("entity_name", "r.*")
    industry = F.nullif(F.col("industry"), F.lit(""))
    classes = rows.select(
        "keyword", F.col("canonical").alias("canonical_keyword"), "entity_type", F.when(F.col("_company"), F.col("theme_name")).otherwise(OTHER_THEME).alias("theme_name"), F.coalesce(industry, F.lit("未分類")).alias("sub_theme"),
        F.col("_company").cast("int").alias("stock_related"), "confidence_score", F.when(F.col("_company"), "entity_resolution").otherwise("fallback").alias("source"), (F.col("confidence_score") < 0.85).cast("int").alias("need_review"))
    company = rows.where("_company")
    direct = company.select("theme_name", F.col("canonical").alias("keyword"), "stock_id", F.coalesce(industry, F.lit("公司與股票")).alias("sub_theme"), F.lit("direct").alias("link_type"), F.lit(1).alias("active"))
    earlier = classified.join(company.select("keyword").distinct(), "keyword", "left_semi").select(F.col("canonical_keyword").alias("keyword"))
    gone = company.select("keyword").union(earlier).where("keyword is not null").distinct().withColumn("_gone", F.lit(True))
    off = F.col("_gone") & (F.col("theme_name") == OTHER_THEME)
    kept = links.join(gone, "keyword", "left").withColumn("active", F.when(off, 0).otherwise(F.col("active"))).select(*links.columns)
    key = ["theme_name", "keyword", "stock_id"]
    made = direct.groupBy(*key).agg(F.max(F.struct("sub_theme", "link_type", "active")).alias("r")).select(*key, "r.*")
    after = kept.join(made.select(*key), key, "left_anti").unionByName(made.select(*[c for c in made.columns if c in links.columns]), allowMissingColumns=True)
    return entities, classes, after


def rule_classify(keywords: DataFrame, themes: DataFrame, companies: DataFrame, members: DataFrame) -> DataFrame:
    """Exact theme keyword, else a fuzzy company, else the longest theme keyword inside, else fallback.

    ``themes`` has (ordinal, keyword, theme_name, sub_theme, stock_id), ``companies`` is a dictionary as in ``fuzzy_match``.
    A company goes by the shortest name with other than ASCII characters among all names of
    its stocks (the shortest of all where there is none, the earlier of equals),
    and is of the technology theme if its first stock is one of ``members`` (stock_id).
    """
    asked = keywords.select("keyword").distinct().withColumn("form", keyword_form(F.col("keyword")))
    terms = themes.withColumn("form", keyword_form(F.col("keyword")))
    first = terms.groupBy("form").agg(F.min_by(F.struct(F.col("keyword").alias("term"), "theme_name", "sub_theme", "stock_id"), "ordinal").alias("e"))
    step = stage(asked.join(first, "form", "left"), "asked")
    company = fuzzy_match(step.where("e is null").select("keyword"), companies).where("type = 'company' and size(stock_ids) > 0").select("keyword", "stock_ids")
    names = companies.where("type = 'company'").groupBy("stock_id", F.col("keyword").alias("name")).agg(F.min("ordinal").alias("o"))
    tech = members.select("stock_id", F.lit(True).alias("_tech")).distinct()
    each = company.select("keyword", "stock_ids", F.posexplode("stock_ids").alias("_k", "stock_id")).join(names, "stock_id").join(tech, "stock_id", "left")
    order = F.struct((~F.col("name").rlike(r"[^\x00-\x7F]")).alias("ascii"), F.length("name"), "o")
    company = each.groupBy("keyword").agg(F.struct(F.min_by("name", order).alias("canonical"), F.first("stock_ids").alias("stock_ids"), F.coalesce(F.bool_or((F.col("_k") == 0) & F.col("_tech")), F.lit(False)).alias("tech")).alias("c"))
    step = step.join(company, "keyword", "left")
    # what stands inside a keyword is one of its stretches of a term's length: an equi-join, whose lengths are few
    sizes = sorted(r["n"] for r in first.select(F.length("form").alias("n")).where("n > 1").distinct().collect())
    whole = step.where("e is null and c is null").select("keyword", F.explode(_grams(F.col("form"), sizes) if sizes else F.array().cast("array<string>")).alias("form"))
    inside = whole.join(first, "form").join(terms.groupBy("form").agg(F.min("ordinal").alias("o")), "form").groupBy("keyword").agg(F.max_by("e", F.struct(F.length("form"), (-F.col("o")).alias("o"))).alias("i"))
    step = step.join(inside, "keyword", "left")
    source = F.when(F.col("e").isNotNull(), "theme_mapping").when(F.col("c").isNotNull() | F.col("i").isNotNull(), "mapping_normalizer").otherwise("fallback")
    link = F.when(F.col("e").isNotNull(), F.when(F.col("e.stock_id") != "", "industry").otherwise("none")).when(F.col("c").isNotNull(), "company").when(F.col("i").isNotNull(), "industry").otherwise("none")
    return step.select(
        "keyword", F.coalesce("e.term", "c.canonical", "i.term", F.trim("keyword")).alias("canonical_keyword"), F.coalesce("e.theme_name", F.when(F.col("c").isNotNull(), F.when(F.col("c.tech"), TECH_THEME).otherwise(OTHER_THEME)), "i.theme_name", F.lit(OTHER_THEME)).alias("theme_name"),
        F.coalesce("e.sub_theme", F.when(F.col("c").isNotNull(), "公司與股票"), "i.sub_theme", F.lit("未分類")).alias("sub_theme"), link.alias("link_type"),
        F.when(F.col("e").isNotNull(), 1.0).when(F.col("c").isNotNull(), 0.7).when(F.col("i").isNotNull(), 0.5).otherwise(0.0).alias("confidence_score"), source.alias("classification_source"),
        F.coalesce("c.stock_ids", F.array().cast("array<string>")).alias("stock_ids"),
    )


def basket(themes: DataFrame) -> DataFrame:
    """Distinct active stocks of a theme in file order."""
    rows = themes.where("active = 1 and stock_id <> ''").groupBy("theme_name", "stock_id").agg(F.min("ordinal").alias("o"))
    return rows.groupBy("theme_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "stock_id"))), lambda x: x["stock_id"]).alias("stock_ids"))


def definitions(themes: DataFrame, legacy: DataFrame) -> DataFrame:
    """Keyword and stock lists of each theme, legacy lists (theme_name, keywords, stock_ids) merged in."""
    own = themes.where("active = 1").groupBy("theme_name").agg(F.collect_set("keyword").alias("k"), F.collect_set(F.nullif("stock_id", F.lit(""))).alias("s"))
    none = F.array().cast("array<string>")
    both = own.join(legacy, "theme_name", "full")
    return both.select("theme_name", F.sort_array(F.array_union(F.coalesce("k", none), F.coalesce("keywords", none))).alias("keywords"), F.sort_array(F.array_union(F.coalesce("s", none), F.coalesce("stock_ids", none))).alias("stock_ids"))


def generate_links(classified: DataFrame, company_stocks: DataFrame, baskets: DataFrame) -> DataFrame:
    """Classified keywords (keyword, theme_name, link_type) to link rows: own stocks, the theme's basket, or none."""
    met = classified.join(company_stocks, "keyword", "left").join(baskets.withColumnRenamed("stock_ids", "basket"), "theme_name", "left")
    stocks = F.when(F.col("link_type") == "company", F.col("stock_ids")).when(F.col("link_type") == "industry", F.col("basket"))
    out = met.select("keyword", "theme_name", "link_type", F.explode_outer(stocks).alias("stock_id"))
    return out.select("keyword", "theme_name", "stock_id", F.when(F.col("stock_id").isNull(), None).when(F.col("link_type") == "company", "direct").otherwise("theme").alias("link_type"), F.lit(1).alias("active"))


def retire_fallbacks(links: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Links that a fallback class made are switched off once its keyword has been classified anew.

    ``before`` are the classes that stood (keyword, canonical_keyword,
    theme_name, source), ``now`` the keywords that have new ones.
    """
    was = before.where((F.col("source") == "fallback") & (F.col("theme_name") == OTHER_THEME)).join(now.select("keyword").distinct(), "keyword", "left_semi")
    gone = was.select(F.coalesce("canonical_keyword", "keyword").alias("keyword"), F.lit(OTHER_THEME).alias("theme_name"), F.lit(True).alias("_gone")).distinct()
    return links.join(gone, ["keyword", "theme_name"], "left").withColumn("active", F.when(F.col("_gone"), 0).otherwise(F.col("active"))).select(*links.columns)


def pending(bursts: DataFrame, classified: DataFrame, limit: int | None = None) -> DataFrame:
    """Keywords without a class or with only the other theme, most frequent first."""
    done = classified.where(F.coalesce("theme_name", F.lit(OTHER_THEME)) != OTHER_THEME).select("keyword").distinct()
    rows = bursts.where("trim(keyword) <> ''").join(done, "keyword", "left_anti").groupBy("keyword").agg(F.count_distinct("burst_id").alias("bursts"))
    rows = rows.orderBy(F.col("bursts").desc(), "keyword")
    return rows.limit(limit) if limit else rows


def pending_entities(bursts: DataFrame, classified: DataFrame, known: DataFrame, answered: DataFrame) -> DataFrame:
    """Keywords under the other theme or without a class that neither a rule (``known``) settles nor a model has answered."""
    done = classified.where(F.coalesce("theme_name", F.lit(OTHER_THEME)) != OTHER_THEME).select("keyword")
    rows = bursts.where("trim(keyword) <> ''").select("keyword").distinct()
    for other in (done, known.select("keyword"), answered.select("keyword")):
        rows = rows.join(other.distinct(), "keyword", "left_anti")
    return rows


def pending_fallbacks(bursts: DataFrame, classified: DataFrame, answered: DataFrame) -> DataFrame:
    """Keywords without a class or with a fallback one under the other theme, less those that a model has answered."""
    settled = classified.where(~((F.col("source") == "fallback") & (F.coalesce("theme_name", F.lit(OTHER_THEME)) == OTHER_THEME))).select("keyword")
    rows = bursts.where("keyword is not null").select("keyword").distinct()
    return rows.join(settled.distinct(), "keyword", "left_anti").join(answered.select("keyword").distinct(), "keyword", "left_anti")


def pending_news(news: DataFrame, limit: int | None = None) -> DataFrame:
    """Titled news that lack sentiment, score or type, in the order of their ids."""
    lacks = F.col("news_sentiment").isNull() | F.col("sentiment_score").isNull() | F.col("event_type").isNull()
    rows = news.where(F.col("news_title").isNotNull() & lacks).select("news_id", "news_title", "news_source")
    return rows.orderBy("news_id").limit(limit) if limit else rows


def news_rolldown(news: DataFrame, bursts: DataFrame, classified: DataFrame, done: DataFrame) -> DataFrame:
    """Each news not done yet under its keyword's theme; no class is the other theme, no sentiment is neutral."""
    rows = news.join(done.select("news_id"), "news_id", "left_anti").join(bursts.select("burst_id", "keyword"), "burst_id").join(classified.select("keyword", "theme_name", "confidence_score"), "keyword", "left")
    return rows.select("news_id", "keyword", F.coalesce("theme_name", F.lit(OTHER_THEME)).alias("theme_name"), F.coalesce("news_sentiment", F.lit("Neutral")).alias("sentiment"), clamp_confidence(F.col("confidence_score")).alias("confidence"))


def match_canonical(observations: DataFrame, names: DataFrame) -> DataFrame:
    """Observations whose canonical or raw keyword is named, under the name that matched."""
    c = names.select(F.col("keyword").alias("canonical"), F.lit(True).alias("_c"))
    r = names.select("keyword", F.lit(True).alias("_r"))
    met = observations.join(c, "canonical", "left").join(r, "keyword", "left").where("_c or _r")
    return met.withColumn("matched", F.when(F.col("_c"), F.col("canonical")).otherwise(F.col("keyword"))).drop("_c", "_r")


def mentions(texts: DataFrame, aliases: DataFrame, block: int = DICTIONARY_BLOCK) -> DataFrame:
    """Texts (id, text) to one row for each stock they name; codes count between non-digits only.

    Names are found from left to right, the longest first where several
    begin; what a found name covers begins no other. ``aliases`` (alias,
    stock_id) may be of any size: an automaton holds ``block`` names, each
    block reads the texts once, and the places of all blocks meet again by text.
    """
    names = aliases.select("alias").where("alias <> ''").distinct()
    blocks = max(1, -(-names.count() // block))
    rows = texts.select("id", "text", F.xxhash64("id", "text").alias("row")).where("text is not null")
    hits = None
    for k in range(blocks):
        own = [r["alias"] for r in names.where(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == k).collect()]
        part = rows.mapInPandas(_alias_places(own), f"row long, id {dict(texts.dtypes)['id']}, places array<struct<start:int,size:int,alias:string>>")
        hits = part if hits is None else hits.unionByName(part)
    if blocks > 1:
        hits = hits.groupBy("row", "id").agg(F.flatten(F.collect_list("places")).alias("places"))
    order = F.array_sort("places", lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["size"] - x["size"]))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("found"))
    taken = F.aggregate(order, empty, lambda a, p: F.when(p["start"] >= a["end"], F.struct((p["start"] + p["size"]).alias("end"), F.array_union(a["found"], F.array(p["alias"])).alias("found"))).otherwise(a))["found"]
    found = hits.select("id", F.explode(taken).alias("alias"))
    return found.join(aliases.select("alias", "stock_id").distinct(), "alias").select("id", "stock_id").distinct()


def _alias_places(names: list[str]):  # noqa: ANN202
    """Texts to the places of names, the longest for each start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        if names:
            automaton.make_automaton()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                best: dict[int, str] = {}
                for end, name in automaton.iter(text) if names else ():
                    start = end + 1 - len(name)
                    if name.isdigit() and (text[start - 1 : start].isdigit() or text[end + 1 : end + 2].isdigit()):
                        continue
                    if len(name) > len(best.get(start, "")):
                        best[start] = name
                out.append([{"start": a, "size": len(n), "alias": n} for a, n in sorted(best.items())])
            pdf["places"] = out
            yield pdf.loc[pdf["places"].str.len() > 0, ["row", "id", "places"]]

    return run


def plan_link_types(links: DataFrame, curated: DataFrame, entities: DataFrame, retired: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is to change: link rows (id, action) and the keywords to classify anew.

    Active links (id, theme_name, keyword, stock_id, active) with a stock are
    typed ``theme`` where their (theme, keyword, stock) is curated, else ``direct`` where (keyword, stock) is an
    entity's and the keyword isn't ``retired``, and are deactivated otherwise. Other links stay as they are.
    Keywords that lose their last link are requeued, by their own or their canonical name.
    """
    rows = links.where("active = 1 and coalesce(stock_id, '') <> ''").select("id", "theme_name", "keyword", "stock_id")
    c = curated.where("coalesce(stock_id, '') <> ''").select("theme_name", "keyword", "stock_id", F.lit(True).alias("_c")).distinct()
    e = entities.where("coalesce(stock_id, '') <> ''").select(F.col("entity_name").alias("keyword"), "stock_id").distinct().join(retired.select("keyword"), "keyword", "left_anti").withColumn("_e", F.lit(True))
    met = rows.join(c, ["theme_name", "keyword", "stock_id"], "left").join(e, ["keyword", "stock_id"], "left")
    actions = met.select("id", "keyword", F.when(F.col("_c"), "theme").when(F.col("_e"), "direct").otherwise("deactivate").alias("action"))
    lost = actions.groupBy("keyword").agg(F.bool_and(F.col("action") == "deactivate").alias("lost")).where("lost").select(F.col("keyword").alias("_k"))
    either = F.explode(F.array_distinct(F.array("keyword", F.coalesce("canonical_keyword", "keyword"))))
    requeue = classified.select("keyword", either.alias("_k")).join(lost, "_k", "left_semi").select("keyword").distinct()
    return actions, requeue


def link_type_summary(actions: DataFrame, requeue: DataFrame, sample: int = 20) -> DataFrame:
    """The plan's counts in one row, with the first keywords that lose their links."""
    by = actions.groupBy("keyword").agg(F.bool_or(F.col("action") != "deactivate").alias("kept"))
    least = by.where("not kept").select("keyword").orderBy("keyword").limit(sample).agg(F.array_sort(F.collect_list("keyword")).alias("unlinked_sample"))
    count = lambda name: F.count_if(F.col("action") == name)
    rows = actions.agg(F.count("*").alias("active_stock_rows"), count("theme").alias("theme_rows"), count("direct").alias("direct_rows"), count("deactivate").alias("deactivated_rows"))
    names = by.agg(F.count("*").alias("keywords_linked_before"), F.count_if("kept").alias("keywords_linked_after"), F.count_if(~F.col("kept")).alias("keywords_unlinked"))
    return rows.crossJoin(names).crossJoin(requeue.agg(F.count("*").alias("classifications_requeued"))).crossJoin(least)


def apply_link_types(links: DataFrame, actions: DataFrame) -> DataFrame:
    """Links with the plan's types; what is deactivated keeps its type."""
    met = links.join(actions.select("id", "action"), "id", "left")
    typed = F.when(F.col("action").isin("theme", "direct"), F.col("action")).otherwise(F.col("link_type"))
    return met.withColumn("link_type", typed).withColumn("active", F.when(F.col("action") == "deactivate", 0).otherwise(F.col("active"))).select(*links.columns)


def apply_requeue(classified: DataFrame, requeue: DataFrame) -> DataFrame:
    """Requeued keywords become fallbacks under the other theme; other columns stay."""
    hit = F.col("_q")
    new = {"theme_name": F.lit(OTHER_THEME), "sub_theme": F.lit("未分類"), "stock_related": F.lit(0), "source": F.lit("fallback"), "confidence_score": F.lit(0.0)}
    met = classified.join(requeue.select("keyword", F.lit(True).alias("_q")), "keyword", "left")
    return met.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in classified.columns])


def verify_link_types(after: DataFrame, actions: DataFrame) -> DataFrame:
    """What the applied plan failed to do (check, expected, found); no rows are success."""
    live = after.where("active = 1")
    untyped = live.where("coalesce(stock_id, '') <> '' and link_type is null").agg(F.lit("untyped").alias("check"), F.lit(0).cast("long").alias("expected"), F.count("*").alias("found"))
    want = actions.agg(F.count_if(F.col("action") != "deactivate").alias("expected"))
    typed = live.where("link_type in ('theme', 'direct')").agg(F.count("*").alias("found")).crossJoin(want).select(F.lit("typed"), "expected", "found")
    return untyped.union(typed).where("expected <> found")


def nearest_pairs(events: DataFrame, others: DataFrame, days: int = 7) -> DataFrame:
    """Events (stock_id, date) to the nearest date of the other signal within ``days``; ties go to the earlier date.

    The range join is an equi-join on blocks of ``days``: each event looks into its own block and both neighbours.
    """
    e = events.select("stock_id", F.col("date").alias("event")).withColumn("_b", F.explode(F.array(*[F.floor(F.unix_date("event") / days) + k for k in (-1, 0, 1)])))
    o = others.select("stock_id", F.col("date").alias("other"), F.floor(F.unix_date("date") / days).alias("_b"))
    lag = F.datediff("other", "event")
    return e.join(o, ["stock_id", "_b"]).where(F.abs(lag) <= days).groupBy("stock_id", "event").agg(F.min_by(lag, F.struct(F.abs(lag), F.col("other"))).alias("lag"))


def lead_lag(pairs: DataFrame) -> DataFrame:
    """How many pairs, the shares of other signals before, on and after the event's day, and the median lag in days."""
    share = lambda when: F.avg(when.cast("double"))
    lag = F.col("lag")
    return pairs.agg(F.count("*").alias("pairs"), share(lag < 0).alias("earlier"), share(lag == 0).alias("same_day"), share(lag > 0).alias("later"), F.median("lag").alias("median_lag"))


def display_names(links: DataFrame, official: DataFrame) -> DataFrame:
    """The shortest direct keyword of a stock; the official name goes before it."""
    short = links.where("link_type = 'direct'").groupBy("stock_id").agg(F.min_by("keyword", F.struct(F.length("keyword"), "keyword")).alias("short"))
    return short.join(official, "stock_id", "full").select("stock_id", F.coalesce("name", "short").alias("name"))


def canonical(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """J22."""
    return rows.join(classified.select("keyword", "canonical_keyword"), "keyword", "left").withColumn("keyword", F.coalesce("canonical_keyword", "keyword")).drop("canonical_keyword")
