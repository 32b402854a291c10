"""Lexicon sentiment and relevance of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P

NORMALIZER = 15.0  # fixed value of the published compound normalization s / sqrt(s^2 + 15)
LEGAL = r"\b(inc|corp|corporation|co|ltd|plc|llc|nv|sa|ag|holdings|group|the)\b\.?"  # fixed value

# --- fixed values: finance valences, overriding a general lexicon ---
FINANCE_WORDS = {
    "beat": 2.4, "beats": 2.4, "beating": 2.2,
    "miss": -2.4, "misses": -2.4, "missed": -2.4, "missing": -2.2,
    "tops": 2.3, "topped": 2.3, "exceeds": 2.3, "exceeded": 2.3,
    "crushes": 2.8, "crushed": 2.4, "smashes": 2.8,
    "outperform": 2.2, "outperforms": 2.2, "outperformed": 2.2,
    "underperform": -2.2, "underperforms": -2.2, "underperformed": -2.2,
    "shortfall": -2.2, "disappoints": -2.4, "disappointing": -2.2,
    "surges": 2.8, "surge": 2.6, "soars": 3.0, "soar": 2.8,
    "rallies": 2.4, "rally": 2.2, "jumps": 2.2, "climbs": 1.8,
    "rebounds": 2.0, "gains": 1.8, "rises": 1.6, "advances": 1.5,
    "plunges": -3.0, "plunge": -3.0, "plummets": -3.0,
    "tumbles": -2.6, "slumps": -2.6, "sinks": -2.4, "slides": -2.2,
    "falls": -2.0, "fall": -1.8, "drops": -2.0, "declines": -1.8,
    "slips": -1.6, "retreats": -1.6, "sinking": -2.4,
    "upgrade": 2.5, "upgrades": 2.5, "upgraded": 2.5,
    "downgrade": -2.5, "downgrades": -2.5, "downgraded": -2.5,
    "raises": 2.0, "raised": 1.8, "hikes": 1.8, "boosts": 2.0,
    "lowers": -2.0, "lowered": -1.8, "slashes": -2.6, "slashed": -2.6,
    "warns": -2.4, "warning": -2.2, "cautions": -1.8,
    "cuts": -2.2, "cut": -1.8,
    "bankruptcy": -3.8, "insolvency": -3.8, "default": -3.2,
    "delisting": -3.0, "delisted": -3.0, "fraud": -3.6,
    "probe": -2.2, "investigation": -2.0, "lawsuit": -2.2, "sued": -2.2,
    "recall": -2.4, "halted": -2.2, "suspension": -2.2,
    "layoffs": -2.0, "restructuring": -1.4, "writedown": -2.4,
    "impairment": -2.2, "downturn": -2.2,
    "fine": -2.0, "fined": -2.4, "penalty": -2.2, "penalties": -2.2,
    "settlement": -1.0, "breach": -2.4,
    "dividend": 1.6, "buyback": 2.0, "buybacks": 2.0,
    "acquisition": 1.0, "approval": 2.2, "approved": 2.0,
    "wins": 2.2, "awarded": 2.0, "expansion": 1.6, "record": 1.8,
    "profitable": 2.4, "profit": 1.8, "profits": 1.8, "guidance": 0.0,
    "debt": 0.0, "debts": 0.0, "liability": 0.0, "liabilities": 0.0,
    "risk": 0.0, "risks": 0.0, "risky": -0.8, "exposure": 0.0,
    "leverage": 0.0, "leveraged": 0.0, "short": 0.0, "shorts": 0.0,
    "volatility": 0.0, "volatile": -0.5, "derivative": 0.0,
    "hedge": 0.0, "bear": 0.0, "bearish": -2.0, "bull": 0.0, "bullish": 2.0,
    "correction": 0.0, "sell": 0.0, "selling": 0.0, "cheap": 0.0,
}


def finance_lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(FINANCE_WORDS.items()), "term string, valence double")


def overlay(general: DataFrame, special: DataFrame) -> DataFrame:
    """A general lexicon with the special one's entries winning."""
    return general.join(special, "term", "left_anti").unionByName(special)


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + NORMALIZER)


def score(texts: DataFrame, lexicon: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., score): compound sentiment of every whole text; NULL when the text is empty.

    Words meet the lexicon where they are read, while Spark finds it small enough to broadcast, and are summed there:
    one row per text is shuffled, and the texts are read once.
    """
    filled = F.coalesce(F.trim(text), F.lit("")) != ""
    terms = texts.select(*key, filled.alias("_filled"), F.explode_outer(words(F.col(text))).alias("term"))
    found = terms.join(lexicon.select("term", "valence"), "term", "left")
    out = found.groupBy(*key).agg(F.max("_filled").alias("_filled"), F.sum("valence").alias("_s"))
    return out.select(*key, F.when(F.col("_filled"), compound(F.coalesce("_s", F.lit(0.0)))).alias("score"))


def classify(score_: Column) -> Column:
    return F.when(score_ >= P.POSITIVE, "positive").when(score_ <= P.NEGATIVE, "negative").when(score_.isNotNull(), "neutral")


def company_tokens(symbol: Column, name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), LEGAL, " ")
    return F.concat(F.array(F.lower(symbol)), F.regexp_extract_all(plain, F.lit("([a-z]{3,})"), F.lit(1)))


def is_relevant(title: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.lower(title).contains(t))


def analyse(articles: DataFrame, companies: DataFrame, lexicon: DataFrame, cap: int | None = None) -> DataFrame:
    """Sentiment per symbol over its relevant articles; ``cap`` keeps the first so many in feed order for a display.

    articles(symbol, feed_pos, title, summary), companies(symbol, name).
    """
    known = articles.join(companies, "symbol").withColumn("_rel", is_relevant(F.col("title"), company_tokens(F.col("symbol"), F.col("name"))))
    totals = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("considered"), F.count_if(~F.col("_rel")).alias("dropped"))
    shown = known.where("_rel")
    if cap is not None:
        w = Window.partitionBy("symbol").orderBy("feed_pos")
        shown = shown.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    shown = shown.select("symbol", "feed_pos", F.concat_ws(". ", "title", "summary").alias("text"))
    scored = score(shown, lexicon, ["symbol", "feed_pos"], "text").withColumn("label", classify(F.col("score")))
    sums = scored.groupBy("symbol").agg(
        F.count("score").alias("usable"), F.count_if(F.col("label") == "positive").alias("positive"),
        F.count_if(F.col("label") == "negative").alias("negative"), F.count_if(F.col("label") == "neutral").alias("neutral"),
        F.avg("score").alias("_mean"))
    out = companies.select("symbol").join(totals, "symbol", "left").join(sums, "symbol", "left").fillna(
        0, ["considered", "dropped", "usable", "positive", "negative", "neutral"])
    mean = F.when(F.col("usable") >= P.MIN_ARTICLES, F.col("_mean"))
    note = F.concat_ws("; ", F.when(F.col("dropped") > 0, F.format_string("%d of %d articles left out as not about the company", "dropped", "considered")),
                       F.when(F.col("usable") == 0, "no usable recent news").when(F.col("usable") < P.MIN_ARTICLES, F.format_string("only %d relevant articles", "usable")))
    return out.select("symbol", "considered", "dropped", "usable", "positive", "negative", "neutral", mean.alias("score"),
                      F.coalesce(classify(mean), F.lit("unavailable")).alias("label"), note.alias("notes"))


def evaluate(scored: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """One row (correct, total): classified scores against expected(key..., expected)."""
    both = expected.join(scored, key).withColumn("_l", classify(F.col("score")))
    return both.agg(F.count_if(F.col("_l") == F.col("expected")).alias("correct"), F.count(F.lit(1)).alias("total"))
