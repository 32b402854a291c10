"""Quality rules: counts of words, lines and repeats, then a hashed n-gram log-likelihood ratio.

Every document gets the counts below and a score: the log-likelihood ratio of its hashed unigrams and bigrams
under two multinomials, one of trusted documents and one of the whole corpus, divided by the number of n-grams.
The corpus multinomial counts every document.  The trusted one counts a documented sample of the rows labelled as
good (``trusted_rows`` ids, those with the least hashes).  Document verdicts are a fixed threshold on the score, so
a document with the same text always gets the same verdict in one corpus.

Defined cases: a null text counts as empty and fails the rule on words; texts without n-grams score 0; with no
trusted document all scores are 0, and the counts alone decide; repeated rows are judged each; extra columns stay
out of the way.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, whole_row

SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Hash space of the n-grams: it bounds the model, whatever the corpus.
BUCKETS = 10_000
#: Corpus n-grams mixed into the trusted counts, so that a few trusted documents judge mildly.
PRIOR = 20 * BUCKETS
TRUSTED_ROWS = 20_000
#: A document whose n-grams are this much less likely (in nats each) in trusted text than in the corpus goes.
MIN_SCORE = -0.05


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def _pair(first: Column, second: Column) -> Column:
    """Hash of two neighbouring words from their hashes."""
    return first.bitwiseXOR(F.shiftleft(second, 1))


def counts(docs: DataFrame) -> DataFrame:
    """``row`` (the input row), ``hashed`` (one hash a word) and the counts of every document's whole text."""
    base = docs.select(whole_row(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0)
    base = base.select(
        "row", "text", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*[F.get("hashed", i + k) for k in range(WINDOW)]))
    base = base.withColumn("windows", F.when(F.col("n_words") >= WINDOW, windows))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("placed", F.when(again, placed))
    same = lambda e, k: F.coalesce(F.get(F.col("placed"), k)["h"] == e["h"], F.lit(False))
    twice = F.filter("placed", lambda e, k: same(e, k - 1) | same(e, k + 1))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))
    return base.select(
        "row", "hashed", F.col("n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, prior: float = PRIOR) -> list[float]:
    """Log ratio of each hash bucket: trusted multinomial, smoothed toward the corpus, over the corpus multinomial.

    The only thing collected is one number per bucket.  The ids of the trusted sample are at most ``trusted_rows``
    numbers, which is what makes their broadcast safe.  ``prior`` is how many corpus n-grams are mixed in.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("good_id")).where("good_id is not null").distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted_rows)
    words = docs.select("doc_id", _words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    marked = words.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    placed = marked.select(F.col("good_id").isNotNull().cast("long").alias("good"), "words", F.posexplode_outer("words").alias("i", "word"))
    one, after = F.xxhash64("word"), F.get("words", F.col("i") + 1)
    both = F.when(F.col("word").isNotNull(), F.array(_bucket(one), F.when(after.isNotNull(), _bucket(_pair(one, F.xxhash64(after))))))
    grams = placed.select("good", F.explode_outer(both).alias("bucket")).where("bucket is not null")
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("n_good")).collect()
    total, good_total = sum(r["n"] for r in counted), sum(r["n_good"] for r in counted)
    ratios = [0.0] * BUCKETS
    for r in counted:
        share = r["n"] / total
        ratios[r["bucket"]] = log((r["n_good"] + prior * share) / ((good_total + prior) * share))
    return ratios


def judge(docs: DataFrame, ratios: list[float], min_score: float = MIN_SCORE) -> DataFrame:
    """``row``, the counts, ``base_failed``, ``score`` and ``kept`` for every document."""
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    at = lambda h: F.get(model, _bucket(h))
    last = F.element_at("hashed", -1)
    total = F.aggregate(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 2), at(last),
        lambda acc, i: acc + at(F.get("hashed", i)) + at(_pair(F.get("hashed", i), F.get("hashed", i + 1))))
    mean = F.when(F.col("n_words") > 1, total / (2 * F.col("n_words") - 1)).when(F.col("n_words") == 1, at(last)).otherwise(0.0)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    scored = counts(docs).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        mean.alias("score"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, unchanged."""
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select("row", "kept")
    # a generator between the verdict and the filter: without it the optimizer moves the filter below the steps that lead to the
    # verdict and repeats them inside it, once per use
    fenced = judged.select(F.inline_outer(F.array(F.struct("row", "kept"))))
    return fenced.where("kept").select("row.*")
