"""Classifier and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.series import rounded
from barloom.operators import ml
from barloom.operators import text as tx
from barloom.operators.risk import simple_returns
from barloom.plans.base_sql import BARS, MACD_CTE, MEMBERS, RETS, RETURNS, RSI_CTE, full
from barloom.plans.registry import query
from barloom.session import stage
from barloom.sources import payloads as pl
from barloom.sources.market import bars_daily, baskets
from barloom.sources.tables import table

FEAT = f"""{BARS}, {RETS}, {RSI_CTE}, {MACD_CTE}, ft AS MATERIALIZED (SELECT b.symbol, b.ts, b.close, rsi AS rsi_14, macd_hist AS macd_histogram, (b.close - s20) / s20 * 100 AS price_vs_sma20_pct, (s20 - s50) / s50 * 100 AS sma20_vs_sma50_pct,
    (b.close / lag(b.close, 10) OVER w - 1) * 100 AS return_10d_pct, (b.close / lag(b.close, 20) OVER w - 1) * 100 AS return_20d_pct, vol20 AS volatility_20d, b.volume / va AS volume_ratio_20d, lead(b.close, 10) OVER w AS ahead,
    count(*) OVER (PARTITION BY b.symbol) AS n
  FROM bars b JOIN rsi USING (symbol, ts) JOIN macd USING (symbol, ts) JOIN (SELECT symbol, ts, {full('avg', 'close', 20)} AS s20, {full('avg', 'close', 50)} AS s50, {full('avg', 'volume', 20)} AS va FROM bars) q USING (symbol, ts)
    JOIN (SELECT symbol, ts, {full('stddev_samp', 'ret', 20)} * sqrt(252) AS vol20 FROM rets) r USING (symbol, ts) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts)),
  dset AS MATERIALIZED (SELECT *, CASE WHEN ahead > close THEN 1 ELSE 0 END AS label FROM ft WHERE n >= 60 AND ahead IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in ml.FEATURES)})"""


@query("ml_dataset", f"WITH {FEAT} SELECT symbol, ts, {', '.join(f'round({c}, 4) AS {c}' for c in ml.FEATURES)}, label::DOUBLE AS label FROM dset")
def _(spark, sf):
    return rounded(ml.dataset(bars_daily(spark, sf)).drop("close"), 4)


@query("ml_skipped", f"""WITH {FEAT} SELECT symbol, bars, coalesce(rows_, 0) AS rows, CASE WHEN bars < 60 THEN 'only ' || bars || ' usable bars' WHEN rows_ IS NULL THEN 'no rows survived feature warm-up and label horizon' END AS reason
  FROM (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) LEFT JOIN (SELECT symbol, count(*) AS rows_ FROM dset GROUP BY symbol) USING (symbol)""")
def _(spark, sf):
    daily = stage(bars_daily(spark, sf))
    return ml.skipped(daily, ml.dataset(daily))


@query("ml_time_split", f"""WITH {FEAT}, d AS (SELECT list_sort(list(DISTINCT ts)) AS ds FROM dset), c AS (SELECT ds[least(greatest(1, floor(len(ds) * (1 - 0.2::DOUBLE))::BIGINT), len(ds) - 1) + 1] AS cut FROM d)
  SELECT ts >= cut AS is_test, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(label), 6) AS up_share FROM dset, c GROUP BY 1""")
def _(spark, sf):
    split = ml.with_split(ml.dataset(bars_daily(spark, sf)))
    out = split.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("label").alias("up_share"))
    return rounded(out)


@query("ml_train_evaluate")
def _(spark, sf):
    return rounded(ml.train(ml.with_split(ml.dataset(bars_daily(spark, sf)))).metrics, 4)


@query("ml_predict_latest")
def _(spark, sf):
    daily = stage(bars_daily(spark, sf))
    trained = ml.train(ml.with_split(ml.dataset(daily)))
    return rounded(ml.predict_latest(trained.model, daily), 4)


def documents(spark, sf):
    """Every document as a news item: its first line is the title, the rest the summary; odd ids use the flat shape."""
    d = table(spark, sf, "documents")
    cut = F.instr("text", "\n")
    title = F.when(cut > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text"))
    summary = F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    return d.select("doc_id", "source", title.alias("t"), summary.alias("s"))


def news_payloads(spark, sf):
    d = documents(spark, sf)
    stamp = F.col("doc_id") * 60 + 1704067200
    link = F.concat(F.lit("http://news/"), F.col("doc_id").cast("string"))
    nested = F.to_json(F.struct(F.struct(
        F.col("t").alias("title"), F.col("s").alias("summary"), F.struct(F.upper("source").alias("displayName")).alias("provider"),
        F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"), F.struct(link.alias("url")).alias("canonicalUrl")).alias("content")))
    flat = F.to_json(F.struct(F.col("t").alias("title"), F.col("s").alias("description"), F.upper("source").alias("publisher"), link.alias("link"), stamp.cast("string").alias("providerPublishTime")))
    return d.select(F.col("source").alias("symbol"), F.col("doc_id").alias("feed_pos"), F.when(F.col("doc_id") % 2 == 0, nested).otherwise(flat).alias("body"))


def companies(spark, sf):
    names = F.array(*[F.lit(n) for n in ("Tion Group", "The Ent Corp.", "Eau Holdings Inc", "Che Co")])
    s = table(spark, sf, "documents").select(F.col("source").alias("symbol")).distinct()
    n = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    return s.select("symbol", F.element_at(names, n % 4 + 1).alias("name"))


def lexicon(spark, sf):
    """A valence for every word of the benchmark texts, by length and first letter."""
    w = table(spark, sf, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("term")).where(F.col("term").rlike("^[a-z]+$")).distinct()
    return w.select("term", (((F.length("term") * 7 + F.ascii("term")) % 9) - 4.0).alias("valence"))


NEWS = r"""d AS (SELECT doc_id, source, CASE WHEN strpos(text, chr(10)) > 0 THEN substring(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS t, CASE WHEN strpos(text, chr(10)) > 0 THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END AS s FROM documents),
  art AS MATERIALIZED (SELECT source AS symbol, doc_id AS feed_pos, trim(t, ' ') AS title, trim(s, ' ') AS summary, 'http://news/' || doc_id AS url, upper(source) AS provider, (TIMESTAMP '2024-01-01' + INTERVAL (doc_id) MINUTE)::TIMESTAMP AS published FROM d WHERE trim(t, ' ') <> '')"""
LEX = r"""lex AS MATERIALIZED (SELECT DISTINCT term, ((length(term) * 7 + ascii(term)) % 9 - 4)::DOUBLE AS valence FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS term FROM benchmark) WHERE regexp_full_match(term, '[a-z]+'))"""


def scored_sql(src: str, key: str, text: str) -> str:
    return rf"""tok AS (SELECT {key}, unnest(string_split_regex(lower({text}), '[^\p{{L}}]+')) AS term FROM {src}),
  sm AS (SELECT {key}, sum(valence) AS s FROM tok JOIN lex USING (term) GROUP BY {key}),
  sc AS MATERIALIZED (SELECT {key}, CASE WHEN trim({text}, ' ') <> '' THEN coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) END AS score FROM {src} LEFT JOIN sm USING ({key}))"""


CLS = "CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' WHEN score IS NOT NULL THEN 'neutral' END"


@query("ns_articles", f"WITH {NEWS} SELECT symbol, feed_pos, title, md5(summary) AS summary_md5, url, provider, published FROM art")
def _(spark, sf):
    out = pl.articles(news_payloads(spark, sf))
    return out.select("symbol", "feed_pos", "title", F.md5("summary").alias("summary_md5"), "url", "provider", "published")


@query("ns_score_text", f"WITH {LEX}, {scored_sql('documents', 'doc_id', 'text')} SELECT doc_id, round(score, 6) AS score, {CLS} AS label FROM sc")
def _(spark, sf):
    out = tx.score(table(spark, sf, "documents"), lexicon(spark, sf), ["doc_id"], "text")
    return rounded(out.withColumn("label", tx.classify(F.col("score"))))


TOKENS = r"""co AS (SELECT DISTINCT source AS symbol, ['Tion Group', 'The Ent Corp.', 'Eau Holdings Inc', 'Che Co'][regexp_extract(source, '([0-9]+)', 1)::INT % 4 + 1] AS name FROM documents),
  tk AS (SELECT symbol, list_concat([lower(symbol)], regexp_extract_all(regexp_replace(lower(name), '\b(inc|corp|corporation|co|ltd|plc|llc|nv|sa|ag|holdings|group|the)\b\.?', ' ', 'g'), '[a-z]{3,}')) AS tokens FROM co),
  rel AS MATERIALIZED (SELECT a.*, len(list_filter(tokens, lambda t: contains(lower(title), t))) > 0 AS rel FROM art a JOIN tk USING (symbol))"""


@query("ns_relevance", f"WITH {NEWS}, {TOKENS} SELECT symbol, feed_pos, rel AS relevant FROM rel")
def _(spark, sf):
    a = pl.articles(news_payloads(spark, sf)).join(companies(spark, sf), "symbol")
    return a.select("symbol", "feed_pos", tx.is_relevant(F.col("title"), tx.company_tokens(F.col("symbol"), F.col("name"))).alias("relevant"))


@query("ns_analyse", f"""WITH {NEWS}, {LEX}, {TOKENS}, sh AS MATERIALIZED (SELECT symbol, feed_pos, title || '. ' || summary AS txt FROM rel WHERE rel),
  {scored_sql('sh', 'feed_pos', 'txt')}, g AS (SELECT symbol, count(score) AS usable, count(*) FILTER (score >= 0.05) AS positive, count(*) FILTER (score <= -0.05) AS negative, avg(score) AS m FROM sh JOIN sc USING (feed_pos) GROUP BY symbol),
  t AS (SELECT symbol, count(*) AS considered, count(*) FILTER (NOT rel) AS dropped FROM rel GROUP BY symbol),
  j AS (SELECT co.symbol, coalesce(considered, 0) AS considered, coalesce(dropped, 0) AS dropped, coalesce(usable, 0) AS usable, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, CASE WHEN usable >= 3 THEN m END AS score FROM co LEFT JOIN t USING (symbol) LEFT JOIN g USING (symbol))
  SELECT symbol, considered, dropped, usable, positive, negative, usable - positive - negative AS neutral, round(score, 6) AS score, coalesce({CLS}, 'unavailable') AS label,
    concat_ws('; ', CASE WHEN dropped > 0 THEN dropped || ' of ' || considered || ' articles left out as not about the company' END, CASE WHEN usable = 0 THEN 'no usable recent news' WHEN usable < 3 THEN 'only ' || usable || ' relevant articles' END) AS notes FROM j""")
def _(spark, sf):
    return rounded(tx.analyse(pl.articles(news_payloads(spark, sf)), companies(spark, sf), lexicon(spark, sf)))


@query("ns_evaluate", f"""WITH {LEX}, {scored_sql('documents', 'doc_id', 'text')} SELECT count(*) FILTER ({CLS} = CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END) AS correct, count(*) AS total FROM labels JOIN sc USING (doc_id)""")
def _(spark, sf):
    scored = tx.score(table(spark, sf, "documents"), lexicon(spark, sf), ["doc_id"], "text")
    expected = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("expected"))
    return tx.evaluate(scored, expected, ["doc_id"])


_VERBS = ((0.02, "surges"), (0.0, "gains"), (-0.02, "slips"))
_HEADLINE = " ".join(f"WHEN r >= {b} THEN '{w}'" for b, w in _VERBS)
_FIN = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in tx.FINANCE_WORDS.items())


@query("ns_finance_headlines", f"""WITH {RETURNS}, hl AS MATERIALIZED (SELECT symbol, ts, symbol || ' stock ' || CASE {_HEADLINE} ELSE 'plunges' END || CASE WHEN abs(r) > 0.04 THEN ' after results miss' ELSE '' END AS title
    FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars) WHERE r IS NOT NULL),
  lex AS (SELECT * FROM (VALUES {_FIN}) v(term, valence)), gl AS (SELECT DISTINCT term, ((length(term) * 7 + ascii(term)) % 9 - 4)::DOUBLE AS valence FROM (VALUES ('stock'), ('results'), ('miss'), ('gains')) g(term)),
  ov AS (SELECT * FROM lex UNION ALL SELECT * FROM gl WHERE term NOT IN (SELECT term FROM lex)),
  tok AS (SELECT symbol, ts, unnest(string_split_regex(lower(title), '[^\\p{{L}}]+')) AS term FROM hl), sm AS (SELECT symbol, ts, sum(valence) AS s FROM tok JOIN ov USING (term) GROUP BY ALL)
  SELECT symbol, ts, title, round(score, 6) AS score, {CLS} AS label FROM (SELECT hl.*, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS score FROM hl LEFT JOIN sm USING (symbol, ts))""")
def _(spark, sf):
    """A headline for every daily move, scored by a general lexicon under the finance words."""
    moved = simple_returns(bars_daily(spark, sf).select("symbol", "ts", "close")).where(F.col("r").isNotNull())
    verb = F.lit("plunges")
    for bound, word in reversed(_VERBS):
        verb = F.when(F.col("r") >= bound, word).otherwise(verb)
    title = F.concat(F.col("symbol"), F.lit(" stock "), verb, F.when(F.abs("r") > 0.04, " after results miss").otherwise(""))
    heads = stage(moved.select("symbol", "ts", title.alias("title")))
    general = spark.createDataFrame([(w, float((len(w) * 7 + ord(w[0])) % 9 - 4)) for w in ("stock", "results", "miss", "gains")], "term string, valence double")
    scored = tx.score(heads, tx.overlay(general, tx.finance_lexicon(spark)), ["symbol", "ts"], "title")
    out = heads.join(scored, ["symbol", "ts"])
    return rounded(out.withColumn("label", tx.classify(F.col("score"))))


@query("ml_universe", f"""WITH {MEMBERS[2:]}, h AS (SELECT DISTINCT p_brand AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49)
  SELECT symbol, min(b) AS first_basket FROM (SELECT symbol, 0 AS b FROM mem WHERE basket IN ('basket0', 'basket1') UNION ALL SELECT symbol, 1 FROM h) GROUP BY symbol""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 49").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ml.training_universe(baskets(spark, sf).where(F.col("basket").isin("basket0", "basket1")), lines.select(F.col("p_brand").alias("symbol")).distinct())
