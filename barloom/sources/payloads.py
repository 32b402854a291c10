"""Nested JSON payloads to typed rows: price arrays, asset profiles, news items, load status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRYPTO_PREFIX = "crypto:"  # fixed value

CHART = "prices array<array<double>>, total_volumes array<array<double>>"
ASSET = ("name string, symbol string, market_data struct<current_price: struct<usd: double>, price_change_24h: double, "
         "market_cap: struct<usd: double>>")
ARTICLE = ("title string, summary string, description string, publisher string, link string, clickThroughUrl struct<url: string>, "
           "canonicalUrl struct<url: string>, provider struct<displayName: string>, pubDate string, displayTime string, providerPublishTime string")
NEWS = f"content struct<{', '.join(f'{p.split(maxsplit=1)[0]}: {p.split(maxsplit=1)[1]}' for p in ARTICLE.split(', '))}>, {ARTICLE}"


def is_crypto(symbol: Column) -> Column:
    return F.lower(F.trim(symbol)).startswith(CRYPTO_PREFIX)


def coin_id(symbol: Column) -> Column:
    return F.when(is_crypto(symbol), F.lower(F.trim(F.substring(F.trim(symbol), len(CRYPTO_PREFIX) + 1, F.length(symbol)))))


def _points(df: DataFrame, field: str) -> DataFrame:
    p = df.select("symbol", F.explode(f"d.{field}").alias("p"))
    return p.select("symbol", F.col("p")[0].cast("long").alias("ms"), F.col("p")[1].alias("v")).where(F.col("v").isNotNull())


def daily_from_chart(payloads: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """payloads(symbol, body): [[epoch_ms, value], ...] arrays -> one bar per UTC day in [start, end] with the last value.

    Open, high and low equal the close because the source has no intraday range.
    """
    parsed = payloads.select("symbol", F.from_json("body", CHART).alias("d"))
    day = F.date_trunc("DAY", F.timestamp_millis("ms")).cast("timestamp_ntz").alias("ts")
    close = _points(parsed, "prices").groupBy("symbol", day).agg(F.max(F.struct("ms", "v"))["v"].alias("close"))
    volume = _points(parsed, "total_volumes").groupBy("symbol", day).agg(F.max(F.struct("ms", "v"))["v"].alias("volume"))
    out = close.join(volume, ["symbol", "ts"], "left")
    if start is not None:
        out = out.where(F.to_date("ts") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.to_date("ts") <= F.lit(end).cast("date"))
    c = F.col("close")
    return out.select("symbol", "ts", c.alias("open"), c.alias("high"), c.alias("low"), "close", "volume")


def asset_profiles(payloads: DataFrame) -> DataFrame:
    """payloads(symbol, body) -> profile columns; the previous close is price minus the 24-hour change."""
    d = payloads.select("symbol", F.from_json("body", ASSET).alias("d"))
    price, change = F.col("d.market_data.current_price.usd"), F.col("d.market_data.price_change_24h")
    return d.select("symbol", F.col("d.name").alias("long_name"), F.upper(F.coalesce("d.symbol", F.lit(""))).alias("code"),
                    price.alias("quote_price"), (price - change).alias("previous_close"), F.col("d.market_data.market_cap.usd").alias("market_cap"))


def parse_published(text: Column) -> Column:
    """Epoch seconds or ISO-8601; NULL otherwise."""
    epoch = text.try_cast("double")
    return F.coalesce(F.timestamp_micros((epoch * 1e6).cast("long")), F.try_to_timestamp(text)).cast("timestamp_ntz")


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def articles(payloads: DataFrame) -> DataFrame:
    """payloads(symbol, feed_pos, body): nested and flat news items -> articles; items without a title are dropped."""
    j = payloads.select("symbol", "feed_pos", F.from_json("body", NEWS).alias("j"))
    nested = F.col("j.content").isNotNull()
    get = lambda f: F.when(nested, F.col(f"j.content.{f}")).otherwise(F.col(f"j.{f}"))
    url = F.coalesce(_filled(get("canonicalUrl.url")), _filled(get("clickThroughUrl.url")), _filled(get("link")), F.lit(""))
    provider = F.coalesce(get("provider.displayName"), get("publisher"), F.lit(""))
    stamp = F.coalesce(_filled(get("pubDate")), _filled(get("displayTime")), _filled(get("providerPublishTime")))
    out = j.select(
        "symbol", "feed_pos", _filled(get("title")).alias("title"),
        F.coalesce(_filled(get("summary")), _filled(get("description")), F.lit("")).alias("summary"),
        url.alias("url"), provider.alias("provider"), parse_published(stamp).alias("published"))
    return out.where(F.col("title").isNotNull())


def load_status(symbols: DataFrame, tables: dict[str, DataFrame], required: str) -> DataFrame:
    """Which optional tables have no row for a symbol (warnings), and whether the required one is missing (error)."""
    out = symbols.select("symbol").distinct()
    for name, df in tables.items():
        out = out.join(df.select("symbol").distinct().withColumn(f"_{name}", F.lit(True)), "symbol", "left")
    warn = F.concat_ws(", ", *[F.when(F.col(f"_{n}").isNull(), F.lit(f"no {n}")) for n in tables if n != required])
    return out.select("symbol", warn.alias("warnings"), F.when(F.col(f"_{required}").isNull(), F.lit(f"no {required}")).alias("error"))


def with_provider(primary: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Rows of a second provider under the first one's schema; columns it lacks stay NULL."""
    tagged = primary.withColumn("provider", F.lit("primary"))
    return tagged.unionByName(other.withColumn("provider", F.lit(name)), allowMissingColumns=True).select(*tagged.columns)
