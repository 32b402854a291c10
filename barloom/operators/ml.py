"""A time-split classifier of "higher in ten bars", on pyspark.ml."""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import full, over_time, prev, sdiv, whole
from barloom.functions.series import latest as latest_rows
from barloom.operators import indicators as ti
from barloom.operators import risk as rk

FEATURES = ("rsi_14", "macd_histogram", "price_vs_sma20_pct", "sma20_vs_sma50_pct", "return_10d_pct", "return_20d_pct",
            "volatility_20d", "volume_ratio_20d")


def features(bars: DataFrame) -> DataFrame:
    """Eight trailing features per bar; nothing reads a later row."""
    f = rk.log_returns(ti.macd(ti.rsi(ti.sma(bars.select("symbol", "ts", "close", "volume"), (20, 50)), 14)))
    c = F.col("close")
    change = lambda n: (sdiv(c, prev(c, n)) - 1) * 100
    return f.select(
        "symbol", "ts", "close", F.col("rsi").alias("rsi_14"), F.col("macd_hist").alias("macd_histogram"),
        (sdiv(c - F.col("sma_20"), F.col("sma_20")) * 100).alias("price_vs_sma20_pct"),
        (sdiv(F.col("sma_20") - F.col("sma_50"), F.col("sma_50")) * 100).alias("sma20_vs_sma50_pct"),
        change(10).alias("return_10d_pct"), change(20).alias("return_20d_pct"), rk.rolling_vol(20).alias("volatility_20d"),
        sdiv(F.col("volume"), full(F.avg, F.col("volume"), 20)).alias("volume_ratio_20d"))


def label(horizon: int = P.LABEL_HORIZON) -> Column:
    """1 when the close ``horizon`` bars later is higher, NULL on the last bars."""
    ahead = F.lead("close", horizon).over(over_time())
    return F.when(ahead.isNotNull(), (ahead > F.col("close")).cast("double"))


def dataset(bars: DataFrame, horizon: int = P.LABEL_HORIZON) -> DataFrame:
    """Complete, labelled rows of the symbols with enough bars."""
    enough = bars.withColumn("_n", F.count(F.lit(1)).over(whole())).where(F.col("_n") >= P.MIN_TRAIN_BARS).drop("_n")
    return features(enough).withColumn("label", label(horizon)).dropna(subset=[*FEATURES, "label"])


def skipped(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Why a symbol contributed nothing (NULL when it did)."""
    have = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    used = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    reason = (
        F.when(F.col("bars") < P.MIN_TRAIN_BARS, F.format_string("only %d usable bars", F.col("bars")))
        .when(F.col("rows").isNull(), "no rows survived feature warm-up and label horizon"))
    return have.join(used, "symbol", "left").select("symbol", "bars", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), reason.alias("reason"))


def split_date(rows: DataFrame, test_fraction: float = P.TEST_FRACTION) -> DataFrame:
    """One row ``_cut``: the first test date, the k-th of the distinct dates, by counting in two levels.

    Dates are counted per month; the running count over the months (one row each) tells in which month the k-th lies, and only that month's
    dates are ranked.  No list of all dates is built.
    """
    month = F.date_trunc("MONTH", "ts")
    dates = rows.select("ts").distinct().withColumn("_m", month)
    months = dates.groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    till = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)  # rows are months
    counted = months.select("_m", "_n", F.sum("_n").over(till).alias("_till"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    k = F.least(F.greatest(F.lit(1), F.floor(F.col("_all") * (1 - test_fraction))), F.col("_all") - 1) + 1
    one = counted.withColumn("_k", k).where((F.col("_till") >= F.col("_k")) & (F.col("_till") - F.col("_n") < F.col("_k")))
    inside = dates.join(F.broadcast(one.select("_m", (F.col("_k") - F.col("_till") + F.col("_n")).alias("_k"))), "_m")  # one row
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_m").orderBy("ts")))
    return ranked.where(F.col("_r") == F.col("_k")).select(F.col("ts").alias("_cut"))


def with_split(rows: DataFrame, test_fraction: float = P.TEST_FRACTION) -> DataFrame:
    """Adds ``is_test``: one date cutoff for all symbols."""
    cutoff = split_date(rows, test_fraction)
    return rows.crossJoin(F.broadcast(cutoff)).withColumn("is_test", F.col("ts") >= F.col("_cut")).drop("_cut")


@dataclass
class Trained:
    model: PipelineModel | None
    metrics: DataFrame | None
    reason: str | None = None


def train(split: DataFrame, max_iter: int = 100) -> Trained:
    """Standardized, class-balanced logistic regression; refuses small or one-sided data."""
    split = split.persist(StorageLevel.MEMORY_AND_DISK)  # read by every pass of the fit and by the evaluation
    sizes = split.agg(
        F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"),
        F.count_if(~F.col("is_test") & (F.col("label") == 1)).alias("ups")).first()
    total = sizes.train + sizes.test
    if total < P.MIN_TRAIN_ROWS:
        return Trained(None, None, f"only {total} usable training rows, below the minimum of {P.MIN_TRAIN_ROWS}")
    if not sizes.train or not sizes.test or sizes.ups in (0, sizes.train):
        return Trained(None, None, "the date split produced an empty or one-sided set")
    balance = F.when(F.col("label") == 1, sizes.train / (2.0 * sizes.ups)).otherwise(sizes.train / (2.0 * (sizes.train - sizes.ups)))
    fit_rows = split.where(~F.col("is_test")).withColumn("w", balance)
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
        # an L2 penalty of 1/2 |w|^2 on the summed loss is 1/n on the mean loss
        LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1.0 / sizes.train, elasticNetParam=0.0,
                           standardization=False, maxIter=max_iter),
    ])
    model = pipeline.fit(fit_rows)
    return Trained(model, evaluation(model, split))


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("probability_up", vector_to_array("probability")[1]).drop("raw", "x", "rawPrediction", "probability")


def evaluation(model: PipelineModel, split: DataFrame) -> DataFrame:
    """One row: sizes, accuracies, majority baseline and the rank-based AUC of the held-out rows.

    The AUC counts smaller scores with the range-split counter, so it never sorts all rows in one task.
    """
    from barloom.functions.rank import group_counts

    scored = probabilities(model, split).select("label", "is_test", "prediction", "probability_up")
    t = F.col("is_test")
    hit = (F.col("prediction") == F.col("label")).cast("double")
    base = scored.agg(
        F.count_if(~t).alias("train_rows"), F.count_if(t).alias("test_rows"), F.avg(F.when(~t, hit)).alias("train_accuracy"),
        F.avg(F.when(t, hit)).alias("test_accuracy"), F.avg(F.when(t, F.col("label"))).alias("_p"))
    test = scored.where(t).withColumn("g", F.lit(1))
    counts = group_counts(test, ["g"], "probability_up")
    ranks = test.join(counts, ["g", "probability_up"]).agg(
        F.sum(F.when(F.col("label") == 1, F.col("less") + (F.col("equal") + 1) / 2)).alias("_r"),
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg"))
    auc = sdiv(F.col("_r") - F.col("_pos") * (F.col("_pos") + 1) / 2, F.col("_pos") * F.col("_neg"))
    return base.crossJoin(F.broadcast(ranks)).select(
        "train_rows", "test_rows", "train_accuracy", "test_accuracy", auc.alias("test_auc"),
        F.greatest("_p", 1 - F.col("_p")).alias("baseline_accuracy"))


def predict_latest(model: PipelineModel | None, bars: DataFrame) -> DataFrame:
    """Probability for the last bar of every symbol, or the status that says why there is none."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    last = latest_rows(features(bars))
    joined = counts.join(last, "symbol", "left")
    if model is None:
        return joined.select("symbol", "ts", F.lit("no_model").alias("status"), F.lit(None).cast("double").alias("probability_up"))
    complete = F.lit(True)
    for c in FEATURES:
        complete = complete & F.col(c).isNotNull()
    joined = joined.withColumn("status", F.when((F.col("bars") >= P.MIN_TRAIN_BARS) & complete, "ok").otherwise("insufficient_data"))
    scored = probabilities(model, joined.where(F.col("status") == "ok")).select("symbol", "probability_up")
    return joined.select("symbol", "ts", "status").join(scored, "symbol", "left")


def training_universe(*baskets: DataFrame) -> DataFrame:
    """Distinct symbols over several baskets, with the position of their first appearance."""
    parts = [b.select("symbol", F.lit(i).alias("_b")) for i, b in enumerate(baskets)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("symbol").agg(F.min("_b").alias("first_basket"))


def save(trained: Trained, model_path: str, history_path: str, run_at: str) -> None:
    """Write the model and append its metrics to the history table."""
    trained.model.write().overwrite().save(model_path)
    trained.metrics.withColumn("run_at", F.lit(run_at)).write.mode("append").parquet(history_path)


def history(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """All runs, newest last; ``keep`` shows the newest so many."""
    runs = spark.read.parquet(path)
    return (runs if keep is None else runs.orderBy(F.col("run_at").desc()).limit(keep)).orderBy("run_at")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


