"""Edge-triggered alerts over a stream of rule evaluations (rule_id, ts, is_met, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.sources.tables import drop_below

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Deliver = Callable[[DataFrame, int], None]


def fresh(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Evaluations later than the last one that the state knows of, with what was active then; others have had their turn."""
    known = state.select("rule_id", "was_active", F.col("ts").alias("_last"))
    seen = batch.join(known, "rule_id", "left")
    return seen.where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")


def edges(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that are met while the row before them (or the stored state) was not."""
    w = Window.partitionBy("rule_id").orderBy("ts")
    before = F.coalesce(F.lag("is_met").over(w), F.col("was_active"), F.lit(False))
    seen = fresh(batch, state).withColumn("_before", before)
    return seen.where(F.col("is_met") & ~F.col("_before")).drop("_before", "was_active")


def advanced(batch: DataFrame, state: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """State after the batch: the newest evaluation of every rule, older rules kept as long as they exist."""
    newest = batch.groupBy("rule_id").agg(F.max_by("is_met", "ts").alias("_now"), F.max("ts").alias("_at"))
    both = newest.join(state.select("rule_id", "was_active", "ts"), "rule_id", "full")
    later = F.col("_at").isNotNull() & (F.col("ts").isNull() | (F.col("_at") > F.col("ts")))
    out = both.select("rule_id", F.when(later, F.col("_now")).otherwise(F.col("was_active")).alias("was_active"), F.when(later, F.col("_at")).otherwise(F.col("ts")).alias("ts"))
    return out if rules is None else out.join(rules.select("rule_id").distinct(), "rule_id", "left_semi")


class StateTable:
    """Rule state as one partition per batch; committing a batch replaces only its own partition.

    A batch may be repeated until the next one begins, so the state before the last batch is kept as well, and nothing older.
    """

    SCHEMA = "rule_id string, was_active boolean, ts timestamp, batch long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).write.mode("ignore").partitionBy("batch").parquet(path)

    def before(self, batch_id: int) -> DataFrame:
        """The newest state older than the batch (empty at the start)."""
        known = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("batch") < batch_id)
        newest = known.agg(F.max("batch").alias("batch"))
        return known.join(newest, "batch", "left_semi").drop("batch")

    def last(self) -> int:
        """Number of the newest batch with a state, -1 at the start."""
        newest = self.spark.read.schema(self.SCHEMA).parquet(self.path).agg(F.max("batch")).first()[0]
        return -1 if newest is None else newest

    def commit(self, batch_id: int, state: DataFrame) -> None:
        before = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
        state.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
        if before is not None:
            drop_below(self.spark, self.path, "batch", before)


def _step(table: StateTable, batch: DataFrame, batch_id: int, deliver: Deliver, rules: Callable[[], DataFrame] | None, dry_run: bool) -> None:
    state = table.before(table.last() + 1 if dry_run else batch_id)
    batch = batch.persist()
    try:
        deliver(edges(batch, state), batch_id)
        if not dry_run:
            table.commit(batch_id, advanced(batch, state, rules and rules()))
    finally:
        batch.unpersist()


def watch(results: DataFrame, state_path: str, deliver: Deliver, checkpoint: str, rules: Callable[[], DataFrame] | None = None,
          dry_run: bool = False) -> StreamingQuery:
    """Deliver new triggers of every micro-batch, then store the state.

    The state moves only after ``deliver`` returned, so a failed delivery is repeated (at least once).  ``rules`` reads the rules that exist at that
    time; the state of others goes.  A dry run evaluates as well and hands the triggers to ``deliver`` (which should only report them then), but
    leaves the state as it is; give it a checkpoint of its own.
    """
    table = StateTable(results.sparkSession, state_path)
    return results.writeStream.foreachBatch(lambda batch, batch_id: _step(table, batch, batch_id, deliver, rules, dry_run)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_rest(results: DataFrame, state_path: str, deliver: Deliver, rules: Callable[[], DataFrame] | None = None, dry_run: bool = False) -> None:
    """One more step over a table of evaluations after a stream has ended, such as those of bars that were still open; what the
    stream has evaluated is not evaluated again."""
    table = StateTable(results.sparkSession, state_path)
    _step(table, results, table.last() + 1, deliver, rules, dry_run)


class EdgeProcessor(StatefulProcessor):
    """Keyed-state form of the same rule: remembers per rule whether it was met.

    A row without a verdict (``is_met`` NULL) says that the rule has been deleted and clears its state; with ``ttl_ms`` a rule that is not evaluated
    for so long is forgotten as well.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "active boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The rows of one rule in a micro-batch come in no order: they are sorted here."""
        was = bool(self.active.get()[0]) if self.active.exists() else False
        fired, known = [], self.active.exists()
        for at, met in pd.concat(list(rows))[["ts", "is_met"]].sort_values("ts", kind="stable").itertuples(index=False):
            if met is None or pd.isna(met):
                was, known = False, False
                continue
            if met and not was:
                fired.append(at)
            was, known = bool(met), True
        if known:
            self.active.update((was,))
        else:
            self.active.clear()
        if fired:
            yield pd.DataFrame({"rule_id": [key[0]] * len(fired), "ts": fired})

    def close(self) -> None:
        pass


def stream_edges(results: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """New triggers as a stream, state kept per rule (needs the RocksDB state store).

    With ``ttl_ms`` and a trigger that ends with its input, set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false: expiry
    asks for a further batch each time.
    """
    return results.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=EdgeProcessor(ttl_ms), outputStructType="rule_id string, ts timestamp", outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime")
