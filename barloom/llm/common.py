"""What several operators share: reading a table, setting an intermediate aside, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir, stage

#: With it Spark drops the shuffle files of a query when the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_row() -> Column:
    """The input row as one struct, so that none of its columns can clash with an operator's own."""
    return F.struct("*").alias("row")


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def aside(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the shuffle files that led to it go once it stands."""
    with _dropping_shuffles(df.sparkSession):
        return stage(df.select("*"))


def written(df: DataFrame) -> DataFrame:
    """A large intermediate as a Parquet table in the shared folder; the shuffle files that led to it go once it stands."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid4().hex}"
    with _dropping_shuffles(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, large: str, most_bytes: int = 16_000_000) -> DataFrame:
    """A table set aside, marked for broadcast if its rows and the text column ``large`` measure at most ``most_bytes``."""
    size = df.agg(F.sum(F.octet_length(large) + 200).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if size <= most_bytes else df


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components: ``links(a, b)`` -> ``(node, root)``, one row per node that has a link.

    Each round hooks every node to the neighbour (or itself) of least priority, a hash of the node, and
    contracts the links by it.  The priorities are random with regard to the links, so the number of nodes
    falls by a constant factor a round even on a long chain.  Minima combine before the shuffle, so a hub
    with a third of all links sends one row per task.  Nothing but the count of links left is collected.
    """
    spread = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = aside(both.where("a <> b").distinct())
    roots = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    for _ in range(max_rounds):
        hooks = edges.groupBy("a").agg(F.min(spread("b")).alias("least")).select("a", F.least("least", spread("a"))["n"].alias("to"))
        roots = roots.join(hooks.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        left = edges.join(hooks, "a").select(F.col("to").alias("x"), "b")
        both = left.join(hooks.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = aside(both.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if edges.isEmpty():
            return aside(roots)
    raise RuntimeError("links were left after the last round")
