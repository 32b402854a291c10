"""Hard negatives by inner product: best-first search in an STR-packed R-tree whose top level is spread over the cluster.

A component x counts as ``floor(SCALE * x)``; a score is an integer inner product, higher first, ties by smaller id.

Packing: vectors are cut into slabs of equal size by the first coordinate, each slab by the second, each of those by the third
(sort-tile-recursive, cuts from approximate quantiles), into tiles of about ``TILE`` vectors; a tile crowded by equal coordinates is split by a
hash of the id.  The directory holds one bounding box per tile, at most ``MOST_TILES`` and one more per vector length (tiles grow with the
table beyond that), so it is small enough for every task.  Inside a tile the same packing gives leaves of ``LEAF`` vectors under nodes of ``FANOUT`` leaves.

Search: the box of a node bounds the inner product with a query from both sides, coordinate by coordinate.  A query first searches its own tile, which
gives a lower bound for its ``POSITIVES``-th positive, and then only tiles whose upper bound reaches it.  Negatives are searched only in tiles whose
interval meets the score window of a positive.  In a tile a queue takes nodes by upper bound; boxes outside the window, or strictly below the k-th score
found, are pruned.  Pruning only leaves out boxes that cannot hold a result, so the result is exact.

Queries of a tile go in blocks of ``BLOCK``; a tile of vectors meets every block in a task of its own.  What a task returns is k rows a search.

Defined cases: rows with a null vec_id, label or vector, or null or non-finite components take no part, nor do those whose squared length no long can
hold; rows equal in vec_id, label and vector are one; rows with an anchor's vec_id are never its positives or negatives; vectors of different length never
meet; an anchor without positives, or a positive without negatives, gives no row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHOR_STEP = 50
TILE, LEAF, FANOUT, BLOCK = 16_384, 256, 8, 4_096
MOST_TILES = 32_768
AXES = 3
LEAST, MOST = -(2**63), 2**63 - 1
#: Bounds of boxes are in floating point: so much wider, relative to the sum of magnitudes.
SLACK = 1e-12

QUERY = "qid string, anchor_id long, label int, vector binary, home string, wants array<struct<no:int,low:long,high:long>>"
FOUND = "qid string, anchor_id long, no int, vec_id long, score long"


def relabelled(vec_id: Column, label: Column) -> Column:
    """The labels of the contract: every seventh vector belongs to the next class."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packed, dims, leading = [], [], [], []
            for i, value in enumerate(batch.column("embedding")):
                if not value.is_valid or value.values.null_count:
                    continue
                x = np.floor(scale * value.values.to_numpy().astype(np.float64))
                if np.isfinite(x).all() and np.abs(x).max(initial=0) < 2**31 and float(x @ x) < 2.0**62:
                    rows.append(i)
                    packed.append(x.astype("<i4").tobytes())
                    dims.append(len(x))
                    leading.append([int(v) for v in x[:AXES]] + [0] * (AXES - len(x)))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(packed, pa.binary()), pa.array(dims, pa.int32()),
                 pa.array(leading, pa.list_(pa.int32()))], ["vec_id", "label", "vector", "dims", "leading"])

    return run


def tiles(vectors: DataFrame, size: int = TILE, most: int = MOST_TILES) -> DataFrame:
    """``vectors`` with the ``tile`` of every row."""
    n = vectors.count()
    size = max(size, -(-n // most))
    side = max(1, round((n / size) ** (1 / AXES) + 0.4999))
    node, placed = ["dims"], vectors
    for axis in range(AXES):
        if side > 1:
            x = F.col("leading")[axis]
            cuts = placed.groupBy(*node).agg(F.percentile_approx(x, [i / side for i in range(1, side)]).alias("cuts"))
            # at most MOST_TILES nodes, with less than 33 cuts each
            placed = placed.join(F.broadcast(cuts), node)
            placed = placed.withColumn(f"s{axis}", F.size(F.filter("cuts", lambda c: c < F.col("leading")[axis]))).drop("cuts")
            node = [*node, f"s{axis}"]
    counts = placed.groupBy(*node).agg(F.ceil(F.count(F.lit(1)) / (2 * size)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return placed.join(F.broadcast(counts), node).withColumn("tile", F.concat_ws("/", *node, part)).select("vec_id", "label", "vector", "dims", "tile")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), "<i4") for x in column])


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and tile: least and largest coordinates."""
    low: dict[str, np.ndarray] = {}
    high: dict[str, np.ndarray] = {}
    for batch in batches:
        for tile, value in zip(batch.column("tile").to_pylist(), batch.column("vector")):
            x = np.frombuffer(value.as_buffer(), "<i4")
            low[tile] = np.minimum(low[tile], x) if tile in low else x
            high[tile] = np.maximum(high[tile], x) if tile in high else x
    if low:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(low)), pa.array([v.tobytes() for v in low.values()], pa.binary()), pa.array([v.tobytes() for v in high.values()], pa.binary())],
            ["tile", "low", "high"])


def directory(placed: DataFrame) -> dict[int, tuple[list[str], np.ndarray, np.ndarray]]:
    """Per vector length: the tiles and their boxes."""
    def merged(rows: pa.Table) -> pa.Table:
        low, high = _matrix(rows.column("low")).min(0), _matrix(rows.column("high")).max(0)
        return pa.table({"tile": [rows.column("tile")[0].as_py()], "low": [low.tobytes()], "high": [high.tobytes()]})

    schema = "tile string, low binary, high binary"
    parts = placed.select("tile", "vector").mapInArrow(_boxes, schema)  # one row per task and tile
    found: dict[int, tuple[list, list, list]] = {}
    for r in parts.groupBy("tile").applyInArrow(merged, schema).collect():
        low, high = np.frombuffer(bytes(r["low"]), "<i4"), np.frombuffer(bytes(r["high"]), "<i4")
        for into, value in zip(found.setdefault(len(low), ([], [], [])), (r["tile"], low, high)):
            into.append(value)
    return {n: (names, np.stack(low).astype(np.float64), np.stack(high).astype(np.float64)) for n, (names, low, high) in found.items()}


def interval(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of ``q`` with all points of each box, coordinate by coordinate, wide enough for rounding."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1 + SLACK * (np.maximum(np.abs(low), np.abs(high)) @ np.abs(q))
    return low @ up + high @ down - slack, high @ up + low @ down + slack


def _routed(boxes: dict):
    """Every query once for each tile, its own left out, whose interval meets one of its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], []
            for i, (value, home, wants) in enumerate(zip(batch.column("vector"), batch.column("home").to_pylist(), batch.column("wants").to_pylist())):
                q = np.frombuffer(value.as_buffer(), "<i4").astype(np.float64)
                tile, low, high = boxes[len(q)]
                least, most = interval(low, high, q)
                meets = np.zeros(len(tile), bool)
                for w in wants:
                    meets |= (most >= w["low"]) & (least <= w["high"])
                for j in np.flatnonzero(meets):
                    if tile[j] != home:
                        rows.append(i)
                        names.append(tile[j])
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names, pa.string())], [*taken.schema.names, "tile"])

    return run


class Tree:
    """R-tree of one tile: rows in packed order, boxes of leaves and of nodes of FANOUT leaves."""

    def __init__(self, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = _packed(x)
        self.vec_id, self.label, self.x = vec_id[order], label[order], x[order]
        self.largest = float(np.abs(x.astype(np.int64)).max(initial=0))
        self.real, self.whole = self.x.astype(np.float64), self.x.astype(np.int64)
        self.starts = np.arange(0, len(x), LEAF)
        self.low, self.high = (f.reduceat(self.x, self.starts, axis=0).astype(np.float64) for f in (np.minimum, np.maximum))
        self.nodes = np.arange(0, len(self.starts), FANOUT)
        self.node_low, self.node_high = np.minimum.reduceat(self.low, self.nodes, axis=0), np.maximum.reduceat(self.high, self.nodes, axis=0)

    def scores(self, leaf: int, q: np.ndarray) -> np.ndarray:
        rows = slice(self.starts[leaf], self.starts[leaf] + LEAF)
        if self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2.0**52:
            return (self.real[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.whole[rows] @ q

    def search(self, anchor: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int, same: bool) -> list[list[tuple[int, int]]]:
        """For every window the first k ``(-score, vec_id)`` of rows of the same, or of another, label."""
        node_least, node_most = interval(self.node_low, self.node_high, q.astype(np.float64))
        leaf_least, leaf_most = interval(self.low, self.high, q.astype(np.float64))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for low, high in windows:
            queue: list[tuple[float, int, int]] = []
            for node in np.flatnonzero((node_most >= low) & (node_least <= high)):
                heappush(queue, (-node_most[node], 0, int(node)))
            best: list[tuple[int, int]] = []
            while queue:
                bound, is_leaf, at = heappop(queue)
                if len(best) == k and -bound < -best[-1][0]:
                    break
                if not is_leaf:
                    for leaf in range(at * FANOUT, min((at + 1) * FANOUT, len(self.starts))):
                        if leaf_most[leaf] >= low and leaf_least[leaf] <= high:
                            heappush(queue, (-leaf_most[leaf], 1, leaf))
                    continue
                if at not in known:
                    rows = slice(self.starts[at], self.starts[at] + LEAF)
                    fits = ((self.label[rows] == label) == same) & (self.vec_id[rows] != anchor)
                    known[at] = self.scores(at, q)[fits], self.vec_id[rows][fits]
                scores, ids = known[at]
                floor = max(low, -best[-1][0]) if len(best) == k else low
                hit = np.flatnonzero((scores >= floor) & (scores <= high))
                if len(hit) > k:  # no more than k of them, ties by id
                    hit = hit[np.lexsort((ids[hit], -scores[hit]))[:k]]
                if len(hit):
                    best = sorted(best + list(zip((-scores[hit]).tolist(), ids[hit].tolist())))[:k]
            out.append(best)
        return out


def _packed(x: np.ndarray) -> np.ndarray:
    """Order of the rows by which runs of LEAF are near each other: slabs by the first coordinate, then the second, then the third."""
    axes = min(AXES, x.shape[1])
    order, leaves = np.arange(len(x)), -(-len(x) // LEAF)
    runs = [order]
    for axis in range(axes):
        side = round((leaves ** (1 / axes)) + 0.4999)
        split = []
        for run in runs:
            run = run[np.argsort(x[run, axis], kind="stable")]
            step = max(LEAF, -(-len(run) // side // LEAF) * LEAF)
            split += [run[i:i + step] for i in range(0, len(run), step)] if axis < axes - 1 else [run]
        runs = split
    return np.concatenate(runs) if len(x) else order


def _searched(k: int, same: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            tree = Tree(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("vector")))
            for q in queries.select(["qid", "anchor_id", "label", "vector", "wants"]).to_pylist():
                windows = [(w["low"], w["high"]) for w in q["wants"]]
                found = tree.search(q["anchor_id"], q["label"], np.frombuffer(q["vector"], "<i4").astype(np.int64), windows, k, same)
                out += [(q["qid"], q["anchor_id"], w["no"], i, -s) for w, best in zip(q["wants"], found) for s, i in best]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("qid", "anchor_id", "no", "vec_id", "score"), columns, kinds)})

    return run


def search(placed: DataFrame, routed: DataFrame, k: int, same: bool) -> DataFrame:
    """The first k rows of every tile that a query was sent to, for each of its windows."""
    blocks = routed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # at most one row a tile
    queries = routed.join(F.broadcast(blocks), "tile").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    # names of their own: both sides may come from the same table
    queries = queries.select(*[F.col(c).alias(c) for c in ("tile", "block", "qid", "anchor_id", "label", "vector", "wants")])
    rows = placed.join(F.broadcast(blocks), "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "label", "vector")
    return rows.groupBy("tile", "block").cogroup(queries.groupBy("tile", "block")).applyInArrow(_searched(k, same), FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The first k of a search over all tiles, with their rank."""
    order = Window.partitionBy("qid", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, tile: int = TILE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    usable = usable.where("vec_id is not null and label is not null and embedding is not null").withColumn("label", relabelled(F.col("vec_id"), F.col("label")))
    vectors = usable.mapInArrow(_integers(scale), "vec_id long, label int, vector binary, dims int, leading array<int>").dropDuplicates(["vec_id", "label", "vector"])
    placed = written(tiles(written(vectors), tile))
    boxes = directory(placed)

    qid = F.sha2(F.concat_ws("/", F.col("vec_id"), F.col("label"), F.hex("vector")), 256)
    anchors = placed.where(F.col("vec_id") % step == 0).select(qid.alias("qid"), F.col("vec_id").alias("anchor_id"), "label", "vector", F.col("tile").alias("home"))
    wants = lambda low: F.array(F.struct(F.lit(0).alias("no"), low.cast("long").alias("low"), F.lit(MOST).alias("high")))
    nearby = written(search(placed, anchors.withColumn("wants", wants(F.lit(LEAST))).withColumn("tile", F.col("home")), positives, True))
    bound = nearby.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).otherwise(LEAST).alias("bound"))
    asked = anchors.join(bound, "qid", "left").withColumn("wants", wants(F.coalesce("bound", F.lit(LEAST)))).select("qid", "anchor_id", "label", "vector", "home", "wants")
    elsewhere = search(placed, asked.mapInArrow(_routed(boxes), f"{QUERY}, tile string"), positives, True)
    pairs = written(first(nearby.union(elsewhere), positives).select(
        "qid", "anchor_id", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # integers that satisfy LOW * positive <= 100 * negative <= HIGH * positive
    whole = lambda share: F.col("positive_score").cast("decimal(38,0)") * share
    low, high = F.ceil(whole(LOW) / 100).cast("long"), F.floor(whole(HIGH) / 100).cast("long")
    windows = pairs.where("positive_score >= 0").groupBy("qid").agg(F.collect_list(F.struct("no", low.alias("low"), high.alias("high"))).alias("wants"))
    asked = anchors.join(windows, "qid").select("qid", "anchor_id", "label", "vector", F.lit("").alias("home"), "wants")
    found = first(search(placed, asked.mapInArrow(_routed(boxes), f"{QUERY}, tile string"), negatives, False), negatives)
    out = found.join(pairs.select("qid", "no", "positive_id", "positive_score"), ["qid", "no"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= {NEGATIVES}
"""
