"""Near-duplicate embeddings: an exact range join in the metric of unit vectors.

Cosine ``COSINE`` or more means a Euclidean distance of at most ``RADIUS`` between unit vectors.  Pivots, some of the vectors
themselves, partition space: a vector lives in the cell of its nearest pivot.  Cells are cut into blocks of at most about ``TILE`` vectors, and
blocks are packed in the order of cells into shares, a row each of at most about ``SHARE_BYTES``.  Every vector is in one share, and a pair of
shares is one task, which compares their blocks two by two, by matrix products.  Of two blocks only those vectors are compared that the triangle
inequality leaves: their distance to the other cell's pivot is at most the other block's covering radius plus ``RADIUS``, and their
distance to the plane halfway between the two pivots at most ``RADIUS``.  Nothing else is left out, so the join is exact.

Shares are read by the tasks, not dealt out again, so neither the shuffle nor a task's memory grows with the number of cells a vector may have links in;
a crowded cell is many blocks.  A task returns, for every vector with a link, its number of links and a vector it is connected with inside the
task's two shares: enough for counts and components.  Links are used up block by block and never listed.

Products are taken in single precision first; those within its rounding of ``COSINE`` are taken again in double precision.

Vectors with the same components are one vector with a multiplicity from the start.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even
with their copies; vectors of different length never link; rows with the same vec_id count as rows; a null vec_id is last in order; ties at the
threshold count as links, and dot products that fall within rounding of it are summed again exactly; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import aside, components, table

COSINE = 0.95
RADIUS = sqrt(2 - 2 * COSINE)
SLACK = 1e-9
TILE = 2048
#: Bounds what goes to every executor: so many vectors.
MAX_PIVOTS = 2048
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shares at least, if there are as many blocks, and bytes of a share at most, its components as doubles.
SHARES = 24
SHARE_BYTES = 32_000_000
#: Vectors that are compared with a block at once.
ROWS = 512


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=-1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=-1, keepdims=True))


def _vectors(code: str):
    """The components as bytes of type ``code``, which holds them exactly, and a digest of their doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, packed = [], []
            for value in batch.column("embedding"):
                values = value.values if value.is_valid else None
                raw = None
                if values is not None and len(values) and not values.null_count:
                    raw = values.to_numpy().astype(np.float64) + 0.0  # one zero, not two
                    if not np.isfinite(raw).all() or not raw.any():
                        raw = None
                packed.append(None if raw is None else raw.astype(code).tobytes())
                digests.append(None if raw is None else blake2b(raw.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "digest", "vector"])

    return run


def _homes(pivots: dict[int, np.ndarray], code: str):
    """The ``cell`` of every vector; cells are numbered over all lengths, and a length without pivots is one cell."""
    first = _first_cells(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x.as_buffer(), code) for x in batch.column("vector")]
            lengths = np.array([len(x) for x in raw], np.int64)
            cells = -lengths
            for n in set(lengths.tolist()) & set(pivots):
                own = np.flatnonzero(lengths == n)
                for start in range(0, len(own), ROWS):
                    part = own[start:start + ROWS]
                    units = _unit(np.stack([raw[i] for i in part]).astype(np.float64))
                    cells[part] = first[n] + (units @ pivots[n].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _first_cells(pivots: dict[int, np.ndarray]) -> dict[int, int]:
    out, at = {}, 0
    for length, rows in sorted(pivots.items()):
        out[length], at = at, at + len(rows)
    return out


def shares_of(cells: list[tuple[int, int, int]]) -> tuple[dict[int, list[int]], int]:
    """The share of each block of each cell, and the number of shares, from ``(cell, vectors, length)``."""
    sizes = {}
    for cell, count, length in cells:
        rows = max(1, min(TILE, SHARE_BYTES // (8 * length)))
        sizes[cell] = (-(-count // rows), 8 * length * count)
    total, blocks = sum(x for _, x in sizes.values()), sum(n for n, _ in sizes.values())
    wanted = max(min(SHARES, blocks), -(-total // SHARE_BYTES), 1)
    out, before = {}, 0.0
    for cell, (n, x) in sorted(sizes.items()):
        out[cell] = [min(wanted - 1, int((before + (k + 0.5) * x / n) * wanted / total)) for k in range(n)]
        before += x
    return out, wanted


def _placed(share_of: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            blocks = [int.from_bytes(x.as_buffer().to_pybytes()[:8], "little") % len(share_of[c]) for x, c in zip(batch.column("digest"), cells)]
            shares = [share_of[c][k] for c, k in zip(cells, blocks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int32()), pa.array(shares, pa.int32())], [*batch.schema.names, "block", "share"])

    return run


PACKED = "share int, cells array<int>, sizes array<int>, lengths array<int>, digests binary, copies binary, vectors binary"


def _pack(code: str):
    """A share as one row: its blocks one after the other."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("cell", "ascending"), ("block", "ascending")])
        cells, blocks = rows.column("cell").to_numpy(), rows.column("block").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(cells) != 0) | (np.diff(blocks) != 0)]))
        vectors = [x.as_buffer() for x in rows.column("vector")]
        made = {
            "share": [rows.column("share")[0].as_py()], "cells": [cells[starts].tolist()], "sizes": [np.diff([*starts, len(cells)]).tolist()],
            "lengths": [[vectors[i].size // np.dtype(code).itemsize for i in starts]], "digests": [b"".join(x.as_py() for x in rows.column("digest"))],
            "copies": [rows.column("copies").to_numpy().astype(np.int64).tobytes()], "vectors": [b"".join(vectors)]}
        kinds = [pa.int32(), *3 * [pa.list_(pa.int32())], *3 * [pa.binary()]]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(made.items(), kinds)})

    return run


def shares(homes: DataFrame, code: str) -> tuple[DataFrame, int]:
    """Every vector once, in rows of a share each, and the number of shares."""
    counted = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vector")).alias("bytes"))
    share_of, count = shares_of([(r["cell"], r["n"], r["bytes"] // np.dtype(code).itemsize) for r in counted.collect()])  # MAX_PIVOTS cells, and a cell a length
    placed = homes.mapInArrow(_placed(share_of), "digest binary, vector binary, copies long, cell int, block int, share int")
    # a share a partition
    return placed.groupBy("share").applyInArrow(_pack(code), PACKED).repartitionByRange(count, "share").coalesce(count), count


def linked(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of two sets of unit vectors that have a cosine of COSINE or more, as pairs of indices."""
    rough = left.astype(np.float32) @ right.astype(np.float32).T
    slack = np.float32((left.shape[1] + 8) * 2.0**-23)  # twice the largest error of a product of unit vectors
    one, two = np.nonzero(rough >= np.float32(COSINE) - slack)
    open_ = np.flatnonzero(rough[one, two] <= np.float32(COSINE) + slack)
    hit = np.ones(len(one), bool)
    for start in range(0, len(open_), 4096):
        part = open_[start:start + 4096]
        dots = np.einsum("ij,ij->i", left[one[part]], right[two[part]])
        hit[part] = dots >= COSINE
        for k in part[np.abs(dots - COSINE) < 1e-13]:
            hit[k] = fsum(left[one[k]] * right[two[k]]) >= COSINE
    return one[hit], two[hit]


class _Blocks:
    """The blocks of a share: their rows from ``at`` on, cells and unit vectors."""

    def __init__(self, row: dict, code: str, at: int):
        self.copies = np.frombuffer(row["copies"], np.int64)
        self.digests = pa.Array.from_buffers(pa.binary(16), len(self.copies), [None, pa.py_buffer(row["digests"])])
        vectors, self.blocks, begin = np.frombuffer(row["vectors"], code), [], 0
        for cell, size, length in zip(row["cells"], row["sizes"], row["lengths"]):
            units = _unit(vectors[begin:begin + size * length].reshape(size, length).astype(np.float64))
            self.blocks.append((np.arange(at, at + size), cell, units))
            begin, at = begin + size * length, at + size


def _join(labels: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``labels``, the least connected row of each row, after further links."""
    while True:
        x, y = labels[one], labels[two]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels = nearer


def _tile(pivots: dict[int, np.ndarray], code: str):
    """``digest, n, root`` of the vectors with links in two shares, or in one."""
    first = _first_cells(pivots)

    def left(units: np.ndarray, cell: int, other: int, other_units: np.ndarray) -> np.ndarray:
        """The rows of a block that may have links in a block of another cell."""
        points = pivots[units.shape[1]]
        mine, its = points[cell - first[units.shape[1]]], points[other - first[units.shape[1]]]
        radius = sqrt(max(0.0, 2 - 2 * (other_units @ its).min()))
        gap, dots = sqrt(max(0.0, 2 - 2 * float(mine @ its))), units @ its
        near_block = np.sqrt(np.maximum(2 - 2 * dots, 0)) <= radius + RADIUS + SLACK
        return np.flatnonzero(near_block & (units @ mine - dots <= (RADIUS + SLACK) * gap + SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["share"] == row["its_share"]
                a = _Blocks(row, code, 0)
                b = a if same else _Blocks({k.removeprefix("its_"): v for k, v in row.items() if k.startswith("its_")}, code, len(a.copies))
                copies = a.copies if same else np.concatenate([a.copies, b.copies])
                digests = a.digests if same else pa.concat_arrays([a.digests, b.digests])
                n_links, labels = np.zeros(len(copies)), np.arange(len(copies))
                for i, (ones, cell, units) in enumerate(a.blocks):
                    for twos, other, others in b.blocks[i if same else 0:]:
                        if units.shape[1] != others.shape[1]:
                            continue
                        own = twos is ones
                        x = y = slice(None)
                        if cell != other:
                            x, y = left(units, cell, other, others), left(others, other, cell, units)
                        rows_x, rows_y, units_x, units_y = ones[x], twos[y], units[x], others[y]
                        for start in range(0, len(rows_x) if len(rows_y) else 0, ROWS):
                            one, two = linked(units_x[start:start + ROWS], units_y)
                            one, two = rows_x[start + one], rows_y[two]
                            if own:
                                one, two = one[one < two], two[one < two]
                            if len(one):
                                np.add.at(n_links, one, copies[two])
                                np.add.at(n_links, two, copies[one])
                                labels = _join(labels, one, two)
                have = np.flatnonzero(n_links)
                yield pa.RecordBatch.from_arrays(
                    [digests.take(pa.array(have)).cast(pa.binary()), pa.array(n_links[have].astype(np.int64)), digests.take(pa.array(labels[have])).cast(pa.binary())],
                    ["digest", "n", "root"])

    return run


@contextmanager
def _one_row_at_once(spark: SparkSession) -> Iterator[None]:
    """Python gets rows one by one: two shares are enough for a task's memory."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "1")
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def links(embeddings: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    code = "<f4" if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    read = embeddings.select("vec_id", "embedding").mapInArrow(_vectors(code), f"vec_id {kind}, digest binary, vector binary")
    rows = aside(read.select("vec_id", "digest"))
    reps = aside(read.where("digest is not null").groupBy("digest").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies")))
    count = max(1, min(MAX_PIVOTS, -(-reps.count() // TILE)))
    pivots: dict[int, list[np.ndarray]] = {}
    for r in reps.select("digest", "vector").orderBy(F.xxhash64("digest"), "digest").limit(count).collect():
        v = _unit(np.frombuffer(bytes(r["vector"]), code).astype(np.float64))
        pivots.setdefault(len(v), []).append(v)
    stacked = {n: np.stack(v) for n, v in pivots.items()}
    homes = aside(reps.select("digest", "vector", "copies").mapInArrow(_homes(stacked, code), "digest binary, vector binary, copies long, cell int"))
    packed, _ = shares(homes, code)
    packed = aside(packed)
    its = packed.select(*(F.col(c).alias(f"its_{c}") for c in packed.columns))
    pairs = packed.crossJoin(its).where(F.col("share") <= F.col("its_share"))
    with _one_row_at_once(spark):
        found = aside(pairs.mapInArrow(_tile(stacked, code), "digest binary, n long, root binary"))
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("digest").agg(F.sum("n").alias("n"))
    known = reps.select("digest", "copies").join(degrees, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    known = known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    placed = rows.select("vec_id", "digest").where("digest is not null").join(known, "digest")
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = placed.join(least, "root").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
n AS MATERIALIZED (SELECT vec_id, rn, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE ok),
l AS MATERIALIZED (SELECT a.rn AS a, b.rn AS b FROM n a JOIN n b ON a.rn <> b.rn AND len(a.e) = len(b.e)
      AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
r AS (SELECT rn AS a, rn AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.rn) AS n_links,
       coalesce((SELECT min(x.vec_id) FROM r JOIN v x ON x.rn = r.b WHERE r.a = v.rn), v.vec_id) AS component_id,
       v.vec_id IS NOT DISTINCT FROM coalesce((SELECT min(x.vec_id) FROM r JOIN v x ON x.rn = r.b WHERE r.a = v.rn), v.vec_id) AS kept
FROM v
"""
