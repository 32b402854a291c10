"""Substring dedup: a De Bruijn graph of word windows, compacted to paths, decides which words a document repeats from an earlier one.

A window is ``WIDTH`` consecutive words and an edge of the graph (from its first to its last ``WIDTH - 1`` words), known by two independent 64-bit hashes.

1. Documents of equal words are one: only the one of the smallest doc_id goes on, the others lose all their words (or nothing, below
   ``WIDTH`` words).
2. Anchors.  Equal windows have the same least hash of ``ANCHOR`` consecutive words, about one per five windows.  Only windows whose anchor
   is met in two different texts can be repeated; only their documents go on.  An anchor that several documents of one chunk share
   sends two marks to its group, the documents themselves are spread: a passage in every document is no hot group.
3. Edges.  Per window hash the first source coordinate (doc_id, text, position), the largest doc_id and whether all occurrences have the
   same word before and the same word after, combined map-side.  Edges of one document alone go.
4. Compaction.  Consecutive edges of one source document without a branch between them are a path.  Every document that has one of its edges
   has all of them side by side, so only the two ends of a path are joined back to the occurrences.
5. Verification.  A path is a repeated span of a document if both ends occur there as far apart as at the source coordinates; an end that
   stands alone counts as the window that it is.  Documents with spans are read again and cut.

Nothing is sampled: steps 2 to 4 only leave out windows that cannot be repeated.  Intermediate tables stand in the shared folder.

Defined cases: a null text is empty; a null doc_id is larger than every other, and null ones do not remove each other's words; rows with the same
doc_id do not remove each other's words, and each is returned with its own text's result; words keep their case and marks; documents of fewer
than ``WIDTH`` words keep everything; very long texts are one row (a task holds one at a time with its hashes); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table, written

WIDTH, ANCHOR = 13, 5
#: Windows that a task holds before it passes them on.
CHUNK = 500_000
LARGEST_ID = 2**63 - 1

KEY = "ord long, t long"
SOURCE = ["src", "src_t", "p0"]


def _numbers(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{name} {i}") | 1 for i in range(n)], np.uint64)


WEIGHTS = {name: _numbers(name, WIDTH) for name in ("edge", "check", "anchor", "around")}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(value: pa.Scalar) -> list[bytes]:
    return value.as_buffer().to_pybytes().split() if value.is_valid else []


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two numbers per word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def _combined(column: np.ndarray, name: str, width: int) -> np.ndarray:
    out = np.zeros(len(column) - width + 1, np.uint64)
    for j in range(width):
        out += column[j:j + len(out)] * WEIGHTS[name][j]
    return _mixed(out)


def _anchors_of(h: np.ndarray, width: int) -> np.ndarray:
    """The anchor of every window."""
    runs = _combined(h[:, 0], "anchor", ANCHOR)
    return np.lib.stride_tricks.sliding_window_view(runs, width - ANCHOR + 1).min(axis=1)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests = [], []
        for value in batch.column("text"):
            words = _words(value)
            n.append(len(words))
            digests.append(sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("ord"), batch.column("t"), pa.array(n, pa.int64()), pa.array(digests)], ["doc_id", "ord", "t", "n_words", "sha"])


def _met(chunk: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Anchors of some documents: alone in salt 0; shared ones spread over other salts, with two marks in salt 0."""
    first = {}
    for ord_, t, anchors in chunk:
        if t not in first or ord_ < first[t][0]:
            first[t] = ord_, t, anchors
    docs = list(first.values())
    anchors = np.concatenate([d[2] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
    order = np.argsort(anchors, kind="stable")
    anchors, doc = anchors[order], doc[order]
    ords, ts = np.array([d[0] for d in docs], np.int64)[doc], np.array([d[1] for d in docs], np.int64)[doc]
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    sizes = np.diff(np.r_[starts, len(anchors)])
    shared = np.repeat(sizes > 1, sizes)
    salt = np.where(shared, 1 + _mixed(ts.view(np.uint64)) % np.uint64(1 << 20), 0).astype(np.int32)
    marks = np.r_[starts[sizes > 1], (starts + sizes - 1)[sizes > 1]]
    none = np.r_[np.zeros(len(anchors), bool), np.ones(len(marks), bool)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[anchors, anchors[marks]].view(np.int64)), pa.array(np.r_[salt, np.zeros(len(marks), np.int32)]),
         pa.array(np.r_[ords, ords[marks]], mask=none), pa.array(np.r_[ts, ts[marks]])], ["anchor", "salt", "ord", "t"])


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for ord_, t, value in zip(batch.column("ord").to_pylist(), batch.column("t").to_pylist(), batch.column("text")):
                words = _words(value)
                if len(words) < width:
                    continue
                chunk.append((ord_, t, np.unique(_anchors_of(_hashes(words), width))))
                held += len(words)
                if held >= CHUNK:
                    yield _met(chunk)
                    chunk, held = [], 0
        if chunk:
            yield _met(chunk)

    return run


def _edges(width: int):
    """Windows whose anchor is among the document's ``met`` ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for ord_, t, value, met in zip(batch.column("ord").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("met")):
                h = _hashes(_words(value))
                at = np.flatnonzero(np.isin(_anchors_of(h, width), met.values.to_numpy().view(np.uint64)))
                before, after = np.r_[np.uint64(0), h[:, 0]][at], np.r_[h[:, 0], np.uint64(1)][at + width]
                around = _mixed(before * WEIGHTS["around"][0] + after * WEIGHTS["around"][1])
                e1, e2 = _combined(h[:, 0], "edge", width)[at], _combined(h[:, 1], "check", width)[at]
                parts.append((e1.view(np.int64), e2.view(np.int64), np.full(len(at), ord_), np.full(len(at), t), at.astype(np.int32), around.view(np.int64)))
                held += len(at)
                if held >= CHUNK:
                    yield _stacked(parts)
                    parts, held = [], 0
        if parts:
            yield _stacked(parts)

    return run


def _stacked(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["e1", "e2", "ord", "t", "pos", "around"])


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for value, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = _words(value)
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["start"] + s["len"] + width - 1] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                removed.append(len(words) - int(keep.sum()))
                digests.append(sha256(b" ".join([words[i] for i in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("t"), pa.array(removed, pa.int64()), pa.array(digests)], ["ord", "t", "removed", "cut"])

    return run


def paths(edges: DataFrame) -> DataFrame:
    """Ends of the nonbranching paths: ``e1, e2, src, src_t, p0, len, off``, one row per end (one for a path of a single edge)."""
    along = Window.partitionBy("src", "src_t").orderBy("p")
    goes_on = (F.lag("p").over(along) == F.col("p") - 1) & F.col("plain") & F.lag("plain").over(along)
    placed = edges.withColumn("head", ~F.coalesce(goes_on, F.lit(False)))
    placed = placed.withColumn("p0", F.max(F.when(F.col("head"), F.col("p"))).over(along)).withColumn("tail", F.coalesce(F.lead("head").over(along), F.lit(True)))
    ends = placed.where("head or tail").select("e1", "e2", "src", "src_t", "p0", "p", "head", "tail")
    # a head's tail is the next end of the same source document
    last = F.when(F.col("tail"), F.col("p")).otherwise(F.lead("p").over(along))
    return ends.select("e1", "e2", *SOURCE, (F.when(F.col("head"), last).otherwise(F.col("p")) - F.col("p0") + 1).alias("len"), (F.col("p") - F.col("p0")).alias("off"))


def repeated_spans(docs: DataFrame, leaders: DataFrame, width: int) -> DataFrame:
    """``ord, t, spans`` of every document with windows that start in a document of smaller id."""
    groups = Window.partitionBy("anchor", "salt")
    anchors = docs.mapInArrow(_anchors(width), f"anchor long, salt int, {KEY}")
    met = anchors.select("anchor", "ord", "t", ((F.col("salt") > 0) | (F.min("t").over(groups) < F.max("t").over(groups))).alias("hit"))
    met = met.where("hit and ord is not null").groupBy("ord", "t").agg(F.collect_list("anchor").alias("met"))  # at most the windows of a document
    met = written(met.join(leaders, ["ord", "t"], "left_semi"))
    windows = written(docs.join(met, ["ord", "t"]).select("ord", "t", "text", "met").mapInArrow(_edges(width), f"e1 long, e2 long, {KEY}, pos int, around long"))

    first = F.min(F.struct("ord", "t", "pos"))
    edges = windows.groupBy("e1", "e2").agg(first.alias("o"), F.max("ord").alias("hi"), F.min("around").alias("a0"), F.max("around").alias("a1"))
    edges = edges.where("o.ord < hi").select("e1", "e2", F.col("o.ord").alias("src"), F.col("o.t").alias("src_t"), F.col("o.pos").alias("p"), F.expr("a0 = a1").alias("plain"))
    ends = written(paths(edges))

    found = windows.join(ends, ["e1", "e2"]).where("ord > src").select("ord", "t", (F.col("pos") - F.col("off")).alias("start"), *SOURCE, "len", "off")
    found = found.groupBy("ord", "t", "start", *SOURCE, "len").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    whole = (F.col("a") == 0) & (F.col("b") == F.col("len") - 1)
    span = lambda start, n: F.struct(start.cast("int").alias("start"), n.cast("int").alias("len"))
    alone = F.transform(F.array_distinct(F.array("a", "b")), lambda off: span(F.col("start") + off, F.lit(1)))
    spans = F.when(whole, F.array(span(F.col("start"), F.col("len")))).otherwise(alone)
    # at most the windows of a document
    return written(found.groupBy("ord", "t").agg(F.flatten(F.collect_list(spans)).alias("spans")))


def dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST_ID)).alias("ord"), F.xxhash64(text).alias("t"), text.alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    base = written(docs.mapInArrow(_base, f"doc_id {kind}, {KEY}, n_words long, sha string"))
    least = base.where(F.col("n_words") >= width).groupBy("sha").agg(F.min("ord").alias("least"))
    known = written(base.join(least, "sha", "left"))
    leaders = known.where("ord = least").select("ord", "t").distinct()
    docs = docs.select("ord", "t", "text")
    spans = repeated_spans(docs, leaders, width)
    cut = docs.join(spans, ["ord", "t"]).select("ord", "t", "text", "spans").mapInArrow(_cut(width), f"{KEY}, removed long, cut string")
    out = known.join(cut.dropDuplicates(["ord", "t"]), ["ord", "t"], "left")
    copy = F.coalesce(F.col("least") < F.col("ord"), F.lit(False))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("cut", "sha")).alias("kept_sha256"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p + {WIDTH - 1}], ' ') AS g
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS p FROM d WHERE len(w) >= {WIDTH})),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
r AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + {WIDTH})) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id) n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
