"""Token files: ids in patched frame-of-reference blocks, in document order, with indexes.

Format.  A shard is the documents of one range of ids.  It is a file of segments; a segment holds whole documents, at least
``SEGMENT_IDS`` ids unless it is the last, and has: ``shard``, ``segment``, ``first`` (ids of the shard before it), ``n_ids``,
``doc_ids``, ``doc_lengths`` and ``payload``.  The container of the rows is Parquet without compression, because that can be
written to any store Spark can write to, with its commit protocol: a lost executor leaves no half file.

``payload`` (little-endian): ``uint32`` count of ids, ``uint32`` count of blocks, ``uint32`` start of every block and the end of the last
(from the payload's begin), then the blocks.  A block of up to ``BLOCK_IDS`` ids: ``uint32`` minimum, ``uint16`` ids, ``uint16``
exceptions, ``uint8`` width; the ids less the minimum packed at that width (low bits first); then ``uint16`` places and ``uint32`` high parts
of the exceptions, the ids that need more bits.  The width is what the ``PERCENTILE``-th largest of the block needs.

Defined cases: null and empty texts are one end id; documents are ordered by id (null first), repeated ids by a hash of the text;
a very long text is one segment; an empty table gives an empty file; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.session import ensure_checkpoint_dir

BLOCK_IDS = 256
PERCENTILE = 90
SEGMENT_IDS = 65_536
END_ID = 2
CHUNK_CHARS = 400_000
CACHED_WORDS = 1_400_000
#: Words of printable ASCII and composed Latin letters, where lower case is a matter of single letters and the vocabulary's rule is PIECE.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+").findall
#: What special tokens begin with, and what the last id of a piece ends in.
SPECIAL, LAST = "<|", "</w>"
HEAD = struct.Struct("<IHHB")
SEGMENTS = "shard int, segment int, first long, n_ids long, doc_ids array<long>, doc_lengths array<int>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Payload of one segment."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    grid = np.empty(blocks * BLOCK_IDS, np.int64)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK_IDS)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    rank = (BLOCK_IDS * PERCENTILE + 99) // 100 - 1
    widths = np.ceil(np.log2(np.partition(rest, rank, axis=1)[:, rank] + 1)).astype(np.int64) if blocks else np.zeros(0, np.int64)
    high = rest >> widths[:, None]
    packed: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK_IDS, 32)
        lines = np.packbits(bits[:, :, :width].reshape(len(rows), BLOCK_IDS * width), axis=1, bitorder="little")
        for row, line in zip(rows.tolist(), lines):
            packed[row] = line.tobytes()
    body, starts, at = [], [], 8 + 4 * (blocks + 1)
    for k in range(blocks):
        count = min(BLOCK_IDS, n - k * BLOCK_IDS)
        places = np.flatnonzero(high[k, :count])
        block = b"".join((HEAD.pack(int(low[k]), count, len(places), int(widths[k])), packed[k],
                          places.astype("<u2").tobytes(), high[k, places].astype("<u4").tobytes()))
        starts.append(at)
        body.append(block)
        at += len(block)
    return struct.pack("<II", n, blocks) + np.array([*starts, at], "<u4").tobytes() + b"".join(body)


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """Ids of some blocks of a segment (of all by default), by the index of block starts."""
    _, blocks = struct.unpack_from("<II", payload)
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u4", last_block - first_block, 8 + 4 * first_block).astype(np.int64)
    low, count, exceptions, width = (np.array(x, np.int64) for x in zip(*(HEAD.unpack_from(payload, s) for s in starts.tolist())))
    body = starts + HEAD.size
    grid = np.zeros((len(starts), BLOCK_IDS), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        lines = raw[body[rows][:, None] + np.arange(BLOCK_IDS * w // 8)]
        bits = np.zeros((len(rows), BLOCK_IDS, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(rows), BLOCK_IDS, w)
        grid[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    block = np.repeat(np.arange(len(starts)), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = body + BLOCK_IDS * width // 8
    at = lists[block] + 2 * nth
    places = raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8
    at = (lists + 2 * exceptions)[block] + 4 * nth
    high = sum(raw[at + i].astype(np.int64) << 8 * i for i in range(4))
    grid[block, places] += high << width[block]
    grid += low[:, None]
    return grid[np.arange(BLOCK_IDS) < count[:, None]]


class Words(dict):
    """Ids of words as bytes; a word that is looked up for the first time is noted in ``new`` and stands empty until learnt."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.new.append(word)
        self[word] = b""
        return b""


class Encoder:
    """The library's tokenizer behind a bounded cache of words.

    The vocabulary's own rules never join text across a space or line end, so the parts between them can be encoded one by one.
    Special tokens that stand in a text get their ids, as by the library's defaults; none of them holds a space.
    They also lower-case, and split runs of letters, digits and signs, so a word of Latin letters and ASCII shares the entries of its pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words()
        self.end = np.array([END_ID], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(LAST)]] = True

    def _learn(self) -> None:
        """Encode the new words: the pieces of most in one call, where every piece has one last id; others so that the library says which id is whose."""
        words, split, pieces, plain = self.words, {}, {}, []
        for word in words.new:
            if LATIN(word) and SPECIAL not in word:
                split[word] = parts = PIECE(word.lower())
                for part in parts:
                    if not words.get(part):
                        pieces[part] = None
            elif word:
                plain.append(word)
        asked = list(pieces)
        # the short form of an encoding has no places in the text
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(asked)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(asked):
            self._note(asked, ids, ends)
        else:
            plain += asked
        found = self.tokenizer.encode(plain, is_pretokenized=True, add_special_tokens=False)
        self._note(plain, np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(plain)), side="right"))
        for word, parts in split.items():
            words[word] = b"".join([words[p] for p in parts])
        words.new = []

    def _note(self, asked: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        packed, at = ids.tobytes(), 0
        for word, end in zip(asked, (4 * ends).tolist()):
            self.words[word] = packed[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known = self.words.__getitem__
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        packed = [b"".join(map(known, p)) for p in parts]
        if self.words.new:
            self._learn()
            packed = [b"".join(map(known, p)) for p in parts]
        return [np.frombuffer(ids + self.end, "<u4") for ids in packed]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            chars += len(texts[-1]) + 1
            if chars >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            values = [[shard], [segment], [first], [size], [doc_ids], [lengths], [pack(np.concatenate(held))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for ids, texts in _chunks(batches):
            for doc_id, tokens in zip(ids, encoder(path).encode(texts)):
                doc_ids.append(doc_id)
                lengths.append(len(tokens))
                held.append(tokens.astype(np.int64))
                size += len(tokens)
                if size >= SEGMENT_IDS:
                    yield row()
                    segment, first = segment + 1, first + size
                    doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield row()

    return write


def write(docs: DataFrame, vocabulary: str, folder: str) -> None:
    """Encode whole texts in ascending order of ``doc_id`` and write them as shards under ``folder``."""
    placed = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", "xxhash64(text) as h")
    ordered = placed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(_writer(vocabulary), SEGMENTS).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``start``, the ids of all shards and segments before each."""
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return segments.join(F.broadcast(starts), "shard").withColumn("start", F.col("before") + F.col("first"))


def documents(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the packed ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch.column("payload")[row].as_py()).astype("<u4")
                lengths = batch.column("doc_lengths")[row].values.to_numpy()
                ends = np.cumsum(lengths, dtype=np.int64)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                start = batch.column("start")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(start + ends - lengths, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("doc_ids", "doc_lengths", "payload", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_tokenfile(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid4().hex}"
    write(table(spark, sf_dir, "documents"), vocabulary, folder)
    return documents(read(spark, folder))
