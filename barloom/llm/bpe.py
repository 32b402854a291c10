"""Byte-level BPE: encoding without regular expressions, decoding by offsets.

Pre-tokenisation is vectorised.  A batch of texts becomes one array of codepoint classes; a small automaton over the classes
says where a piece starts.  Its transitions are functions from state to state, and composing functions is associative: the array
is cut into strips, the strips' functions are composed side by side, a scan over strips gives each its first state, and a
second sweep marks the starts.  Each piece then goes through pair merging once and into a bounded cache.

The automaton accepts the same pieces as the pattern of the rank files: contractions, runs of letters, of numbers, of other
signs, each with one leading space, and runs of white space that leave their last character to what follows.

Tokens keep their byte offsets, by which decoding writes every token to its place in one gather.

Defined cases: null and empty texts have no tokens; very long texts are one strip table more, and a very long piece is merged with
a heap; repeated rows are encoded each; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table

# classes; what follows a character is part of its class where the pattern looks ahead
LETTER, NUMBER, OTHER, APOSTROPHE, LEAD, LAST, BLANK, SHORT, LONG, END = range(10)
# states: what the piece so far is
DONE, WORD, DIGITS, SIGNS, QUOTE, SPACE, BLANKS, TAIL = range(8)
#: Code points of White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
STRIP = 256
CHUNK_CHARS = 400_000
CACHED_PIECES = 400_000
ENCODED = "doc_id long, ids array<int>, offsets array<int>"


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here", for each (state, class)."""
    then = np.zeros((8, 10), np.uint8)
    starts = np.ones((8, 10), bool)
    then[:, [LETTER, SHORT, LONG]] = WORD
    then[:, NUMBER] = DIGITS
    then[:, OTHER] = SIGNS
    then[:, APOSTROPHE] = QUOTE
    then[:, LEAD] = SPACE
    then[:, BLANK] = BLANKS
    then[:, [LAST, END]] = DONE
    goes_on = [(WORD, (LETTER, SHORT, LONG)), (DIGITS, (NUMBER,)), (SIGNS, (OTHER, APOSTROPHE)), (QUOTE, (OTHER, APOSTROPHE, SHORT, LONG)),
               (SPACE, (LETTER, NUMBER, OTHER, APOSTROPHE, SHORT, LONG)), (BLANKS, (BLANK,)), (TAIL, (LETTER, SHORT, LONG))]
    for state, classes in goes_on:
        starts[state, list(classes)] = False
    for state in (SIGNS, QUOTE, SPACE):
        then[state, APOSTROPHE] = SIGNS  # not the first of its piece: no contraction
    then[QUOTE, SHORT] = DONE
    then[QUOTE, LONG] = TAIL
    then[TAIL, [LETTER, SHORT, LONG]] = DONE
    return then, starts


THEN, STARTS = _automaton()


@lru_cache(1)
def _base_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[list(WHITE)] = BLANK
    found[ord("'")] = APOSTROPHE
    return found


def _classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each code point; ``ends`` are the places of the separators between texts."""
    cls = _base_classes()[points]
    cls[ends] = END
    blank = cls == BLANK
    filled_next = np.zeros(len(cls), bool)
    filled_next[:-1] = ~blank[1:] & (cls[1:] != END)
    before = blank & filled_next
    cls[before] = np.where(points[before] == 0x20, LEAD, LAST)
    after = np.zeros(len(points), points.dtype)
    after[:-1] = points[1:]
    cls[np.isin(points, [ord(c) for c in "stmd"])] = SHORT
    cls[(((points == ord("r")) | (points == ord("v"))) & (after == ord("e"))) | ((points == ord("l")) & (after == ord("l")))] = LONG
    cls[ends] = END
    return cls


def _piece_starts(cls: np.ndarray) -> np.ndarray:
    """Places where a piece starts, by composing transition functions."""
    strips = -(-len(cls) // STRIP)
    padded = np.full(strips * STRIP, END, np.uint8)
    padded[: len(cls)] = cls
    columns = np.ascontiguousarray(padded.reshape(strips, STRIP).T)
    then, width = THEN.ravel(), THEN.shape[1]
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], strips, axis=1)  # one function a strip, from the identity on
    for column in columns:
        whole = then[whole * width + column]
    reach = 1
    while reach < strips:  # inclusive scan: function of all strips up to this one
        earlier = whole[:, :-reach]
        whole = np.concatenate([whole[:, :reach], np.take_along_axis(whole[:, reach:], earlier, 0)], axis=1)
        reach *= 2
    state = np.empty(strips, np.uint8)
    state[0] = DONE
    state[1:] = whole[DONE, :-1]
    marks = np.empty(columns.shape, bool)
    starts = STARTS.ravel()
    for k, column in enumerate(columns):
        at = state * width + column
        marks[k] = starts[at]
        state = then[at]
    return np.flatnonzero(marks.T.ravel()[: len(cls)])


class Codec:
    """Ranks of one vocabulary with a bounded cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of least rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i is piece[i:after[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or after[j] != end:
                continue  # one of the two has been merged since
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i:after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:end])) is not None:
                heapq.heappush(heap, (r, b, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = _piece_starts(_classes(points, ends))
        cache, ids, counts = self.cache, [], []
        places, at = starts.tolist(), np.searchsorted(starts, ends).tolist()
        first = 0
        for last in at:  # the separator is a piece of its own
            before = len(ids)
            for a, b in zip(places[first:last], places[first + 1:last + 1]):
                piece = joined[a:b]
                if (known := cache.get(piece)) is None:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    known = cache[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
                ids += known
            counts.append(len(ids) - before)
            first = last + 1
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of a text from its tokens and where each of them starts."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        places = np.arange(int(offsets[-1] + lengths[-1]))
        return self.pool[np.repeat(self.first[ids] - offsets, lengths) + places].tobytes()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            start, chars, held = 0, 0, []
            for i in range(len(texts) + 1):
                if i == len(texts) or chars >= CHUNK_CHARS:
                    if held:
                        ids, counts = own.encode(held)
                        ends = np.concatenate([[0], np.cumsum(counts)])
                        lengths = own.lengths[ids]
                        total = np.concatenate([[0], np.cumsum(lengths)])
                        offsets = total[:-1] - np.repeat(total[ends[:-1]], counts)
                        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, offsets)]
                        yield pa.RecordBatch.from_arrays([doc_ids.slice(start, i - start), *lists], ["doc_id", "ids", "offsets"])
                    start, chars, held = i, 0, []
                if i < len(texts):
                    held.append(texts[i].as_py() or "")
                    chars += len(held[-1]) + 1

    return encode


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, ids, offsets``: the tokens of every whole text and the byte offset of each.  ``ranks`` is a rank file's path."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_encoder(ranks), ENCODED)


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    ends = ends - ends[0]
    return (values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, decoded`` (bytes) from ``doc_id, ids, offsets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            told = [own.decode(i, o) for i, o in zip(_lists(batch.column("ids")), _lists(batch.column("offsets")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, decoded binary")


def _digests(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids, offsets in zip(_lists(batch.column("ids")), _lists(batch.column("offsets"))):
                counts.append(len(ids))
                of_ids.append(sha256(" ".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(sha256(own.decode(ids, offsets)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    ranks = ranks or default_ranks()
    tokens = encode(table(spark, sf_dir, "documents"), ranks)
    return tokens.mapInArrow(_digests(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, offsets`` of every document that reached the last stage."""
    return encode(docs, default_ranks())
