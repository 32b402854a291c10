"""Near-duplicates by order MinHash, verified by banded alignment.

Words are runs of letters and digits, lower-cased; shingles are ``K`` words, labelled with how often they have occurred before
in the text.  For each of ``SKETCHES`` hash functions the ``ORDERED`` least labelled shingles, put back into text order, make one
sketch.  Two texts meet where a sketch is equal, which needs the same shingles in the same order: sensitive to edits and moves.
``K``, ``ORDERED`` and ``SKETCHES`` follow from the recall wanted at ``SIMILARITY``: words replaced at random leave s^K / (2 - s^K) of the
shingles equal, 0.34 at 0.8, so that 99 % of such pairs meet.

Texts of few words meet exactly.  ``d`` edits leave one of ``d + 1`` even pieces of the longer text whole, which has three words or more from
10 words on and two below, so texts of up to ``SHORT`` words also have each run of three words (two, up to 9 words) as a key.

A pair that meets is linked if its words align with an edit similarity (one less edits over the longer length) of
``SIMILARITY`` or more, inside a band around the diagonal as wide as that similarity allows.  Before the word lists are fetched, a signature that
every bucket row carries, ``BITS`` min-wise bits of the labelled words, rules out pairs that differ in more than ``UNLIKE`` of them (a pair at
``SIMILARITY`` does with a probability of 1e-5 at most); of the others, a bound by the words in common rejects most before the alignment.
In the later rounds two more tests come first.  ``BITS`` parities of the labelled words differ in two places an edit at most, which rules out most
short texts that share some runs and never a pair of ``SIMILARITY``.  And a pair of texts is judged in the bucket of the first hash function
whose sketches are equal, or in their buckets of runs if there is none, not in all buckets that they share.
The pairs to align are dealt out in tiles by bucket, and a tile gets the words of a text once (``judged``).

Texts with the same words are one class from the start and are never paired.  Inside a bucket of equal sketches all members are
compared with one leader, not with each other.  The first rounds use a few hash functions, so that most copies are joined
before the other buckets are looked at; whoever is in the leader's component already is not compared again.  A pair of components in
a bucket is done when all members of one of them have led, so all but the component with most members left go on sending leaders, about
``MORE`` times as many a round, drawn by a hash that differs from bucket to bucket.  A bucket of n copies costs n comparisons,
different texts that share a sketch are all compared, and the rounds follow the logarithm of their number.
Groups are the connected components of the links.

Defined cases: a null text counts as empty; texts without words are grouped by the exact text, texts of fewer than ``K`` words have
one shingle of all words; repeated rows are members of the same class each; of a group the smallest ``doc_id`` stays (null
last, equal ids by a hash of the row); equal rows share the verdict, and ``keep_one`` leaves one of them; extra columns stay
out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import aside, components, table, whole_row

K = 3
SIMILARITY = 0.8
SKETCHES = 40
ORDERED = 2
#: Words of a text up to which its runs of words are keys: all pairs whose shorter text has up to SIMILARITY of it meet.
SHORT = 50
#: (hash functions, leaders a bucket) of the first rounds; later rounds use all functions, runs of short texts too, and MORE times as many leaders.
FIRST_ROUNDS = ((4, 1), (12, 1), (SKETCHES, 1))
MORE = 8
#: Pairs that are judged together.
TILE = 1024
#: Hashes held at once while sketching.
WIDE = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
SALTS = np.array([int.from_bytes(blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(SKETCHES)], np.uint64)
FEATURES = "digest binary, n_words int, sketches array<long>, s0 long, s1 long, words binary"
#: Functions of the signature of a text's words, and how many of its bits two texts of SIMILARITY may differ in.
BITS, UNLIKE = 128, 40
FACTORS, TERMS = (np.array([int.from_bytes(blake2b(bytes([i, k]), digest_size=4).digest(), "little") | k for i in range(BITS)], np.uint32)[:, None] for k in (1, 0))

_KEEP = np.zeros(256, bool)  # bytes of words: ASCII letters and digits, and all of longer characters
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of every word of a text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    keep = _KEEP[raw]
    if not keep.any():
        return np.zeros(0, np.uint32)
    edge = np.diff(keep.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = raw[keep].astype(np.uint64)
    first = np.cumsum(ends - starts) - (ends - starts)
    place = np.arange(len(letters)) - np.repeat(first, ends - starts)
    sums = np.add.reduceat(_mix(letters + place.astype(np.uint64) * np.uint64(257) + np.uint64(1)), first)
    return (_mix(sums) >> np.uint64(32)).astype(np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the labelled shingles in text order."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k, wide = min(K, n), words.astype(np.uint64)
    plain = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        plain = _mix(plain * ODD + wide[i:n - k + 1 + i] + np.uint64(i + 1))
    order = np.argsort(plain, kind="stable")
    ranked = plain[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if fresh.all():
        return plain
    at = np.arange(len(ranked))
    seen = np.empty(len(ranked), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(seen > 0, _mix(plain + seen * ODD), plain)


def sketches(labelled: np.ndarray) -> np.ndarray:
    """One 64-bit key a hash function: its least shingles in text order."""
    few, n = min(ORDERED, len(labelled)), len(labelled)
    keys = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    at_once = max(1, WIDE // n)  # hash functions
    for first in range(0, SKETCHES, at_once):
        salts = SALTS[first:first + at_once, None]
        hashed = (labelled ^ salts) * (salts | np.uint64(1))
        hashed ^= hashed >> np.uint64(31)
        rows = np.arange(len(salts))
        least = np.empty((len(salts), few), np.int64)
        for k in range(few):
            least[:, k] = hashed.argmin(axis=1)
            hashed[rows, least[:, k]] = np.uint64(2**64 - 1)
        least.sort(axis=1)
        for k in range(few):
            keys[first:first + at_once] = _mix(keys[first:first + at_once] * ODD + labelled[least[:, k]])
    return keys.view(np.int64)


def runs(words: np.ndarray) -> np.ndarray:
    """Keys of a short text: a pair of them with SIMILARITY or more has one in common."""
    n, wide = len(words), words.astype(np.uint64)
    keys = []
    for k in (2,) * (4 <= n < 10) + (3,) * (n >= 8):
        plain = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            plain = _mix(plain * ODD + wide[i:n - k + 1 + i] + np.uint64(i + 1))
        keys.append(plain)
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.zeros(0, np.int64)


def _labelled(words: np.ndarray) -> np.ndarray:
    """A hash of every word and of how often it has occurred before, sorted by word."""
    ranked, at = np.sort(words), np.arange(len(words))
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    seen = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return _mix(ranked.astype(np.uint64) * ODD + seen.astype(np.uint64))


def parities(words: np.ndarray) -> np.ndarray:
    """BITS parities of the labelled words, as two 64-bit numbers: an edit takes one labelled word, adds one, or both, so it changes two at most."""
    if len(words) == 0:
        return np.zeros(2, np.int64)
    counts = np.bincount((_labelled(words) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signature(words: np.ndarray) -> np.ndarray:
    """BITS bits of min-wise hashing over the words, each labelled with how often it has occurred before, as two 64-bit numbers.

    SIMILARITY leaves at least 2/3 of the labelled words of both texts in common, so 5/6 of the bits agree, 107 of 128 with a deviation of 4.
    """
    n = len(words)
    if n == 0:
        return np.zeros(2, np.int64)
    labelled = (_labelled(words) >> np.uint64(32)).astype(np.uint32)
    least, step = np.empty(BITS, np.uint32), max(1, WIDE // n)
    for first in range(0, BITS, step):
        part = slice(first, first + step)
        least[part] = (labelled * FACTORS[part] + TERMS[part]).min(axis=1)
    bits = _mix(least.astype(np.uint64) + np.arange(1, BITS + 1, dtype=np.uint64) * ODD) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def keys_of(words: np.ndarray) -> np.ndarray:
    """All keys of a text: its sketches by hash function, then the runs if it is short."""
    if len(words) == 0:
        return np.zeros(0, np.int64)
    made = sketches(shingles(words))
    return np.concatenate([made, runs(words)]) if len(words) <= SHORT else made


def _edits_in_band(a: list[int], b: list[int], band: int) -> int | None:
    """Edits between two word lists if at most ``band``, else None; only cells within ``band`` of the diagonal are looked at.

    Columns of the alignment table are bit vectors of the differences between neighbouring cells.  Bit ``i`` of column ``j`` is row
    ``j - band + i``, so the window slides along the diagonal.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    whole = (1 << 2 * band + 1) - 1
    top = 1 << 2 * band
    up, down = whole ^ ((1 << band) - 1), 0  # the first column counts 1, 2, 3 ...
    score = min(band, n)  # of the lowest cell of the window
    for j in range(1, m + 1):
        equal = places.get(b[j - 1], 0)
        shift = j - band - 1
        equal = (equal >> shift if shift >= 0 else equal << -shift) & whole
        level = (((equal & up) + up) ^ up | equal | down) & whole
        right_up = down | whole & ~(level | up)
        right_down = level & up
        if j + band <= n:
            score += not level & top
            if score > 2 * band + m - n:  # more than the columns left can take back
                return None
        else:
            lowest = 1 << n - j + band
            score += bool(right_up & lowest) - bool(right_down & lowest)
        level >>= 1
        up = right_down | whole & ~(level | right_up)
        down = level & right_up
    return score if score <= band else None


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits (insert, drop, replace) between two texts, or None if more than ``most``: bands that grow up to that width."""
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(unlike[0]) if len(unlike) else short
    one, two = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    if not one or not two:
        found = max(len(one), len(two))
        return found if found <= most else None
    band = min(most, max(16, abs(len(one) - len(two))))
    while True:
        found = _edits_in_band(one, two, band)
        if found is not None or band >= most:
            return found
        band = min(most, 4 * band)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts, as word hashes, have an edit similarity of SIMILARITY or more."""
    longer = max(len(a), len(b))
    most = int((1 - SIMILARITY) * longer + 1e-9)
    # no alignment matches more words than the two bags share
    values, counts = np.unique(a, return_counts=True)
    ordered = np.sort(b)
    shared = np.minimum(counts, np.searchsorted(ordered, values, "right") - np.searchsorted(ordered, values, "left")).sum()
    return longer - shared <= most and edits(a, b, most) is not None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.column("text")
            for start in range(0, len(texts), 256):
                part = batch.slice(start, 256)
                digests, counts, keys, kept, signs = [], [], [], [], []
                for value in part.column("text"):
                    text = value.as_py() or ""
                    words = word_hashes(text)
                    counts.append(len(words))
                    digests.append(blake2b(words.tobytes() if len(words) else b"=" + text.encode("utf-8", "replace"), digest_size=16).digest())
                    keys.append(keys_of(words))
                    signs.append(signature(words))
                    kept.append(words.tobytes())
                ends = np.cumsum([0, *map(len, keys)])
                sign = np.stack(signs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys))),
                     pa.array(sign[:, 0]), pa.array(sign[:, 1]), pa.array(kept, pa.binary())],
                    ["doc_id", "h", "digest", "n_words", "sketches", "s0", "s1", "words"])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, h, digest, n_words, sketches, s0, s1, words`` of every row: all that the links need, without the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", "text", F.xxhash64("*").alias("h"))
    return held.mapInArrow(_features, f"doc_id {kind}, h long, {FEATURES}")


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            made = [parities(np.frombuffer(x.as_buffer(), np.uint32)) for x in batch.column("words")]
            made = np.stack(made) if made else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made[:, 0]), pa.array(made[:, 1])], [*batch.schema.names, "p0", "p1"])


def _judge(rows: pa.Table) -> pa.Table:
    """The alike pairs of a tile: its rows are pairs ``a, b`` and texts ``a, words``."""
    texts = rows.filter(pc.is_valid(rows.column("words")))
    held = {x.as_py(): np.frombuffer(w.as_buffer(), np.uint32) for x, w in zip(texts.column("a"), texts.column("words"))}
    pairs = rows.filter(pc.is_null(rows.column("words"))).select(["a", "b"])
    with np.errstate(over="ignore"):
        hit = [alike(held[x], held[y]) for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())]
    return pairs.filter(pa.array(hit, pa.bool_()))


def judged(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The alike ones of ``pairs(a, b, sketch)``, a table set aside, by the ``words`` of every ``digest``.

    Pairs are dealt out in tiles of about ``TILE``, and a tile gets the words of each of its texts once.  Small buckets share tiles; a bucket of
    many pairs is cut by a hash of either side, so that texts which all meet each other are not sent once a pair.
    """
    tiles = max(1, pairs.count() // TILE)
    crowded = pairs.groupBy("sketch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * TILE)
    crowded = crowded.select("sketch", F.ceil(F.sqrt(F.col("n") / TILE)).alias("cuts"))  # one row for 2 * TILE pairs at most
    cell = F.xxhash64("sketch", F.pmod(F.xxhash64("a"), "cuts"), F.pmod(F.xxhash64("b"), "cuts"))
    tile = F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("sketch"), F.lit(tiles))).otherwise(cell)
    dealt = pairs.join(F.broadcast(crowded), "sketch", "left").select(tile.alias("tile"), "a", "b")
    texts = dealt.select("tile", F.col("a").alias("digest")).union(dealt.select("tile", "b")).distinct().join(words.select("digest", "words"), "digest")
    rows = dealt.withColumn("words", F.lit(None).cast("binary")).union(texts.select("tile", "digest", F.lit(None).cast("binary"), "words"))
    return aside(rows.groupBy("tile").applyInArrow(_judge, "a binary, b binary"))


def links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` between digests of near texts, and the components ``(node, root)`` that they make."""
    members = found.where("n_words > 0").select("digest", "n_words", "s0", "s1", F.posexplode("sketches").alias("nth", "sketch")).distinct()
    shared = members.groupBy("sketch").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    members = aside(members.join(shared.select("sketch"), "sketch"))
    met = members.select("digest").distinct()
    # 31 bits of each sketch tell whether two texts share it, wrongly once in two billion
    marks = F.transform(F.slice("sketches", 1, SKETCHES), lambda x: x.bitwiseAND(2**31 - 1).cast("int")).alias("marks")
    words = found.select("digest", "words", marks).join(met, "digest", "left_semi").dropDuplicates(["digest"])
    words = aside(words.mapInArrow(_parities, "digest binary, words binary, marks array<int>, p0 long, p1 long"))
    near, roots, sent, closer = None, None, None, None  # sent: (sketch, node), the leaders so far
    for functions, at_once in _rounds():
        if roots is None:
            own = members.where(F.col("nth") < functions).withColumns({"root": F.col("digest"), "led": F.lit(False)})
        else:
            # buckets of one component are done: components only grow together
            own = _rooted(members, roots, "digest")
            ends = own.groupBy("sketch").agg(F.min(F.xxhash64("root")).alias("low"), F.max(F.xxhash64("root")).alias("high"))
            own = aside(own.join(ends.where("low <> high").select("sketch"), "sketch"))
            members = own.drop("root")
            if functions < SKETCHES:
                own = own.where(F.col("nth") < functions)
            led = sent.select("sketch", F.col("node").alias("digest"), F.lit(True).alias("led"))
            own = own.join(led, ["sketch", "digest"], "left").withColumn("led", F.coalesce("led", F.lit(False)))
        leaders = aside(_leaders(own, at_once))
        if leaders.isEmpty():
            if functions < SKETCHES:
                continue
            return near, roots
        rest, led_by = own.where("not led"), leaders
        if at_once > 1:
            closer = aside(words.select("digest", "p0", "p1", "marks")) if closer is None else closer
            rest = rest.join(closer, "digest")
            led_by = leaders.join(closer.select(F.col("digest").alias("leader"), *(F.col(c).alias(f"its_{c}") for c in ("p0", "p1", "marks"))), "leader")
        pairs = aside(_pairs(rest, led_by).groupBy("a", "b").agg(F.min("sketch").alias("sketch")))
        new = judged(pairs, words)
        if near is None or not new.isEmpty():
            near = new if near is None else near.union(new)
            roots = components(near)
        now = leaders.select("sketch", F.col("leader").alias("node"))
        sent = now if sent is None else sent.union(now)


def _pairs(own: DataFrame, leaders: DataFrame) -> DataFrame:
    """``a, b, sketch`` of members and leaders that meet in a bucket and that nothing in their rows rules out."""
    longer = F.greatest("n_words", "its_n_words")
    fits = (F.least("n_words", "its_n_words") >= SIMILARITY * longer) & (_unlike("s0", "s1") <= UNLIKE)
    if "marks" in own.columns:
        fits &= _unlike("p0", "p1") <= 2 * F.floor((1 - SIMILARITY) * longer + 1e-9)
    # who led before has met everybody outside its component
    met = own.where("not led").join(leaders, "sketch").where(fits & (F.col("root") != F.col("its_root")))
    if "marks" in own.columns:
        first = F.array_position(F.zip_with("marks", "its_marks", lambda x, y: x == y), True)  # from 1; 0: none
        # the generator keeps this test out of the join, whose condition is compiled without it and sees every member with every leader
        met = met.withColumn("first", F.explode(F.array(first))).where((F.col("first") == 0) | (F.col("first") == F.col("nth") + 1))
    return met.select(F.least("leader", "digest").alias("a"), F.greatest("leader", "digest").alias("b"), "sketch")


def _unlike(*columns: str) -> Column:
    """How many bits of these columns differ between a member and a leader."""
    return sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"its_{c}"))) for c in columns)


def _leaders(own: DataFrame, at_once: int) -> DataFrame:
    """``sketch, leader, its_root, its_n_words, its_s0, its_s1``: about ``at_once`` members a bucket that have not led, one at least where pairs are left.

    The component with most such members sends none: it has met the others when all of theirs have led.
    """
    facts = ("root", "n_words", "s0", "s1")
    left = own.where("not led").groupBy("sketch", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = left.groupBy("sketch").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    # a component of members that all led has met everybody
    buckets = buckets.where(F.col("all") > F.col("most.n")).select("sketch", F.col("most.root").alias("stays"), (F.col("all") - F.col("most.n")).alias("waiting"))
    draw = F.xxhash64("digest", "sketch", F.lit(at_once))
    waiting = own.where("not led").join(buckets, "sketch").where("root <> stays").withColumn("draw", draw)
    first = waiting.groupBy("sketch").agg(F.min_by(F.struct("digest", *facts), F.struct("draw", "digest")).alias("x")).select("sketch", "x.*")
    if at_once > 1:
        low = F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("waiting") < F.lit(at_once - 1.0)
        first = first.union(waiting.where(low).select("sketch", "digest", *facts)).distinct()
    return first.select("sketch", F.col("digest").alias("leader"), *(F.col(c).alias(f"its_{c}") for c in facts))


def _rounds() -> Iterator[tuple[int, int]]:
    yield from FIRST_ROUNDS
    leaders = MORE
    while True:
        yield SKETCHES, leaders
        leaders *= MORE


def _rooted(rows: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``rows`` with the root of their component; a node without links is its own."""
    known = roots.select(F.col("node").alias(node), "root")
    return rows.join(known, node, "left").withColumn("root", F.coalesce("root", node))


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, h, class_id, kept`` of every row: h is a hash of the row, class_id the smallest doc_id of the group."""
    found = aside(features(docs))
    _, roots = links(found)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    if roots is not None:
        placed = _rooted(found.select("doc_id", "h", "digest"), roots, "digest")
    else:
        placed = found.select("doc_id", "h", F.col("digest").alias("root"))
    placed = placed.join(placed.groupBy("root").agg(least), "root")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    return placed.select("doc_id", "h", F.col("least.doc_id").alias("class_id"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One input row of each group, unchanged."""
    winners = groups(docs).where("kept").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    winners = aside(winners.select(F.col("doc_id").alias("won"), F.col("h").alias("won_h"), "rows"))
    held = docs.select(whole_row(), F.col("doc_id").alias("id"), F.xxhash64("*").alias("h"))

    def chosen(some: DataFrame) -> DataFrame:
        return held.join(some, held["id"].eqNullSafe(some["won"]) & (held["h"] == some["won_h"]), "left_semi")

    # equal rows combine before their shuffle
    return chosen(winners.where("rows = 1")).union(chosen(winners.where("rows > 1")).dropDuplicates(["id", "h"])).select("row.*")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
