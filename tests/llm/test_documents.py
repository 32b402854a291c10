"""Operators on documents against brute force, on odd rows and on an empty table."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, mixing, neardup, pii, quality, tokenfile
from barloom.session import ensure_checkpoint_dir

from .frames import edited, frame, odd_rows, prose

ROWS = odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


# -- quality -----------------------------------------------------------------------------------------------------------


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, labels):
    texts = ["a b c d e f g h " * 4, "a b c d e f g h i a b c d e f g h", "x\ny\nx\n\n \n", prose(9, 30) + "\n" + prose(9, 30)]
    more = frame(spark, [(100 + i, t, None, None, None) for i, t in enumerate(texts)])
    rows = quality.judge(docs.union(more), quality.fit(docs, labels)).select(
        "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == len(ROWS) + len(texts)
    for r in rows:
        n = counts(r["text"])
        assert n == tuple(r[1:6])
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_prefers_trusted(spark):
    good = [(i, prose(1, 80), None, None, None) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}%%%" for w in prose(50 + i, 80).split()), None, None, None) for i in range(20)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    kept = {r[0] for r in quality.judge(docs, quality.fit(docs, labels, prior=2000)).where("kept").select("row.doc_id").collect()}
    assert kept == set(range(40))


def test_quality_stage_keeps_columns(spark, docs, empty, labels):
    ratios = quality.fit(docs, labels)
    assert quality.judge(docs, ratios).where("kept").select("row.*").columns == docs.columns
    assert quality.judge(empty, quality.fit(empty, labels.limit(0))).count() == 0
    assert quality.fit(docs, labels.limit(0)) == [0.0] * quality.BUCKETS or max(map(abs, quality.fit(docs, labels.limit(0)))) < 1e-9


# -- personal data -----------------------------------------------------------------------------------------------------

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0


VALID = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": luhn,
         "phone": lambda x: 9 <= sum(c.isdigit() for c in x) <= 15}
PERSONAL = [
    "a@b.c_d@e.f a@b a@@b.c x.y%z@h-1.org.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567 +12 +1+1 555 123 4567", "é@x.org \U0001f600 10.0.0.255 +49 30 1234567", "card 5500005555555559 5500005555555559",
    "1" * 20_000 + " 4111111111111111", "a." * 20_000 + "@x.org", "1." * 5000, ("a@b.c " * 500)]


def test_pii_base_spans(spark, docs):
    more = frame(spark, [(100 + i, t, None, None, None) for i, t in enumerate(PERSONAL)])
    rows = pii.find(docs.union(more)).select("row.text", *[k.name for k in pii.BASE]).collect()
    for r in rows:
        for name, pattern in PATTERNS:
            want = [(m.start(), m.end()) for m in re.finditer(pattern, r["text"] or "") if VALID[name](m[0])]
            assert [(s["start"], s["end"]) for s in r[name]] == want, (name, (r["text"] or "")[:80])


def test_pii_added_spans_and_redaction(spark, empty):
    texts = ["iban DE89 3704 0044 0532 0130 00 end", "iban DE89 3704 0044 0532 0130 01 end", "ssn 123-45-6789", "code 123-45-6789",
             "call 555-123-4567 now", "mail a@b.org, a@b.org", "nothing", None]
    found = pii.find(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]))
    got = {r["doc_id"]: r for r in pii.redact(found).collect()}
    assert [got[i]["text"] for i in range(8)] == [
        "iban [IBAN] end", texts[1], "ssn [NATIONAL_ID]", texts[3], "call [LOCAL_PHONE] now", "mail [EMAIL], [EMAIL]", "nothing", None]
    assert got[5]["n_chars"] == len("mail [EMAIL], [EMAIL]") and got[6]["n_chars"] is None
    assert pii.redact(pii.find(empty)).count() == 0 and pii.redact(found).columns == empty.columns


# -- mixing ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 2.5, None: 0.3, "": 0.1}, {"a": 1.0, "b": 0.0123456789, "c": 2 / 3, None: 1e-4, "": 7e-4}])
def test_mixing_deviates_less_than_a_block(spark, weights):
    """From the target weights themselves, at every prefix."""
    sizes = {"a": 900, "b": 120, "c": 33, None: 5, "": 1}
    rows = [(i * 10 + k, "t", None, s, 1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    out = mixing.mix(frame(spark, rows).repartition(5), weights).select("row.source", "row.doc_id", "unit", "copy", "slot", "seat").collect()
    for source, n in sizes.items():
        own = [r for r in out if r["source"] == source]
        assert {r["doc_id"] for r in own} == {r[0] for r in rows if r[3] == source}
        assert len({(r["slot"], r["seat"]) for r in own}) == len(own)
        first = [r for r in own if r["copy"] == 0]
        assert len(first) == n and len({r["doc_id"] for r in first}) == n
    by_slot = {r["slot"]: r["source"] for r in out}
    assert sorted(by_slot) == list(range(len(by_slot)))
    wanted = {s: (weights[s] if weights else n**mixing.EVENNESS) for s, n in sizes.items()}
    had = Counter()
    for slot in range(len(by_slot)):
        had[by_slot[slot]] += 1
        for s in sizes:
            assert abs(had[s] - wanted[s] / sum(wanted.values()) * (slot + 1)) * mixing.UNIT < mixing.BLOCK
    last = by_slot[len(by_slot) - 1]  # the mix ends with the first use of a last unit
    assert had[last] == -(-sizes[last] // mixing.UNIT)


def test_mixing_weights_far_into_a_mix(spark):
    """A rare source of weight 1e-6 in a mix of millions of units, by the closed form of the counts."""
    weights = {"x": 0.6180339887, "y": 0.3819650113, "z": 0.000001}
    sizes = spark.createDataFrame([(f"={s}", 10) for s in weights], "key string, n long")
    planned = mixing.levels(mixing.targets(sizes, weights)).cache()
    for slots in (999, 123_456, 7_654_321, 1_000_000_007, 10**12):
        counts = {r["key"]: sum(r[1]) for r in planned.select("key", mixing._counts(F.lit(slots))).collect()}
        assert sum(counts.values()) == slots
        if slots <= 10**9 + 7:
            assert all(abs(counts[f"={s}"] - w * slots) < 2 * mixing.LEVELS for s, w in weights.items())
    planned.unpersist()


def test_mixing_many_sources(spark):
    rows = [(i, "t", None, f"s{i % 130}", 1) for i in range(400)]
    out = mixing.mix(frame(spark, rows)).select("row.doc_id", "slot", "seat").collect()
    assert {r["doc_id"] for r in out} == set(range(400)) and len({(r["slot"], r["seat"]) for r in out}) == len(out)


def test_mixing_odd_rows(spark, docs, empty):
    out = mixing.mix(docs)
    assert out.where("copy = 0").count() == len(ROWS)
    assert mixing.mix(empty).count() == 0
    with pytest.raises(Exception, match="no weight for the source"):
        mixing.mix(docs, {"a": 1.0}).collect()


# -- byte-level BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, empty, reference):
    tokens = bpe.encode(docs, bpe.default_ranks())
    texts = sorted(r[1] or "" for r in ROWS)
    decoded = bpe.decode(tokens, bpe.default_ranks()).collect()
    assert sorted(r["decoded"].decode() for r in decoded) == texts
    want = sorted(str(reference.encode_ordinary(t)) for t in texts)
    assert sorted(str(list(r["ids"])) for r in tokens.collect()) == want
    assert bpe.encode(empty, bpe.default_ranks()).count() == 0


def test_bpe_pieces(reference):
    import random

    rng = random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", "r", "l", " ", "  ", "\n", "\t", " ", "1", "23", "٣", "a", "Z", "é", "中",
             "\U0001f600", "!", "?", "_", "\x00", "́", "\x85", "​", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    codec = bpe.Codec(bpe.default_ranks())
    ids, counts_ = codec.encode(texts)
    ends = np.cumsum(counts_)
    for text, a, b in zip(texts, ends - counts_, ends):
        assert ids[a:b].tolist() == reference.encode_ordinary(text)


# -- token files -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n), rng.integers(0, 50_000, n), np.full(n, 7), np.where(rng.random(n) < 0.05, 49_000, rng.integers(0, 30, n))):
        payload = tokenfile.pack(ids)
        assert (tokenfile.unpack(payload) == ids).all()
        assert (tokenfile.unpack(payload, 1, 2) == ids[256:512]).all()


def test_token_file(spark, docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for name, data, rows in (("odd", docs, ROWS), ("empty", empty, [])):
        folder = f"{ensure_checkpoint_dir(spark)}/test-{name}-{np.random.default_rng().integers(1 << 60)}"
        tokenfile.write(data, path, folder)
        got = tokenfile.documents(tokenfile.read(spark, folder)).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()][:len(got)]
        want = Counter()
        for doc_id, text, *_ in rows:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_file_words_share_pieces():
    """Words of letters, digits and signs are learnt by pieces, each once; all ids are the library's."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import random

    encoder = tokenfile.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.encode(["Quzzle!! quzzle%% (QUZZLE) 7quzzle"])
    assert "quzzle" in encoder.words and encoder.words["Quzzle!!"] == encoder.words["quzzle"] + encoder.words["!!"] != b""
    rng = random.Random(8)
    parts = [*"aAzZsStTdDmMlLrReEvV.,!?<|>09 \n\t_-éÉßÀÿ×÷ªº²½İſ́ 　µ%$", "'", "'", "<|endoftext|>", "'ll", "'RE", "''s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_token_file_special_strings():
    """Texts that hold the vocabulary's special strings, against an unmodified tokenizer."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in special and not any(" " in x or "\n" in x for x in special)
    rng = random.Random(5)
    parts = [*special, *special, " ", "  ", "\n", "Word", "end.", ",", ".", "é", "<|", "|>", "12", special[0].upper()]
    texts = special + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for text, ids in zip(texts, tokenfile.Encoder(path).encode(texts)):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, tokenfile.END_ID], text


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_is_the_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(0, 14)), rng.integers(0, 4, rng.integers(0, 14))
        d = levenshtein(a.tolist(), b.tolist())
        assert neardup.edits(a, b, 14) == d
        assert neardup.edits(a, b, d) == d and (d == 0 or neardup.edits(a, b, d - 1) is None)


def test_neardup_groups(spark):
    rows, group, ident = [], {}, 0
    for g in range(12):
        base = prose(100 + g, 60 + 20 * g)
        copies = [base, base, base.upper()] + [edited(base, 10 * g + k, 0.04) for k in range(g)]
        for text in copies:
            rows.append((ident, text, None, "s", 1))
            group[ident] = g
            ident += 1
    shared = prose(7, 60)  # a passage that different documents share
    for k in range(30):
        rows.append((ident, f"{prose(500 + k, 150)} {shared} {prose(600 + k, 150)}", None, "s", 1))
        group[ident] = 100 + k
        ident += 1
    docs = frame(spark, rows).repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.groups(docs).collect()}
    with np.errstate(over="ignore"):
        words = {r[0]: neardup.word_hashes(r[1]) for r in rows}
        for a, b in combinations(group, 2):
            assert (got[a] == got[b]) == (group[a] == group[b]), (a, b)
            if group[a] != group[b]:
                assert not neardup.alike(words[a], words[b])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_neardup_links_of_led_components(spark):
    """Four texts in one bucket with the true links a-b, c-d and b-d only; whichever of them lead, all end in one group."""
    rows = []
    for turn in range(24):
        b = np.arange(1000 * turn, 1000 * turn + 100).astype(np.uint32)
        a, d = b.copy(), b.copy()
        a[:15] += 500
        d[40:55] += 500
        c = d.copy()
        c[80:95] += 500
        texts = {x: v for x, v in zip("abcd", (a, b, c, d))}
        near = {x + y for x, y in combinations("abcd", 2) if neardup.alike(texts[x], texts[y])}
        assert near == {"ab", "bd", "cd"}
        rows += [(i, i, hashlib.md5(f"{turn}{x}".encode()).digest(), 100, [turn], *map(int, neardup.signature(v)), v.tobytes()) for i, (x, v) in enumerate(texts.items())]
    found = spark.createDataFrame(rows, f"doc_id long, h long, {neardup.FEATURES}")
    _, roots = neardup.links(found)
    root = {bytes(r["node"]): bytes(r["root"]) for r in roots.collect()}
    assert len(root) == 24 * 4 and len(set(root.values())) == 24


@pytest.mark.parametrize("n", [10, 40, 300])
def test_signature_keeps_pairs_at_the_threshold(n):
    """Texts with a fifth of their words replaced, or dropped, stay within UNLIKE bits; texts with a third in common mostly do not."""
    rng = np.random.default_rng(n)
    unlike = lambda a, b: sum(bin(int(x) & (2**64 - 1)).count("1") for x in neardup.signature(a) ^ neardup.signature(b))
    kept = other = 0
    with np.errstate(over="ignore"):
        for _ in range(300):
            a = rng.integers(0, 60, n).astype(np.uint32)  # few words, many repeats
            b = a.copy()
            b[rng.choice(n, n // 5, replace=False)] = rng.integers(100, 2**32, n // 5)
            c = rng.integers(0, 2**32, n).astype(np.uint32)
            c[: n // 3] = a[: n // 3]
            kept += unlike(a, b) <= neardup.UNLIKE and unlike(a, a[n // 5:]) <= neardup.UNLIKE
            other += unlike(a, c) <= neardup.UNLIKE
    assert kept == 300 and other < 60


def test_neardup_candidates_near_the_threshold():
    """Pairs that the verification accepts meet: all of few words, 98 % of longer ones."""
    rng = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        for n, least in ((5, 1.0), (9, 1.0), (10, 1.0), (14, 1.0), (30, 1.0), (40, 1.0), (100, 0.98), (400, 0.98)):
            met = 0
            for _ in range(200):
                a = rng.integers(0, 2**32, n).astype(np.uint32)
                b = a.copy()
                b[rng.choice(n, n // 5, replace=False)] = rng.integers(0, 2**32, n // 5)
                assert neardup.alike(a, b)
                met += bool(set(neardup.keys_of(a)) & set(neardup.keys_of(b)))
            assert met >= least * 200, (n, met)
        a = np.arange(10).astype(np.uint32)
        for b in (np.delete(a, 5), np.delete(a, [3, 7]), np.insert(a, 5, 77).astype(np.uint32), np.array([0, 1, 90, 3, 4, 5, 91, 7, 8, 9], np.uint32)):
            assert neardup.alike(a, b) and set(neardup.keys_of(a)) & set(neardup.keys_of(b))


@pytest.mark.parametrize("n", [5, 20, 50, 200])
def test_parities_keep_all_pairs_at_the_threshold(n):
    """Up to a fifth of the words replaced, dropped or added changes two parities an edit at most; short texts with half the words in common mostly fail that."""
    rng = np.random.default_rng(n)
    unlike = lambda a, b: sum(bin(int(x) & (2**64 - 1)).count("1") for x in neardup.parities(a) ^ neardup.parities(b))
    other = 0
    with np.errstate(over="ignore"):
        for _ in range(300):
            a = rng.integers(0, n, n).astype(np.uint32)
            b = a.copy()
            b[rng.choice(n, n // 5, replace=False)] = rng.integers(0, 2**32, n // 5)
            assert unlike(a, b) <= 2 * (n // 5) and unlike(a, a[n // 5:]) <= n // 5 and unlike(a, rng.permutation(a)) == 0
            c = rng.integers(0, 2**32, n).astype(np.uint32)
            c[: n // 2] = a[: n // 2]
            other += unlike(a, c) <= 2 * (n // 5)
    assert n == 200 or other < 60
    assert not neardup.parities(np.zeros(0, np.uint32)).any()


def test_neardup_judges_a_pair_in_one_bucket(spark):
    """Three texts in the same three buckets: each pair comes from the first sketch it shares, and a pair ruled out by its words from none."""
    marks = {"x": [1, 2, 3], "y": [1, 2, 3], "z": [9, 2, 3]}
    fixed = "n_words int, s0 long, s1 long, p0 long, p1 long, marks array<int>"

    def met(parity):
        facts = {k: (10, 0, 0, parity if k == "z" else 0, 0, v) for k, v in marks.items()}
        own = [(s, k.encode(), k.encode(), False, nth, *facts[k]) for k, v in marks.items() for nth, s in enumerate(v)]
        leaders = [(s, k.encode(), k.encode(), *facts[k]) for k in "xz" for s in marks[k]]
        its = ", ".join(f"its_{c}" for c in fixed.split(", "))
        return neardup._pairs(
            spark.createDataFrame(own, f"sketch long, digest binary, root binary, led boolean, nth int, {fixed}"),
            spark.createDataFrame(leaders, f"sketch long, leader binary, its_root binary, {its}"))

    got = Counter(bytes(r["a"]) + bytes(r["b"]) for r in met(0b1111).collect())
    assert got == {b"xy": 1, b"xz": 2, b"yz": 1}  # x and z lead both
    assert Counter(bytes(r["a"]) + bytes(r["b"]) for r in met(0b11111).collect()) == {b"xy": 1}


def test_neardup_sees_every_pair_of_a_bucket_in_compiled_code(spark):
    """The join condition of members and leaders holds no function of arrays: such a function is not compiled, and runs for each pair of a crowded bucket."""
    fixed = "n_words int, s0 long, s1 long, p0 long, p1 long, marks array<int>"
    its = ", ".join(f"its_{c}" for c in fixed.split(", "))
    own = spark.createDataFrame([], f"sketch long, digest binary, root binary, led boolean, nth int, {fixed}")
    plan = neardup._pairs(own, spark.createDataFrame([], f"sketch long, leader binary, its_root binary, {its}"))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "bit_count" in joins[0] and "lambda" not in joins[0] and "lambda" in plan


@pytest.mark.parametrize("tile", [4, 50, 100_000])
def test_neardup_judges_pairs_in_tiles(spark, monkeypatch, tile):
    """One bucket in which all texts meet and many buckets of one pair: every pair is judged once, with tiles of any size, and a tile gets a text once."""
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = np.random.default_rng(tile)
    texts = {}
    for i in range(40):
        a = rng.integers(0, 2**32, 60).astype(np.uint32)
        if i % 3:
            a = texts[b"%03d" % (i - 1)].copy()
            a[rng.choice(60, 7, replace=False)] += 1
        texts[b"%03d" % i] = a
    dense = sorted(texts)[:25]
    pairs = [(a, b, 7) for a, b in combinations(dense, 2)] + [(a, b, 100 + i) for i, (a, b) in enumerate(zip(sorted(texts)[25:], sorted(texts)[26:]))]
    words = spark.createDataFrame([(k, v.tobytes()) for k, v in texts.items()], "digest binary, words binary")
    got = sorted((bytes(r["a"]), bytes(r["b"])) for r in neardup.judged(spark.createDataFrame(pairs, "a binary, b binary, sketch long"), words).collect())
    with np.errstate(over="ignore"):
        assert got == sorted((a, b) for a, b, _ in pairs if neardup.alike(texts[a], texts[b])) and len(got) > 20
    assert neardup.judged(spark.createDataFrame([], "a binary, b binary, sketch long"), words).count() == 0


def test_neardup_odd_rows(docs, empty):
    got = neardup.groups(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by_id[2] == by_id[3] == 1 and by_id[5] == by_id[4] == 4 and by_id[9] == 9
    kept = [r["doc_id"] for r in neardup.keep_one(docs).collect()]
    assert Counter(kept) == Counter([1, 4, 6, 7, 8, 9, None, None, 10, 11, 12])
    assert neardup.groups(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_digest_of_pii_query(spark, tmp_path):
    frame(spark, [(1, "a@b.org 10.0.0.1", None, None, None), (2, None, None, None, None)], clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:7,ip:8:16").hexdigest() and got[2]["spans"] == ""
