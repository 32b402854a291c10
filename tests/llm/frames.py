"""Small frames with the odd cases: nulls, empty and very long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

CLASHES = ["row", "text_", "h", "id", "digest", "key", "cell", "n", "rows", "words", "kept", "slot", "host", "spans", "score", "root", "k"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    """A copy with some words replaced, dropped or added."""
    rng, out = random.Random(seed), []
    for word in text.split(" "):
        if rng.random() >= share:
            out.append(word)
        else:
            out += rng.choice([["zzz" + word], [], [word, "yyy"]])
    return " ".join(out)


def odd_rows() -> list[tuple]:
    base = prose(1, 200)
    long = prose(2, 60_000)
    return [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (3, edited(base, 5, 0.05), "en", "b", None),
        (4, None, None, None, None), (5, "", "", "", 0), (6, "   \n\t ", "en", "a", 6), (7, long, "en", "b", len(long)),
        (8, "write to a.b@c.example.org or +1 (555) 123-4567.\n" + prose(3, 50), "en", "a", 10), (9, "|||###", "en", "a", 6),
        (9, "|||###", "en", "a", 6), (None, prose(4, 60), "de", "c", 1), (None, prose(6, 60), "de", "c", 1),
        (10, "naïve \U0001f600 ẞ  l'été don't 12,5 x", "fr", "c", 3), (11, "x", "fr", "c", 1), (12, "7" * 5000, "en", "a", 5000)]


def frame(spark, rows, schema=DOCS, clashes=True):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, schema)
    taken = {c.lower() for c in made.columns}
    return made.withColumns({c: F.lit(f"extra {c}") for c in CLASHES if c not in taken}) if clashes else made
