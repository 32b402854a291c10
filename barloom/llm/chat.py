"""Chat formatting by prefix-target expansion: one example per assistant turn.

An example holds all turns before the reply as context and the reply itself, and only the reply is trainable.  A conversation
that does not end in a reply gives one last record without a trainable part, so that the output holds every turn.

Template: ``<|turn|>role``, a line end, the text, ``<|end|>``, a line end.  Inside roles and texts every control string (those of this
template and of other common ones) gets a backslash after its first character, after any backslashes it already has there; taking
one away again restores the text exactly.  Line ends and backslashes of roles are written as ``\\n`` and ``\\\\``.

Turns of a conversation come together by a sort, and examples are written one by one while they pass: a task holds one conversation's
prefix, never the expansion.

Defined cases: null texts and roles count as empty; turns are ordered by number (null first), equal numbers by role, then text; the reply is
a turn whose role is ``assistant``; repeated rows are turns each; an empty table gives nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table

TURN, END, REPLY = "<|turn|>", "<|end|>\n", "assistant"
#: Control strings that must not appear in texts: ``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``[INST]``, ``[/INST]``.
_RAW = re.compile(r"(<)(\\*)(\||/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])")
_SAFE = re.compile(r"(<)\\(\\*)(\||/?s>|</?SYS>>)|(\[)\\(\\*)(/?INST\])")
EXAMPLES = "conv_id long, example int, text string, loss_start int, loss_end int, last boolean"
BATCH_CHARS = 2_000_000


def escape(text: str) -> str:
    return _RAW.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] if m[1] else m[5]) + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _SAFE.sub(lambda m: (m[1] or m[4]) + (m[2] if m[1] else m[5]) + (m[3] or m[6]), text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    found = []
    for part in text.split(TURN)[1:]:
        role, _, body = part.partition("\n")
        found.append((unescape_role(role), unescape(body.removesuffix(END))))
    return found


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in EXAMPLES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def examples() -> Iterator[tuple]:
        """Rows in order; a row is held back until it is known whether its conversation goes on."""
        conv, prefix, number, held, open_end = None, "", 0, None, False

        def closing() -> Iterator[tuple]:
            if held is not None:
                yield (*held, not open_end)
            if open_end:
                yield conv, number, prefix, len(prefix), len(prefix), True

        started = False
        for batch in batches:
            for one, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not started or one != conv:
                    if started:
                        yield from closing()
                    started, conv, prefix, number, held, open_end = True, one, "", 0, None, False
                body = escape(text or "")
                prefix += f"{TURN}{escape_role(role or '')}\n"
                start = len(prefix)
                prefix += body + END
                if role == REPLY:
                    if held is not None:
                        yield (*held, False)
                    held, number, open_end = (conv, number, prefix, start, start + len(body)), number + 1, False
                else:
                    open_end = True
        if started:
            yield from closing()

    rows, chars = [], 0
    for row in examples():
        rows.append(row)
        chars += len(row[2])
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
            rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def expand(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end, last``: offsets in code points, ``last`` marks a conversation's final record.

    The records of a conversation follow each other in one partition, in order.
    """
    placed = turns.selectExpr("cast(conv_id as bigint) as conv_id", "turn", "role", "text")
    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_write, EXAMPLES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loss, loss_chars, formatted = sha256(), 0, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text = row["text"]
            reply = unescape(text[row["loss_start"]:row["loss_end"]])
            loss.update(reply.encode("utf-8", "surrogatepass"))
            loss_chars += len(reply)
            formatted += len(text)
            if row["last"]:
                turns = turns_of(text)
                whole = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                out.append((row["conv_id"], len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), formatted))
                loss, loss_chars, formatted = sha256(), 0, 0
        if out:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(names, zip(*out))}, pa.schema(
                [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                 ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them; ``formatted_chars`` sums over all its records."""
    return examples.mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), said.alias("text"))
    return digest(expand(turns.union(probe)))
