"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

All of it is column expressions.  A kind's matches and their places come from splitting the text at the pattern:
the lengths of the pieces between matches and of the matches themselves add up to the offsets (code points, end
exclusive).  Patterns use possessive repeats, so long runs of digits or letters cost linear time and no stack.

Kinds: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits, Luhn) and ``phone`` (``+``, 9 to 15 digits) are
always reported.  Further kinds need a checksum or context: ``iban`` (mod 97), ``national_id`` and ``local_phone``
(digits in groups, reported only where a context word nearby lifts the score to ``MIN_SCORE``).

Defined cases: a null text counts as empty and has no spans, and ``redact`` leaves it null; a failing match is
dropped and the search goes on behind it; kinds may overlap, and ``redact`` replaces overlapping spans once, by the tag
of the first; repeated rows are treated each; extra columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, whole_row

MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_LIFT = 0.3


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = _digits(hit)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _octets(hit: Column) -> Column:
    """Every part at most 255, leading zeros aside."""
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= F.lit("255")))

    return F.forall(F.split(hit, "\\."), small)


def _mod97(hit: Column) -> Column:
    """Country and check digits to the end, letters as 10 to 35, remainder 1."""
    bare = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


class Kind(NamedTuple):
    name: str
    pattern: str
    needs: str  # a cheaper pattern without which there is no match
    valid: Callable[[Column], Column]
    score: float
    context: str


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda hit: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _octets, 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", _luhn, 0.7, "card|visa|credit|payment|debit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda hit: F.length(_digits(hit)).between(9, 15), 0.6,
         "phone|call|tel|fax|mobile"),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}",
         _mod97, 0.8, "iban|bank|account|konto"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]",
         lambda hit: ~hit.rlike("^(000|666|9..)|-00-|-0000$"), 0.3, "ssn|social security|national id"),
    Kind("local_phone", r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[).\x20-]",
         lambda hit: F.lit(True), 0.3, "phone|call|tel|fax|mobile"),
)
KINDS = BASE + MORE
SPAN = "array<struct<start:int,end:int,hit:string,score:double>>"


def _spans(text: Column, parts: Column, hits: Column, kind: Kind) -> Column:
    """Confirmed matches of one kind from the pieces around all of them."""
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("part"), hits.alias("hit"))
    start = lambda acc, p: acc["at"] + F.length(p["part"])
    placed = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("found")),
        lambda acc, p: F.struct(
            (start(acc, p) + F.length(p["hit"])).alias("at"),
            F.concat(acc["found"], F.array(F.struct(
                start(acc, p).alias("start"), (start(acc, p) + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))).alias("found")))["found"]

    def scored(span: Column) -> Column:
        before = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
        around = F.lower(F.substring(text, before + 1, span["end"] - before + CONTEXT_CHARS))
        lift = F.when(around.rlike(kind.context), CONTEXT_LIFT).otherwise(0.0)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["hit"].alias("hit"), F.least(F.lit(1.0), kind.score + lift).alias("score"))

    confirmed = F.transform(F.filter(placed, lambda s: kind.valid(s["hit"])), scored)
    return confirmed if kind in BASE else F.filter(confirmed, lambda s: s["score"] >= MIN_SCORE)


def find(docs: DataFrame) -> DataFrame:
    """``row`` (the input row), ``text`` and, per kind, an array of (start, end, hit, score) by start."""
    out = docs.select(whole_row(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = out.withColumn("digits", F.col("text").rlike("[0-9]"))
    for kind in KINDS:
        may = F.contains("text", F.lit("@")) if kind.name == "email" else F.col("digits") & F.col("text").rlike(kind.needs)
        out = out.withColumn(f"hits_{kind.name}", F.when(may, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))))
    for kind in KINDS:
        hits = F.col(f"hits_{kind.name}")
        none = F.array().cast(SPAN)
        found = _spans(F.col("text"), F.split("text", kind.pattern, -1), hits, kind)
        out = out.withColumn(kind.name, F.when(F.size(F.coalesce(hits, F.array().cast("array<string>"))) > 0, found).otherwise(none))
    return out.select("row", "text", *[k.name for k in KINDS])


def _listed(kinds: tuple[Kind, ...]) -> Column:
    def one(kind: Kind) -> Column:
        return F.transform(kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def redact(found: DataFrame) -> DataFrame:
    """The input rows with every span replaced by a tag such as ``[EMAIL]``; ``n_chars``, where there, follows."""
    def tagged(kind: Kind) -> Column:
        tag = F.lit(f"[{kind.name.upper()}]").alias("tag")
        return F.transform(kind.name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag))

    spans = F.sort_array(F.concat(*[tagged(k) for k in KINDS]))
    held = found.select("row", "text", spans.alias("spans"))
    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    # the rest after the last span is at most the whole text long
    told = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, told).otherwise(F.col("row.text"))
    fields = {"text": text}
    names = found.schema["row"].dataType.names
    if "n_chars" in names:
        kind = found.schema["row"].dataType["n_chars"].dataType
        fields["n_chars"] = F.when(F.size("spans") > 0, F.length(told).cast(kind)).otherwise(F.col("row.n_chars"))
    return held.select(*[fields.get(n, F.col("row").getField(n)).alias(n) for n in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(find(docs))
