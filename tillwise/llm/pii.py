"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is built-in functions on one row. A pattern cuts a text into matches and the
pieces between them; the running sum of their lengths gives the positions, so the text is
scanned twice per pattern and never per match. All patterns take linear time on any text:
runs are consumed possessively and cannot be entered in the middle.

Defined cases: a null text is empty and gives no spans; texts are read whole, whatever their
length; rows are independent, so ties, repeated rows and null ids need no rule; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
SUM_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, score of a confirmed span, words that raise it."""

    name: str
    pattern: str
    score: float
    context: str


# Patterns, scores and context words of the kinds, in the order of the result.
EMAIL = Kind(
    "email",
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    0.8,
    r"(?i)\b(?:e-?mail|mail|contact|write|reply)\b",
)
IP = Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"(?i)\b(?:ip|address|host|server|login)\b")
CARD = Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.7, r"(?i)\b(?:card|credit|debit|visa|payment|account)\b")
PHONE = Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b")
IBAN = Kind(
    "iban",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    0.8,
    r"(?i)\b(?:iban|bank|account|transfer)\b",
)
BASE_KINDS = [EMAIL, IP, CARD, PHONE]
KINDS = [*BASE_KINDS, IBAN]
CONTEXT_BONUS = 0.2
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether the digits have a valid Luhn check digit."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether an account number has valid check digits: rearranged, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == IP:
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == CARD:
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == PHONE:
        return F.length(digits).between(9, 15)
    if kind == IBAN:
        return _mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _running_sum(values: Column) -> Column:
    """Inclusive running sum of an array, in blocks so that the cost stays near linear."""

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(
            part,
            start,
            lambda seen, x: F.struct(
                (seen.total + x).alias("total"), F.concat(seen.sums, F.array(seen.total + x)).alias("sums")
            ),
        )

    last = F.floor((F.size(values) - 1) / SUM_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: sums(F.slice(values, k * SUM_BLOCK + 1, SUM_BLOCK)))
    shifted = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("done")),
        lambda seen, block: F.struct(
            (seen.total + block.total).alias("total"),
            F.concat(seen.done, F.array(F.transform(block.sums, lambda s: s + seen.total))).alias("done"),
        ),
    )
    return F.flatten(shifted.done)


def _lengths(name: str) -> Column:
    """Of each match together with the piece before it."""
    pieces = F.col(f"{name}_pieces")
    return F.transform(f"{name}_matches", lambda match, i: F.length(pieces[i]) + F.length(match))


def _spans(kind: Kind) -> Column:
    """Spans of one kind from its columns of matches, pieces and ends."""
    matches, pieces, ends = (F.col(f"{kind.name}_{part}") for part in ("matches", "pieces", "ends"))

    def span(match: Column, i: Column) -> Column:
        near = F.concat_ws(" ", F.right(pieces[i], F.lit(CONTEXT_CHARS)), F.left(pieces[i + 1], F.lit(CONTEXT_CHARS)))
        bonus = F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            (ends[i] - F.length(match)).alias("start"),
            ends[i].alias("end"),
            F.round(F.lit(kind.score) + bonus, 2).alias("score"),
            _confirmed(kind, match).alias("confirmed"),
        )

    found = F.filter(F.transform(matches, span), lambda s: s.confirmed)
    plain = F.transform(found, lambda s: F.struct(*[s[part].alias(part) for part in ("kind", "start", "end", "score")]))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.size(matches) > 0, plain).otherwise(empty)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score), by kind as listed, then start.

    Positions count code points, end exclusive. Each step is a projection of its own that
    refers to the arrays of the step before more than once, so Catalyst keeps them apart
    and computes every array once per row.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = [kind.name for kind in KINDS]
    matched = text.select(
        "*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"{k.name}_matches") for k in KINDS]
    )
    cut = matched.select(
        "doc_id",
        *[f"{name}_matches" for name in names],
        *[
            F.when(F.size(f"{k.name}_matches") > 0, F.split("text", k.pattern, -1)).alias(f"{k.name}_pieces")
            for k in KINDS
        ],
    )
    lengths = cut.select(
        "*",
        *[_lengths(name).alias(f"{name}_lengths") for name in names],
    )
    ends = lengths.select(
        "*",
        *[
            F.when(F.size(f"{name}_matches") > 0, _running_sum(F.col(f"{name}_lengths"))).alias(f"{name}_ends")
            for name in names
        ],
    )
    return ends.select("doc_id", F.concat(*[_spans(kind) for kind in KINDS]).alias("spans"))


def _count(name: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == name)).cast("long")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts and digests of the spans of :func:`find_spans`."""

    def joined(of: Column) -> Column:
        return F.array_join(
            F.transform(of, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
        )

    base = F.filter("spans", lambda s: s.kind.isin([kind.name for kind in BASE_KINDS]))
    counts = [_count(kind.name).alias(f"n_{kind.name}") for kind in KINDS]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s.score.cast("string")), ",").alias("scores"),
    )
