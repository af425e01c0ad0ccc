"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The base kinds (email, ip, card, phone) are fixed by their pattern and validator; context only
moves their score. The added kinds (iban, ssn) count when checksum and context bring them to
``ACCEPTED``. Offsets are code points, ends exclusive. All patterns take time in proportion
to the text: a digit run is entered at its first digit only, and an address is read outwards
from its at sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
ACCEPTED = 0.5
#: Score of a span whose validator agrees, before its context is read.
CONFIRMED = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words that make a kind likelier or less likely within ``REACH`` characters.
FOR = {
    "email": "mail email contact write", "ip": "ip address host server login", "card": "card credit debit visa mastercard payment",
    "phone": "phone call tel mobile fax", "iban": "iban account bank transfer", "ssn": "ssn social security insurance",
}
AGAINST = {"email": "example", "ip": "version release build", "card": "order tracking serial isbn", "phone": "order serial", "iban": "serial", "ssn": "part serial order"}
REACH, RAISED, LOWERED = 48, 0.25, 0.25

# Fixed patterns. A digit may start a match only as the first of its run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    country: length for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for country in countries.split()
}
SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[0-9]")
CONTEXT = re.compile(r"[a-z]+")


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at) if begin < at else None
        free = match.end() if match else at + 1
        if match:
            yield begin, free
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Matches cut at their country's length; else whole ones, as of unknown countries."""
    match = IBAN.search(text)
    while match:
        begin, end = match.span()
        places = [i for i in range(begin, end) if text[i] != " "]
        length = IBAN_LENGTHS.get(match[0][:2], len(places))
        cut = places[length - 1] + 1 if length <= len(places) else end
        if cut < end and text[cut] != " ":
            cut = end
        for stop in dict.fromkeys((cut, end)):
            if mod97(text[begin:stop].replace(" ", "")):
                yield begin, stop
                match = IBAN.search(text, stop)
                break
        else:
            match = IBAN.search(text, begin + 2)


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose validator agrees, kind by kind."""
    yield from (("email", *span) for span in emails(text))
    if DIGITS.search(text) is None:
        return
    for match in IP.finditer(text):
        if all(map(octet, match[0].split("."))):
            yield "ip", *match.span()
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *match.span()
    for match in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(match[0])) <= 15:
            yield "phone", *match.span()
    yield from (("iban", *span) for span in ibans(text))
    for match in SSN.finditer(text):
        if match[0][:3] not in ("000", "666") and match[0][4:6] != "00" and match[0][7:] != "0000":
            yield "ssn", *match.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(CONTEXT.findall((text[max(0, start - REACH):start] + " " + text[end:end + REACH]).lower()))
    value = CONFIRMED[kind] + RAISED * bool(near & set(FOR[kind].split())) - LOWERED * bool(near & set(AGAINST[kind].split()))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[Span]:
    """All accepted spans by start, then kind."""
    found = (Span(start, kind, end, score(text, kind, start, end)) for kind, start, end in confirmed(text))
    return sorted((s for s in found if s.kind in BASE or s.score >= ACCEPTED), key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the first stands for all."""
    out, done = [], 0
    for span in find(text):
        if span.start >= done:
            out += [text[done:span.start], f"[{span.kind.upper()}]"]
        done = max(done, span.end)
    return "".join([*out, text[done:]])


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, spans`` (array of kind, start, end, score) of every row of ``docs``.

    One narrow pass without a shuffle over whole texts. A null text counts as empty; repeated
    rows and null ids come back one by one; other columns are neither read nor returned. An
    empty table gives an empty result.
    """

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch, texts in batches(source):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[s._asdict() for s in find(t)] for t in texts], kind)], names=["doc_id", "spans"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(search, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text; cases as in ``spans``."""

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            found = [find(t) for t in texts]
            base = [[s for s in row if s.kind in BASE] for row in found]
            counts = [pa.array([sum(s.kind == kind for s in row) for row in base], pa.int64()) for kind in BASE]
            hashes = pa.array([hashlib.sha256(listed(row).encode()).hexdigest() for row in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, hashes, pa.array(map(listed, found), pa.string())],
                names=["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"],
            )

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; a null text stays null."""

    def replace(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in batches(source, column=text_column):
            place = batch.schema.get_field_index(text_column)
            clean = pa.array([None if t is None else redacted(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([clean if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(replace, docs.schema)
