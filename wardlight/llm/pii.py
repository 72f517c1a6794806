"""Personal data: patterns propose, checksums confirm, nearby words weigh."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.words import sliced

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]

_local = re.compile(r"[A-Za-z0-9._%+-]")
_host = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country; of other countries every length is tried.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC"}.items() for c in cs.split()}
_national = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_digit = re.compile(r"[0-9]")
_word = re.compile(r"[^\W\d_]+")

#: Words that speak for or against a span when they stand near it.
CONTEXT = {
    "email": ({"email", "mail", "contact", "write"}, {"example", "sample"}),
    "ip": ({"ip", "address", "server", "host", "login"}, {"version", "release", "section", "chapter"}),
    "card": ({"card", "visa", "credit", "debit", "payment", "carte", "karte", "tarjeta"}, {"order", "tracking", "isbn"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax", "telefon", "appelez"}, {"part", "serial"}),
    "iban": ({"iban", "bank", "account", "transfer", "konto", "compte", "cuenta"}, {"part", "serial"}),
    "national_id": ({"ssn", "social", "security", "identity", "taxpayer"}, {"part", "serial", "order", "phone"}),
}
#: The score that a pattern and its validator give before the context is read.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3}
REACH = 60
STEP = 0.25
THRESHOLD = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _local.match(text, start - 1):
            start -= 1
        if start < at and (m := _host.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A match may run on into the words after the number, so its ends at word edges are tried, the last first."""
    m = _iban.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        for end in range(m.end(), start + 14, -1):
            if text[end - 1] == " " or (end < m.end() and text[end] != " "):
                continue
            code = text[start:end].replace(" ", "")
            if 15 <= len(code) <= 34 and len(code) == IBAN_LENGTHS.get(code[:2], len(code)) and mod97(code):
                yield start, end
                at = end
                break
        m = _iban.search(text, at)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _digit.search(text):
        return
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _card.finditer(text):
        digits = re.sub(r"[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", a, b) for a, b in _ibans(text))
    for m in _national.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "national_id", m.start(), m.end()


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _word.findall(text, max(0, start - REACH), start)} | \
           {w.lower() for w in _word.findall(text, end, end + REACH)}
    good, bad = CONTEXT[kind]
    return min(1.0, max(0.0, PRIOR[kind] + STEP * (len(near & good) - len(near & bad))))


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text in order of kind, then start.

    The four base kinds are kept whatever their score; the added kinds only from
    ``THRESHOLD`` on and where no base span overlaps.
    """
    if not text:
        return []
    found = [Span(k, a, b, scored(text, k, a, b)) for k, a, b in _proposed(text)]
    base = [s for s in found if s.kind in BASE]
    more = [s for s in found if s.kind not in BASE and s.score >= THRESHOLD
            and not any(s.start < b.end and b.start < s.end for b in base)]
    return base + more


def _joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: counts by base kind, spans and scores.

    Offsets are code points, ends exclusive.  ``base`` and ``spans`` join
    kind:start:end by kind and start; ``scores`` follows ``spans``.  Null and empty
    texts have none; repeated rows repeat; other columns are not read.  Map-only; every
    pattern takes time in proportion to the text.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [spans_of(t) for t in batch["text"].to_pylist()]
            base = [[s for s in x if s.kind in BASE] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch["key"],
                 *(pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in BASE),
                 pa.array([_joined(x) for x in base], pa.string()), pa.array([_joined(x) for x in found], pa.string()),
                 pa.array([[s.score for s in x] for x in found], pa.list_(pa.float64()))],
                ["key", *(f"n_{k}" for k in BASE), "base", "spans", "scores"])

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, {counts}, base string, spans string, scores array<double>")
            .withColumnRenamed("key", key))


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind; of overlapping spans one mark stays."""
    if not text or not (found := sorted(spans_of(text), key=lambda s: (s.start, -s.end))):
        return text
    parts, end = [], 0
    for s in found:
        if s.start >= end:
            parts += [text[end:s.start], f"<{s.kind.upper()}>"]
        end = max(end, s.end)
    return "".join([*parts, text[end:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with spans masked and ``length``, if there, renewed."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            out = [redacted(t) for t in batch[text].to_pylist()]
            place = batch.schema.get_field_index(text)
            batch = batch.set_column(place, batch.schema.field(place), pa.array(out, batch[text].type))
            yield batch

    masked = docs.mapInArrow(run, docs.schema)
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        masked = masked.withColumn(length, F.length(text).cast(kind))
    return masked
