"""Personal data: patterns propose spans, checksums confirm them, and words nearby adjust their scores.

The base kinds follow fixed patterns and are always reported. Further kinds are reported where their score reaches
``THRESHOLD``: bank account numbers pass their country's length and the mod-97 check; local phone numbers and national
numbers have no checksum and need a word of their kind nearby. A word that speaks of samples or orders lowers a score.
All scans are linear in the text, whatever it holds: e-mail addresses start from each ``@``, and no pattern may begin
within a run that an earlier start has already failed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import slices, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "national_id")
KINDS = (*BASE, *ADDED)
THRESHOLD = 0.5
#: Code points looked at before and after a span for words of its kind.
BEFORE, AFTER = 60, 30
RAISE, LOWER = 0.3, 0.3
#: Scores without any word nearby: 1 less the chance, as set by hand, that a confirmed match is something else.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3, "national_id": 0.3}
_SUPPORT = {
    "email": "mail|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse|client|login",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|handy|appel|llame",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "local_phone": "phone|tel|call|mobile|fax|telefon|handy|appel|llame",
    "national_id": "ssn|social security|national id|passport|ausweis|sozialversicherung",
}
_AGAINST = re.compile(r"\b(?:example|sample|dummy|order|invoice|version|beispiel|exemple|ejemplo)\b", re.IGNORECASE)
_NEAR = {kind: re.compile(rf"\b(?:{words})\b", re.IGNORECASE) for kind, words in _SUPPORT.items()}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start within a run of digits fails as the run's first digit did, so it need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
_NATIONAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digit sums added: a multiple of ten."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) << (place & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Country and check digits moved to the end, letters as 10 to 35: remainder 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[Span]:
    """A match is the longest run of local characters before an ``@``, back to the last match, with a domain behind."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        free = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield "email", start, free
        at = text.find("@", free)


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            yield "ip", *m.span()


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield "phone", *m.span()


def _ibans(text: str) -> Iterator[Span]:
    for m in _IBAN.finditer(text):
        left = IBAN_LENGTHS.get(m[0][:2], 0) - 4
        if left <= 0:
            continue
        rest = re.compile(rf"(?:\x20?[A-Z0-9]){{{left}}}(?![A-Za-z0-9])").match(text, m.end())
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield "iban", m.start(), rest.end()


def _national(text: str) -> Iterator[Span]:
    for m in _NATIONAL.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "national_id", *m.span()


def score(text: str, span: Span) -> float:
    """Score of a confirmed span: the kind's own, raised by a word of its kind nearby and lowered by one against it."""
    kind, start, end = span
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    near = RAISE * bool(_NEAR[kind].search(before) or _NEAR[kind].search(after))
    against = LOWER * bool(_AGAINST.search(before) or _AGAINST.search(after))
    return round(min(1.0, max(0.0, SCORES[kind] + near - against)), 3)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and kind, in code points with the end left out.

    Base spans are all reported and may overlap each other. An added span is left out where its score is too low or
    where it overlaps a base span or an added one before it.
    """
    base = [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]
    out = [(*s, score(text, s)) for s in base]
    local = [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    added = sorted([*_ibans(text), *local, *_national(text)], key=lambda s: (s[1], KINDS.index(s[0])))
    taken, at, last = sorted((s[1], s[2]) for s in base) if added else [], 0, 0
    for s in added:
        while at < len(taken) and taken[at][1] <= s[1]:
            at += 1
        if s[1] >= last and not (at < len(taken) and taken[at][0] < s[2]) and (value := score(text, s)) >= THRESHOLD:
            out.append((*s, value))
            last = s[2]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>> of every row, by one scan without a shuffle.

    Null texts count as empty and have no spans; repeated rows and rows without an id are each answered; other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans as text and the highest score."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    top = F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), top)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [_redacted(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, text string")


def _redacted(text: str) -> str:
    out, free = [], 0
    for kind, start, end, _ in find_spans(text):
        if start >= free:
            out += [text[free:start], f"[{kind}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])
