"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust a score.

Edge cases: a null text counts as empty and gives a row without spans; a null id stays null; repeated rows each give a
row; spans of one kind never overlap, spans of two kinds may, and of equal starts the kind listed first comes first; a very
long text is looked at whole, in one task, in time that grows with its length; other columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Kinds in the order of results; the last is what the method adds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: what fails at the run's start fails there as well.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: As it is stored or as it is printed, in groups parted by a blank.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
NOT_DIGIT = re.compile("[^0-9]")
#: Score without context, and words that raise it when they stand within NEAR characters.
START = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": re.compile("mail|contact|write|address", re.I),
    "ip": re.compile(r"\bip\b|server|host|address", re.I),
    "card": re.compile("card|visa|credit|payment", re.I),
    "phone": re.compile("phone|tel|call|mobile|fax", re.I),
    "iban": re.compile("iban|bank|account|konto", re.I),
}
NEAR, BONUS = 40, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """IBAN: four first characters to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """The leftmost matches: the longest local part before each @ that is still free, if a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", free if m else at + 1)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """All confirmed spans by kind as listed, then start; code points, end exclusive."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    free = 0
    for m in IBAN.finditer(text):
        end = iban_end(text, m.start(), m.end(1)) if m.start() >= free else 0
        if end:
            out.append(("iban", m.start(), end))
            free = end
    return out


def iban_end(text: str, start: int, end: int) -> int:
    """Where the number ends that begins here: the longest whole groups that the checksum confirms, or 0."""
    while end - start >= 15:
        code = text[start:end].replace(" ", "")
        if len(code) >= 15 and not text[end : end + 1].isalnum() and mod97(code):
            return end
        end = text.rfind(" ", start, end)
    return 0


def score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
    return min(1.0, START[kind] + BONUS * bool(CONTEXT[kind].search(around)))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, digest of the base spans, all spans and their scores (two decimals)."""

    def scan(batches):
        for batch in batches:
            for part, texts in pieces(batch):
                rows = []
                for text in texts:
                    found = find(text)
                    base = [x for x in found if x[0] in KINDS[:BASE]]
                    rows.append(
                        (
                            *(sum(x[0] == k for x in base) for k in KINDS[:BASE]),
                            hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest(),
                            ",".join(f"{k}:{s}:{e}" for k, s, e in found),
                            ",".join(f"{score(text, *x):.2f}" for x in found),
                        )
                    )
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * BASE + [pa.string()] * 3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)
