"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, ip, card, phone (the base kinds), then iban, ssn. A span is (kind, start, end, score) in
code points, end exclusive. Base spans are kept whatever their score; the other kinds need MIN_SCORE.
Null text counts as empty and gives no spans. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
MIN_SCORE = 0.7

# A local part is found leftwards from its @, so that long words without an @ cost nothing.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Words within NEAR code points before a span that make its kind likelier.
NEAR = 40
CONTEXT = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
}
#: Before context: a confirmed checksum is strong, a bare pattern of three groups is weak.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
LIFT = 0.35


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    last = 0
    for m in _AT.finditer(text):
        i = m.start()
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < m.start():
            yield i, m.end()
            last = m.end()


def _proposed(text: str):
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans, by kind as listed in KINDS, then start."""
    out = []
    for kind, s, e in _proposed(text):
        before = text[max(0, s - NEAR) : s].lower()
        score = min(1.0, PRIOR[kind] + LIFT * any(w in before for w in CONTEXT[kind]))
        if kind in BASE or score >= MIN_SCORE:
            out.append((kind, s, e, score))
    return out


def redacted(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by <KIND>; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for kind, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(parts) + text[at:] if found else text


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_spans (array of structs) and pii_redacted; other columns stay, but for clashing names, which are replaced.

    A map over rows: no shuffle, one batch of texts in memory. Null text: no spans, and pii_redacted is null."""
    docs = docs.drop("pii_spans", "pii_redacted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", pii_spans {SPANS}, pii_redacted string"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index(text)).to_pylist()
        found = [spans(t) if t else [] for t in texts]
        clean = [t if t is None else redacted(t, f) for t, f in zip(texts, found, strict=True)]
        rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in f] for f in found]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array(clean, pa.string())], names=[*b.schema.names, "pii_spans", "pii_redacted"])

    return map_texts(docs, fn, schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from find_pii's spans."""
    found = find_pii(docs.select("doc_id", "text"))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", one), ",").alias("spans"),
    )


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
