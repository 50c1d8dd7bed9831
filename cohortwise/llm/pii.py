"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds the anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. From each anchor a local parser takes the characters its kind may hold, to the left
and right as needed, and validates them. The result equals a scan of the whole text with the kind's
pattern, but no character is tried twice for the same kind: a long run of digits or of letters before
an at-sign, on which such a scan takes quadratic time, is passed once.

Kinds of the base set are email, ip, card and phone. The method adds `address` (an URL's authority
that holds credentials or a numeric host) and `account` (a value behind an identifier cue such as
`iban:` or `password=`), neither of which changes a base span.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map

# The kinds in the order of the result, and the patterns of the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The words that announce an account or secret, and URL schemes.
CUES = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key",
    "account", "iban", "ssn", "passport", "username", "user_id",
)
SCHEMES = ("://",)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN_OF = {
    "number": re.compile(r"[0-9]+"),
    "card": re.compile(r"[0-9 -]+"),
    "phone": PHONE,
    "domain": re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "authority": re.compile(r"[^\s/?#<>\"']+"),
    "value": re.compile(r"[ ]?[:=#][ ]?([A-Za-z0-9][A-Za-z0-9_+/.-]{4,}[A-Za-z0-9=])"),
}
_NUMERIC_HOST = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?|\[[0-9A-Fa-f:.]+\](?::\d+)?")
Span = tuple[int, int, int]


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in CUES:
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str | None) -> list[Span]:
    """Spans (kind number, start, end) of a text, in the order of kinds and then starts; none for NULL."""
    spans: list[Span] = []
    if not text:
        return spans
    # how far each parser has read: an anchor before that lies in a run already parsed
    mail_to = ip_to = card_to = 0
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_to:
                hit = IP.match(text, at)  # a match takes whole numbers, so the next one starts at a number too
                ip_to = (hit or _RUN_OF["number"].match(text, at)).end()
                # a part is short unless it is zero-padded; int() of a huge run of digits is refused
                if hit and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in hit[0].split(".")):
                    spans.append((1, hit.start(), hit.end()))
            if at >= card_to:
                run = _RUN_OF["card"].match(text, at)
                card_to = run.end()
                for hit in CARD.finditer(text, at, card_to):
                    digits = _digits(hit[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans.append((2, hit.start(), hit.end()))
        elif kind == "plus":
            hit = PHONE.match(text, at)
            if hit and 8 <= len(_digits(hit[0])) <= 15:
                spans.append((3, hit.start(), hit.end()))
        elif kind == "at":
            start = at
            while start > mail_to and text[start - 1] in _LOCAL:
                start -= 1
            domain = start < at and _RUN_OF["domain"].match(text, at + 1)
            if domain:
                mail_to = domain.end()
                spans.append((0, start, mail_to))
        elif kind == "scheme":
            host = _RUN_OF["authority"].match(text, last + 1)
            if host and ("@" in host[0] or _NUMERIC_HOST.fullmatch(host[0])):
                spans.append((4, host.start(), host.end()))
        else:
            value = _RUN_OF["value"].match(text, last + 1)
            if value and any("0" <= c <= "9" for c in value[1]):
                spans.append((5, value.start(1), value.end(1)))
    return sorted(set(spans))


def listing(spans: list[Span], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end in spans if k < kinds)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by the upper-case name of its first kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: (doc_id, spans array of (kind, start, end), redacted).

    Offsets are code points, ends exclusive. NULL and empty texts have no spans; a NULL text stays
    NULL. Repeated rows and NULL ids are rows as any other; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find(t) for t in texts]
            yield {
                "doc_id": batch.column(0),
                "spans": [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans] for spans in found],
                "redacted": [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)],
            }

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>, redacted string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of `find`: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [find(t) for t in batch.column(1).to_pylist()]
            yield {
                "doc_id": batch.column(0),
                **{f"n_{name}": [sum(s[0] == k for s in spans) for spans in found] for k, name in enumerate(BASE)},
                "base_sha256": [hashlib.sha256(listing(s, len(BASE)).encode()).hexdigest() for s in found],
                "spans": [listing(s) for s in found],
                "n_added": [sum(s[0] >= len(BASE) for s in spans) for spans in found],
            }

    counts = ", ".join(f"n_{name} long" for name in BASE)
    schema = f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced and `n_chars` brought up to date; same columns and rows."""
    schema = docs.schema
    names = schema.names
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [t and redact(t, find(t)) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                old = columns[chars].to_pylist()
                new = [n if t is None or n is None else len(t) for t, n in zip(texts, old, strict=True)]
                columns[chars] = pa.array(new, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(docs, work, schema)
