"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, URL schemes
and the cue words of identifiers.  A deterministic parser for each kind expands an
anchor to its boundaries and validates what it found.  The base kinds (email, ip,
card, phone) accept exactly what these patterns match, leftmost and without overlap
within a kind; the added kinds (url, iban, secret) are spans of their own.

Defined results: a null text is the empty text and has no spans; offsets count code
points; rows are independent of each other, so repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, trimmed

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "secret")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
SCHEMES = ("http://", "https://", "ftp://")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
KEY_CUES = ("AKIA", "ASIA")
SECRET = LETTERS | DIGITS | frozenset("_-+/=.")
UPPER_OR_DIGIT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("secret", len(form)))
    for cue in KEY_CUES:
        a.add_word(cue, ("key", len(cue)))
    for cue in ("IBAN", "iban"):
        a.add_word(cue, ("iban", 4))
    a.make_automaton()
    return a


def _email(t: str, at: int, least: int) -> tuple[int, int] | None:
    start = at
    while start > least and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end = len(t), at + 1
    while end < n and t[end] in LABEL:
        end += 1
    if end == at + 1:
        return None
    dots = 0
    while end + 1 < n and t[end] == "." and t[end + 1] in LABEL:
        end += 2
        while end < n and t[end] in LABEL:
            end += 1
        dots += 1
    return (start, end) if dots else None


def _run(t: str, i: int) -> int:
    n = len(t)
    while i < n and t[i] in DIGITS:
        i += 1
    return i


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _ip(t: str, at: int) -> tuple[int, int | None, bool]:
    """(where to go on, end of a match or None, whether its parts are valid) for a run of digits at ``at``."""
    end, parts = _run(t, at), 1
    ok = _byte(t[at:end])
    n = len(t)
    while parts < 4:
        if end + 1 < n and t[end] == "." and t[end + 1] in DIGITS:
            first = end + 1
            end = _run(t, first)
            ok = ok and _byte(t[first:end])
            parts += 1
        else:
            return end, None, False  # a chain too short here is too short from any later part
    return end, end, ok


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _card(t: str, at: int) -> tuple[int, bool]:
    """(end of the chain of digits with single separators, whether it is a card)."""
    n, end, digits, count = len(t), at + 1, [t[at]], 1
    while True:
        if end < n and t[end] in DIGITS:
            step = 0
        elif end + 1 < n and t[end] in " -" and t[end + 1] in DIGITS:
            step = 1
        else:
            break
        if count < 20:
            digits.append(t[end + step])
        count += 1
        end += step + 1
    return end, 14 <= count <= 19 and luhn("".join(digits))


def _phone(t: str, plus: int) -> tuple[int, bool] | None:
    """(end, whether the number of digits is right), or None if nothing matches at this plus sign."""
    n = len(t)
    if plus + 1 >= n or t[plus + 1] not in DIGITS:
        return None
    end, last, count, seen = plus + 2, 0, 1, 1
    while end < n and t[end] in PHONE:
        if t[end] in DIGITS:
            seen += 1
            if end >= plus + 3:
                last, count = end, seen
        end += 1
    return (last + 1, 10 <= count <= 15) if last else None


def _url(t: str, start: int, end: int) -> tuple[int, int] | None:
    n, first = len(t), end
    while end < n and t[end] not in URL_END:
        end += 1
    while end > first and t[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end > first and (t[first] in LABEL) else None


def _iban(t: str, end: int) -> tuple[int, int] | None:
    n = len(t)
    while end < n and t[end] in " :#=":
        end += 1
    start, got = end, []
    while end < n and len(got) < 34 and (t[end] in UPPER_OR_DIGIT or t[end] == " " and got and end + 1 < n and t[end + 1] in UPPER_OR_DIGIT):
        if t[end] != " ":
            got.append(t[end])
        end += 1
    code = "".join(got)
    if len(code) < 15 or not (code[:2].isalpha() and code[2:4].isdigit()):
        return None
    return (start, end) if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def _secret(t: str, start: int, end: int) -> tuple[int, int] | None:
    """cue, optional blanks, = or :, optional blanks and quote, then at least 8 characters with a digit."""
    n = len(t)
    while end < n and t[end] in " \t":
        end += 1
    if end >= n or t[end] not in "=:":
        return None
    end += 1
    while end < n and t[end] in " \t":
        end += 1
    if end < n and t[end] in "\"'":
        end += 1
    first = end
    while end < n and t[end] in SECRET:
        end += 1
    while end > first and t[end - 1] == ".":
        end -= 1
    value = t[first:end]
    return (first, end) if len(value) >= 8 and not DIGITS.isdisjoint(value) else None


def _key(t: str, start: int, end: int) -> tuple[int, int] | None:
    if start and t[start - 1] in LETTERS | DIGITS:
        return None
    n = len(t)
    while end < n and t[end] in UPPER_OR_DIGIT:
        end += 1
    return (start, end) if end - start == 20 and not (end < n and t[end] in LETTERS) else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), sorted by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    free = dict.fromkeys(("email", "ip", "card", "phone", "url", "iban", "secret"), 0)  # where a kind may start again
    for last, (what, size) in _automaton().iter(text):
        at = last + 1 - size
        if what == "digit":
            if at >= free["ip"]:
                go, end, ok = _ip(text, at)
                free["ip"] = go
                if ok and end:
                    spans.append(("ip", at, end))
            if at >= free["card"]:
                free["card"], ok = _card(text, at)
                if ok:
                    spans.append(("card", at, free["card"]))
        elif what == "at":
            if at >= free["email"] and (found := _email(text, at, free["email"])):
                spans.append(("email", *found))
                free["email"] = found[1]
        elif what == "plus":
            if at >= free["phone"] and (number := _phone(text, at)):
                free["phone"] = number[0]
                if number[1]:
                    spans.append(("phone", at, number[0]))
        elif what == "url":
            if at >= free["url"] and (found := _url(text, at, last + 1)):
                spans.append(("url", *found))
                free["url"] = found[1]
        elif what == "iban":
            if at >= free["iban"] and (found := _iban(text, last + 1)):
                spans.append(("iban", *found))
                free["iban"] = found[1]
        elif at >= free["secret"] and (found := (_secret if what == "secret" else _key)(text, at, last + 1)):
            spans.append(("secret", *found))
            free["secret"] = found[1]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or union of overlapping spans, becomes the name of its first kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [find_spans(t) if t else [] for t in b.column(1).to_pylist()]
        base = [[s for s in spans if s[0] in BASE] for spans in found]
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *counts, pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base]),
             pa.array([listed(s) for s in found], pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _find, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by the name of its kind; texts without any stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redact(t, s) if t and (s := find_spans(t)) else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(trimmed(run), docs.schema)
