"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs,
scheme marks (``://``), plus signs, digits and identifier cues.  From each anchor
a small deterministic parser expands to the left and right, fixes the span's
boundaries and validates it.  Every parser moves a cursor of its kind forward,
so spans of a kind never overlap, the leftmost wins, and no part of the text is
read more than a few times.

Kinds, in this order: email, ip, card (Luhn), phone; and, added by cues and
schemes: url_login (address with user information), iban (mod 97), ssn, account
(number after an account cue), secret (value after a password, token or key cue).

Scale: texts are scanned where they are read; no shuffle; memory is one batch.

Defined cases: a null or empty text has no spans (digest of the empty string);
offsets are code points, ends exclusive; repeated rows and null ids pass
through; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "ssn", "account", "secret")
BASE = KINDS[:4]
#: Identifier cues and the kind that their parser looks for.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account",
        "compte": "account", "password": "secret", "passwd": "secret", "token": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret"}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP_REST = re.compile(r"(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]*")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_IBAN = re.compile(r"[\x20:=#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20:=#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|number|nr|id)\b\.?)?[\x20:=#]{0,4}([0-9](?:[\x20-]?[0-9]){6,33})(?![0-9])", re.I)
_SECRET = re.compile(r"\x20?[:=]\x20?[\"']?([A-Za-z0-9_+/=-]{12,})")


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for mark in ("@", "://", "+", *"0123456789"):
        out.add_word(mark, (mark[0], len(mark)))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str, a: int, b: int) -> str:
    return "".join(c for c in text[a:b] if "0" <= c <= "9")


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class Scan:
    """Spans of one text; each method expands one anchor."""

    def __init__(self, text: str):
        self.text, self.found = text, []
        self.email_at = self.ip_at = self.card_at = self.phone_at = self.login_at = self.cue_at = self.run_at = 0

    def email(self, at: int):
        start = at
        while start > self.email_at and self.text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.found.append((start, 0, m.end()))
            self.email_at = m.end()

    def digit(self, at: int):
        if at >= self.card_at:
            m = _CARD.match(self.text, at)
            self.card_at = m.end() if m else at + 1
            if m and m.end() - at >= 14:
                digits = _digits(self.text, at, m.end())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    self.found.append((at, 2, m.end()))
        if at >= self.run_at:
            # only the start of a digit run can open an address: whatever follows the run is the same for its later digits
            self.run_at = _DIGITS.match(self.text, at).end()
            if at >= self.ip_at and (m := _IP_REST.match(self.text, self.run_at)):
                self.ip_at = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in self.text[at:m.end()].split(".")):
                    self.found.append((at, 1, m.end()))

    def phone(self, at: int):
        if at >= self.phone_at and (m := _PHONE.match(self.text, at)):
            self.phone_at = m.end()
            if 10 <= len(_digits(self.text, at, m.end())) <= 15:
                self.found.append((at, 3, m.end()))

    def scheme(self, at: int):
        start = at
        while start > self.login_at and self.text[start - 1] in _SCHEME:
            start -= 1
        m = _AUTHORITY.match(self.text, at + 3)
        user, sign, host = m[0].rpartition("@")
        self.login_at = m.end()
        if start < at and sign and user and host:
            self.found.append((start, 4, m.end()))

    def cue(self, kind: str, end: int):
        if end < self.cue_at:
            return
        m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT, "secret": _SECRET}[kind].match(self.text, end)
        if not m or kind == "iban" and not iban(m[1]) or kind == "secret" and not any(c.isdigit() for c in m[1]):
            return
        self.found.append((m.start(1), KINDS.index(kind), m.end(1)))
        self.cue_at = m.end()

    def run(self) -> list[tuple[int, int, int]]:
        for last, (kind, size) in automaton().iter(self.text):
            at = last - size + 1
            if kind == "@":
                self.email(at)
            elif kind == "+":
                self.phone(at)
            elif kind == ":":
                self.scheme(at)
            elif len(kind) == 1:
                self.digit(at)
            else:
                self.cue(kind, last + 1)
        return sorted(self.found)


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all spans, by start and then kind."""
    return Scan(text).run() if text else []


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _find(batches):
    for batch in batches:
        found = [spans(t) for t in batch.column("text").to_pylist()]
        counts = [[sum(k == j for _, k, _ in f) for f in found] for j in range(len(BASE))]
        base = [hashlib.sha256(_joined([x for x in f if x[1] < len(BASE)]).encode()).hexdigest() for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                                          pa.array([_joined(f) for f in found], pa.string())],
                                         names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per input row: doc_id, counts of the base kinds, base_sha256, and all spans as kind:start:end."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _mask(batches):
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            at, parts = 0, []
            for start, kind, end in spans(text):
                if start >= at:
                    parts += [text[at:start], f"<{KINDS[kind]}>"]
                    at = end
                elif end > at:
                    at = end
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "masked"])


def mask(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, masked): texts with every span replaced by its kind."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_mask, "doc_id long, masked string")
