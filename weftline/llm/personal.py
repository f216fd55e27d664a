"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score.

Four base kinds (email, ip, card, phone) are found by fixed expressions. Beyond them
each proposal has a prior score; a checksum that holds adds to it and one that fails
ends it; a context word within ``CONTEXT`` characters before or after adds to
it, a word that speaks against it takes from it. Proposals at or over ``ACCEPT`` that
do not overlap a base span are added: IBANs (mod 97), US social security numbers,
phone numbers without a plus, and 13-digit cards (Luhn).

A text takes time in proportion to its length and, but for a logarithm, to its
spans. Defined results: null and empty texts have no spans; a very long text is searched whole;
repeated rows each get their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .spans import Span, Taken, span_rows

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "local_phone", "short_card"]
ACCEPT = 0.7
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

#: For each added kind: prior score, words that speak for it, words that speak against it.
RULES = {
    "iban": (0.3, re.compile(r"iban|account|konto|compte|cuenta|bank", re.I), re.compile(r"\bsku\b|serial|part no", re.I)),
    "ssn": (0.4, re.compile(r"\bssn\b|social security|tax ?id", re.I), re.compile(r"order|ticket|isbn|part no", re.I)),
    "local_phone": (0.4, re.compile(r"phone|\btel\b|call|fax|mobile|telefon|téléphone|teléfono", re.I), re.compile(r"order|ticket|isbn|version", re.I)),
    "short_card": (0.3, re.compile(r"card|visa|carte|tarjeta|karte", re.I), re.compile(r"isbn|ean|barcode|gtin", re.I)),
}
CHECKED, NEARBY, AGAINST = 0.4, 0.35, -0.4


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> list[Span]:
    """As the expression [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds them, but from each @ outwards."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _score(kind: str, text: str, start: int, end: int, checked: bool | None) -> float:
    prior, words, against = RULES[kind]
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return 0.0 if checked is False else prior + CHECKED * bool(checked) + NEARBY * bool(words.search(near)) + AGAINST * bool(against.search(near))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that score ``ACCEPT`` or more and lie beside them."""
    base = base_spans(text)
    if not _DIGIT.search(text):
        return base, []
    ibans: list[tuple[int, int, bool | None]] = []
    for m in _IBAN.finditer(text):
        # a longer run may hold words after the number: the longest prefix that checks
        whole = m[0]
        for stop in range(len(whole), 14, -1):
            plain = whole[:stop].replace(" ", "")
            if whole[stop - 1] != " " and (stop == len(whole) or whole[stop] == " ") and 15 <= len(plain) <= 34 and mod97(plain):
                ibans.append((m.start(), m.start() + stop, True))
                break
    cards = [(*m.span(), luhn(digits)) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and len(digits := m[0].replace(" ", "").replace("-", "")) == 13]
    proposed = {"iban": ibans, "ssn": [(*m.span(), None) for m in _SSN.finditer(text)], "local_phone": [(*m.span(), None) for m in _LOCAL_PHONE.finditer(text)], "short_card": cards}
    more: list[Span] = []
    for kind, found in proposed.items():  # those of one kind never overlap one another
        taken = Taken(base + more)
        more += [(kind, s, e) for s, e, checked in found if not taken.meets(s, e) and _score(kind, text, s, e, checked) >= ACCEPT]
    return base, more


def personal_data(docs: DataFrame) -> DataFrame:
    return span_rows(docs, find, KINDS, BASE)
