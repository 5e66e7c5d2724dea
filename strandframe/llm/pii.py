"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Base kinds (``email ip card phone``) stay whatever their score.  The method adds
account numbers (``iban``, mod 97), device numbers (``imei``, Luhn), social
security numbers (``ssn``), phone numbers without a country code (``local``) and
birth dates (``birth``) whose score, with the words around them, reaches ``LEAST``
and that touch no base span.

Every pattern starts only where a run of its characters starts and never gives
back what it took, so a text takes time in proportion to its length.

Defined results: null and empty texts have no spans; rows are independent.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from strandframe.llm import spans as S

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "imei", "ssn", "local", "birth")
LEAST = 0.6
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a digit whose predecessor isn't one; the digit comes first, which is what a search is quick at
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?=\x20?[A-Z0-9])")
IMEI = re.compile(r"[0-9](?<![0-9][0-9])[0-9]{14}(?![0-9])")
SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NEAR = re.compile(r"[0-9](?<![0-9+.-][0-9])[0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
DATE = re.compile(r"[0-9](?<![0-9/.-][0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]?[/.][0-9]{1,2}[/.](?:19|20)[0-9]{2})(?![0-9/-])")

#: Letters and digits of an account number by country, for the whole registry.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MU": 30, "MT": 31, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Score without context, words that raise it by 0.3, words that lower it by 0.3.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "imei": 0.4, "ssn": 0.4, "local": 0.35, "birth": 0.35}
RAISE = {
    "email": "mail|contact|write|reach", "ip": "ip|address|host|server|login", "card": "card|visa|credit|debit|pay", "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|account|bank|transfer", "imei": "imei|device|serial", "ssn": "ssn|social|security|tax", "local": "phone|tel|call|mobile|fax|contact|text", "birth": "born|birth|dob|birthday",
}
LOWERS = r"version|example|sample|isbn|order|test|invoice"
RAISED = {k: re.compile(rf"\b(?:{v})", re.I) for k, v in RAISE.items()}
LOWERED = re.compile(rf"\b(?:{LOWERS})", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Account numbers: country and check digits to the end, letters as 10-35, remainder 1."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each ``@`` on: its run of local characters and the domain behind it."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return out


def accounts(text: str) -> list[tuple[int, int]]:
    """Account numbers of a known country's length, in one piece or with single spaces, that pass mod 97."""
    out = []
    for m in IBAN.finditer(text):
        left, end, code = LENGTHS.get(m[0][:2], 0) - 4, m.end(), m[0]
        while left > 0 and end < len(text) and (text[end].isascii() and (text[end].isdigit() or text[end].isupper()) or text[end] == " " != text[end - 1]):
            left -= text[end] != " "
            code += text[end].strip()
            end += 1
        if left == 0 and mod97(code) and not (end < len(text) and text[end].isalnum()):
            out.append((m.start(), end))
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    return round(min(1.0, max(0.0, SCORES[kind] + 0.3 * bool(RAISED[kind].search(around)) - 0.3 * bool(LOWERED.search(around)))), 3)


def find(text: str) -> list[S.Span]:
    """All spans by kind, then start."""
    spans = {"email": emails(text) if "@" in text else []}
    if not any(c in text for c in "0123456789"):
        spans |= dict.fromkeys(BASE[1:] + ADDED, [])
    else:
        spans["ip"] = [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        cards = [(m.span(), digits_of(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 15]
        spans["card"] = [s for s, d in cards if 16 <= len(d) <= 19 and luhn(d)]
        spans["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
        spans["iban"] = accounts(text)
        spans["imei"] = [m.span() for m in IMEI.finditer(text) if luhn(m[0])]
        spans["ssn"] = [m.span() for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9"]
        spans["local"] = [m.span() for m in NEAR.finditer(text)]
        spans["birth"] = [m.span() for m in DATE.finditer(text)]
    taken = sorted(s for k in BASE for s in spans[k])
    out = [(k, a, b, score(k, text, a, b)) for k in BASE for a, b in spans[k]]
    for k in ADDED:
        for a, b in spans[k]:
            s = score(k, text, a, b)
            if s >= LEAST and not any(a < y and x < b for x, y in taken):
                out.append((k, a, b, s))
    return out


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "found", clean: str | None = None) -> DataFrame:
    """``keep`` columns, spans ``found`` (kind, start, end, score) and, if named, the text with spans replaced."""
    return S.found(docs, lambda: find, text, keep, name, clean)
