"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits and identifier cues. At each,
a local parser expands to the left and right as far as its kind's characters go, validates, and gives a span (code
points, end exclusive). A parser never looks at what an earlier one of its kind has taken, so any text takes time in
proportion to its length, and each kind's spans are leftmost and don't overlap.

Kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits); and by cue, sign or scheme: account
(a cue, then 6 to 20 digits), iban (the country's length, check digits), ipv6 (with a group of four digits), login (user and
host after a scheme), secret (an access key id, or a value assigned to a cue such as password or token), ssn (3-2-4
digits), street (a house number, up to four capitalised words and a street's type).

Defined cases: null text is empty; no spans are an empty list; other columns are ignored.
"""

from __future__ import annotations

import functools
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "ipv6", "login", "secret", "ssn", "street")
_HEX = frozenset("0123456789ABCDEFabcdef:")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:?#]++(?::[^\s/@?#]*+)?@[A-Za-z0-9.-]+(?::[0-9]{1,5})?")
_ASSIGNED = re.compile(r"[ \t]{0,4}[=:][ \t]{0,4}(['\"]?)")
_VALUE = re.compile(r"[A-Za-z0-9+/=_.-]*")
_KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:[ \t]{0,4}(?:no\.?|number|nr\.?|num\.?|#|:|=)){0,3}[ \t]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
_SSN = re.compile(r"(?:[ \t]{0,4}(?:no\.?|number|#|:|=)){0,3}[ \t]{0,4}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])", re.I)
_IBAN = re.compile(r"[ \t:]{0,4}([A-Z]{2})[0-9]{2}")
_HOUSE = re.compile(r"(?<!\w)[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'-]{0,30} ){1,4}$")
#: Characters of an account number of each country.
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Types of streets.
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "Court", "Square", "Terrace", "St.", "Ave.", "Rd.", "Ln.", "Blvd.")
#: Cues, in lower case; found as such, capitalised and in upper case.
CUES = {"secret": ("password", "passwd", "token", "api_key", "apikey", "secret"), "account": ("account", "acct", "konto", "cuenta", "compte"), "ssn": ("ssn", "social security"), "iban": ("iban",)}


@functools.cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    anchors = {"@": "email", ":": "colon", "://": "login", "+": "phone", "AKIA": "key"} | {str(d): "digit" for d in range(10)}
    for kind, cues in CUES.items():
        anchors |= {form: kind for cue in cues for form in (cue, cue.capitalize(), cue.upper())}
    anchors |= {f" {street}": "street" for street in STREETS}
    for anchor, kind in anchors.items():
        out.add_word(anchor, (kind, len(anchor)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The span of an account number at a place: as many characters as its country's have, a space between any two."""
    head = _IBAN.match(text, at)
    chars, plain = IBAN_CHARS.get(head.group(1), 0) if head else 0, ""
    start = end = head.start(1) if chars else 0
    while len(plain) < chars and end < len(text):
        c = text[end]
        if c.isascii() and (c.isdigit() or c.isupper()):
            plain += c
        elif c != " " or text[end - 1] == " ":
            break
        end += 1
    if not chars or len(plain) < chars or text[end : end + 1].isalnum():
        return None
    return (start, end) if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None


def _ipv6(run: str) -> bool:
    if run.count(":") < 2 or not any(len(x) == 4 for x in run.split(":")):
        return False
    try:
        return bool(ipaddress.IPv6Address(run))
    except ValueError:
        return False


def find(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by kind as listed, then start."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "run", "cards", "hex", "value"), 0)

    def add(kind: str, start: int, end: int) -> None:
        if start >= done[kind]:
            spans.append((kind, start, end))
            done[kind] = end

    for last, (kind, size) in _automaton().iter(text):
        at, after = last + 1 - size, last + 1
        if kind == "digit":
            if at >= done["run"]:
                run = _DOTTED.match(text, at)
                done["run"] = run.end()
                if "." in (found := run.group()) and len(parts := found.split(".")) >= 4:
                    start = at
                    for k in range(0, len(parts) - 3, 4):
                        own = parts[k : k + 4]
                        end = start + sum(map(len, own)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                            spans.append(("ip", start, end))
                        start = end + 1
            if at >= done["cards"]:
                run = _CARD.match(text, at)
                done["cards"] = run.end() if run else after
                if run and 13 <= len(digits := run.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    spans.append(("card", at, run.end()))
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (host := _DOMAIN.match(text, after)):
                add("email", start, host.end())
        elif kind == "phone":
            if number := _PHONE.match(text, at):
                if 9 <= sum("0" <= c <= "9" for c in number.group()) <= 15:
                    spans.append(("phone", at, number.end()))
        elif kind == "login":
            start = at
            while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            if start < at and (host := _LOGIN.match(text, after)):
                add("login", start, host.end())
        elif kind == "key":
            if (key := _KEY_ID.match(text, after)) and not (at and text[at - 1].isalnum()):
                add("secret", at, key.end())
        elif kind == "secret":
            if value := _ASSIGNED.match(text, after):
                quote, start = value.group(1), value.end()
                if start >= done["value"]:  # else within a run whose end is known
                    done["value"] = _VALUE.match(text, start).end()
                end = done["value"]
                if end - start >= 8 and text.startswith(quote, end):
                    add("secret", start, end)
        elif kind == "colon":
            if at >= done["hex"]:
                start = at
                while start > done["hex"] and text[start - 1] in _HEX:
                    start -= 1
                end = after
                while end < len(text) and text[end] in _HEX:
                    end += 1
                done["hex"] = end
                own = end - 1 if text[end - 1] == ":" and text[end - 2] != ":" else end  # as before a line's end
                if not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum() and _ipv6(text[start:own]):
                    spans.append(("ipv6", start, own))
        elif kind == "street":
            low = max(0, at - 140)
            house = _HOUSE.search(text[low : at + 1])
            if house and not text[after : after + 1].isalnum() and (low == 0 or house.start() > 0):
                add("street", low + house.start(), after)
        elif kind == "iban":
            if found := _iban(text, after):
                add(kind, *found)
        elif found := {"account": _NUMBER, "ssn": _SSN}[kind].match(text, after):
            add(kind, found.start(1), found.end(1))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): each row's spans, an array of (kind, start, end)."""
    small_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(text) if text else [] for text in batch.column(1).to_pylist()]
            flat = [s for row in rows for s in row]
            structs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())], ["kind", "start", "end"])
            ends = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), structs)], ["id", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)
