"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and cues such as ``IBAN`` or ``password=``.  A deterministic parser
per anchor expands it to the whole span and validates it.  A text is passed once
and each parser moves only forwards, so the cost is linear in its length.

Offsets are code points, ends exclusive.  Spans of one kind never overlap; spans
of different kinds may.

Cases: a null text counts as empty and has no spans; empty tables give empty
results; repeated rows each give their own row; texts of any length are held
one batch at a time.  Only the two named columns are read, so other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .store import small_batches
from .vocab import release

# The four base kinds, in the order of the result, and those that cues add.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
PERSONAL_KINDS = tuple(k for k in KINDS if k != "url")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
_IBAN = re.compile(r"[\x20:]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?([A-Za-z0-9+/_.-]{8,})")
_AWS = re.compile(r"AKIA([A-Z0-9]{16})(?![A-Za-z0-9])")

# Cues that start a parser, each in lower, upper and title case.
_SCHEMES = ("http://", "https://", "ftp://")
_SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "secret")

# Characters of an account number by country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", _SCHEMES), ("secret", _SECRET_CUES), ("iban", ("iban",))):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.add_word("AKIA", ("aws", 4))
    found.make_automaton()
    return found


_AUTOMATON = None


def _anchors(text: str):
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    return _AUTOMATON.iter(text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _valid_iban(value: str) -> bool:
    value = value.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban_end(run: str) -> int:
    """Where the valid account number that begins a run of groups ends, 0 if none does: at its country's length, else with the last group that makes it valid."""
    ends = [k for k in range(len(run), 0, -1) if k == len(run) or run[k] == " "]
    own = _IBAN_LENGTHS.get(run[:2])
    ends.sort(key=lambda k: k - run.count(" ", 0, k) != own)
    return next((k for k in ends if _valid_iban(run[:k])), 0)


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in ascending order."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not text:
        return spans
    end_of = dict.fromkeys(KINDS, 0)
    run_end = 0
    for last, (anchor, width) in _anchors(text):
        at = last - width + 1
        if anchor == "digit":
            if at < run_end:
                continue
            run_end = _DIGITS.match(text, at).end()
            if at >= end_of["ip"] and text.startswith(".", run_end) and (m := _IP.match(text, at)):
                end_of["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                    spans["ip"].append(m.span())
            if at >= end_of["card"] and (m := _CARD.match(text, at)):
                end_of["card"] = m.end()
                if m.end() - at >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(m.span())
        elif anchor == "at":
            start = at
            while start > end_of["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end_of["email"] = m.end()
                spans["email"].append((start, m.end()))
        elif anchor == "plus":
            if m := _PHONE.match(text, at):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans["phone"].append(m.span())
        elif anchor == "scheme":
            if at >= end_of["url"] and (m := _URL_REST.match(text, last + 1)):
                end = at + len(text[at : m.end()].rstrip(".,;:!?)"))
                end_of["url"] = end
                spans["url"].append((at, end))
        elif anchor == "iban":
            if (m := _IBAN.match(text, last + 1)) and m.start(1) >= end_of["iban"] and (width := _iban_end(m.group(1))):
                end_of["iban"] = m.start(1) + width
                spans["iban"].append((m.start(1), end_of["iban"]))
        else:
            m = _AWS.match(text, at) if anchor == "aws" else _ASSIGNED.match(text, last + 1)
            group = 0 if anchor == "aws" else 1
            if m and m.start(group) >= end_of["secret"] and any(c.isdigit() for c in m.group(1)):
                end_of["secret"] = m.end(group)
                spans["secret"].append(m.span(group))
    return spans


def render(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in spans[kind])


def redact(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if text is None:
        return None
    found = sorted((a, -b, kind) for kind, pairs in find_spans(text).items() if kind in kinds for a, b in pairs)
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def detect_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, a count per base kind, a digest of the base spans, all spans, and ``n_personal``, the spans of all kinds but URLs.

    Narrow: no shuffle, one Arrow pass over the two columns.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_personal"]

    def row(text: str | None) -> tuple:
        spans = find_spans(text)
        base = render(spans, BASE_KINDS)
        return *(len(spans[k]) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), render(spans, KINDS), sum(len(spans[k]) for k in PERSONAL_KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = [pa.int64()] * len(BASE_KINDS) + [pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            columns = zip(*(row(text.as_py()) for text in batch.column(1)), strict=True) if batch.num_rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = f"doc_id {id_type}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_personal bigint"
    return docs.select(id_col, text_col).mapInArrow(scan, schema)
