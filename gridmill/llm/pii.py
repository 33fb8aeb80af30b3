"""Personal data in whole texts by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes (`://`) and cues of
identifiers. From each anchor a local parser that doesn't look back beyond the last span of its
kind expands to the boundaries and validates what it found. The first four kinds follow fixed
grammars, leftmost and without overlap; the others are found beside them and never replace them.

====== ==========================================================================================
email  local part, `@`, labels of a host with one dot at least
ip     four dotted numbers up to 255
card   12 to 19 digits, single blanks or hyphens between them, that pass the Luhn test
phone  `+` and 9 to 15 digits with blanks, brackets, dots and hyphens
iban   after a cue: two letters, two check digits, 11 to 30 more; modulo 97 is 1
account after a cue: 6 to 17 digits, single blanks or hyphens between them
login  `user:secret` in the authority of a URL, whose host must be a name or an address
ipv6   eight groups of hexadecimal digits, or fewer around one `::`, as the address rules have them
tel    the number after `tel:`, 6 to 15 digits without a country code
====== ==========================================================================================

An authority runs from `://` to the next slash, question mark, hash, blank or quote; its user part
ends at its last at-sign, its host is a name of labels, four dotted numbers or an IPv6 address in
square brackets, and a port may follow.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import map_text, slices

KINDS = ("email", "ip", "card", "phone", "iban", "account", "login", "ipv6", "tel")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?:[ :#=]|no\.?|number)*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:no\.?|number|nr\.?|id))?[ :#=]{0,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
AUTHORITY = re.compile(r"[^\s/?#\"'<>]++")
HOST = re.compile(r"(?:\[([0-9A-Fa-f:.]+)\]|[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.?)(?::[0-9]{1,5})?")
USER = re.compile(r"[A-Za-z0-9._~%+-]+:[^\s/@:]+")
GROUPS = re.compile(r"[0-9A-Fa-f:]++(?:\.[0-9]++){0,3}")
TEL = re.compile(r"[0-9](?:[ ().-]?[0-9]){5,14}(?![0-9])")

#: Words that announce an identifier, in lower case; also found capitalised and in capitals.
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")


@cache
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("::", "colons"), ("tel:", "tel"), *((f":{d}", "colons") for d in "0123456789abcdefABCDEF"), *((c, "iban") for c in IBAN_CUES), *((c, "account") for c in ACCOUNT_CUES)):
        for form in {word, word.upper(), word.capitalize()}:
            a.add_word(form, kind)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


HEX = frozenset("0123456789ABCDEFabcdef")


def is_ipv6(text: str) -> bool:
    """Whether a text is an IPv6 address that names more than a place holder; times and short runs are none."""
    if not 8 <= len(text) <= 45 or text.count(":") < 3:
        return False
    try:
        return ipaddress.IPv6Address(text) > ipaddress.IPv6Address("::1")
    except ValueError:
        return False


def is_host(text: str) -> bool:
    """Whether a text is a host, with or without a port."""
    m = HOST.match(text)
    return m is not None and (m[1] is None or is_ipv6(m[1]) or m[1] == "::1")


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, by start and then by kind."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(("at", "ip", "card", "phone", "ipv6"), 0)
    for last, kind in anchors().iter(text):
        if kind == "digit":
            if last >= done["ip"]:
                if m := IP.match(text, last):
                    done["ip"] = m.end()
                    parts = [p.lstrip("0") for p in m[0].split(".")]
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                        spans.append(("ip", last, m.end()))
                else:
                    done["ip"] = DIGITS.match(text, last).end()
            if last >= done["card"]:
                if m := CARD.match(text, last):
                    done["card"] = m.end()
                    if m.end() - last >= 12:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            spans.append(("card", last, m.end()))
        elif kind == "at":
            start = last
            while start > done["at"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                done["at"] = m.end()
                spans.append(("email", start, m.end()))
        elif kind == "plus":
            if last >= done["phone"] and (m := PHONE.match(text, last)):
                done["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append(("phone", last, m.end()))
        elif kind == "scheme":
            if (m := AUTHORITY.match(text, last + 1)) and (k := m[0].rfind("@")) > 0:
                if USER.fullmatch(m[0], 0, k) and is_host(m[0][k + 1 :]):
                    spans.append(("login", m.start(), m.start() + k))
        elif kind == "colons":
            start = text.rfind(":", 0, last + 1) if text[last] != ":" else last - 1
            if start >= done["ipv6"]:
                while start > done["ipv6"] and text[start - 1] in HEX:
                    start -= 1
                m = GROUPS.match(text, start)
                done["ipv6"] = m.end()
                if is_ipv6(m[0]) and not (start and text[start - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum():
                    spans.append(("ipv6", start, m.end()))
        elif kind == "tel":
            if m := TEL.match(text, last + 1):
                spans.append(("tel", m.start(), m.end()))
        elif kind == "iban":
            if m := IBAN.match(text, last + 1):
                code = m[1].replace(" ", "")
                if len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    spans.append(("iban", m.start(1), m.end(1)))
        elif m := ACCOUNT.match(text, last + 1):
            spans.append(("account", m.start(1), m.end(1)))
    spans = list(dict.fromkeys(spans))
    spans.sort(key=lambda s: (s[1], RANK[s[0]], s[2]))
    return spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of kind, start, end), a row for each row of docs, in code points of the whole text.

    A null or empty text has no spans; null ids and repeated rows stay as they are.
    """

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] if t else [] for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, SPANS)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(rows, kernel, "id long, spans array<struct<kind:string,start:long,end:long>>", "text")


def hide(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in capitals: <EMAIL>."""
    out, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with spans replaced in the text; a column of lengths, where there is one, follows. Null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                new = [t and hide(t) for t in part.column(text_col).to_pylist()]
                cols = list(part.columns)
                cols[names.index(text_col)] = pa.array(new, part.schema.field(text_col).type)
                if length_col in names:
                    old = part.column(length_col)
                    cols[names.index(length_col)] = pa.array([o if o is None or t is None else len(t) for o, t in zip(old.to_pylist(), new)], old.type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
