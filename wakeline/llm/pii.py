"""Personal data in whole texts by anchor expansion: an automaton finds anchors, local parsers find the bounds.

One Aho-Corasick automaton reads each text once and stops at at-signs, plus signs, digits, ``://`` and
the words that announce an account, a bank code or a secret. From there a parser that never looks
further than its own match expands and validates: e-mail addresses around an at-sign; internet
addresses and card numbers from the first digit of a run; phone numbers from a plus sign; logins and
bracketed addresses behind a scheme; account numbers, bank codes (checked modulo 97), social security
numbers and secrets behind a cue. Texts are prose for the most part, so most of their characters are
seen by the automaton only.

``find_personal`` gives the spans, ``redacted`` the texts without them.

Defined results
    The four base kinds are leftmost and non-overlapping within a kind; a match that fails its check is
    dropped, and the search goes on behind it. Added kinds never overlap a base span; of added spans that overlap the one
    that begins first stays, at ties the kind named first. Null or empty text: no spans; texts are read whole; a null
    doc_id is kept; repeated rows give repeated rows; an empty table gives no rows; other columns are
    ignored.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .text import pieces

# The contract's kinds in order; then those of the method.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "ip6", "iban", "ssn", "account", "secret")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

# Words that announce something, and what.
CUES = {
    "iban": "iban", "bank account": "account", "account": "account", "acct": "account", "passport": "account", "konto": "account", "cuenta": "account", "compte": "account",
    "ssn": "ssn", "social security": "ssn",
    "password": "secret", "passwd": "secret", "secret": "secret", "token": "secret", "api_key": "secret", "api-key": "secret", "apikey": "secret", "api key": "secret", "access_key": "secret", "secret_key": "secret", "private_key": "secret",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_FOUR = re.compile(r"[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_LOGIN = re.compile(r"[^\s/?#@:\[\]]{1,256}+:[^\s/?#@]{1,256}+(?=@)")
_BRACKETS = re.compile(r"\[([0-9A-Fa-f:.]{2,45})\]")
_NUMBER_WORD = r"(?:[ \t]{1,3}(?:number|no\.?|nr\.?|num\.?))?+[ \t]{0,3}+[:=#]?+[ \t]{0,3}+"
_IBAN = re.compile(r"(?:[ \t]{1,3}(?:number|no\.?|nr\.?))?+[ \t]{0,3}+[:=#]?+[ \t]{0,3}+([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(_NUMBER_WORD + r"([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9])", re.I)
_ACCOUNT = re.compile(_NUMBER_WORD + r"([A-Za-z]{0,2}[0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])", re.I)
_SECRET = re.compile(r"[\"']?[ \t]{0,3}+[:=][ \t]{0,3}+[\"']?([A-Za-z0-9_+/.=-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _below_256(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _iban(text: str) -> int:
    """Length of the code that ``text`` begins with: the longest one, up to a space or the end, whose remainder is 1; else 0."""
    for end in (len(text), *(i for i in range(len(text) - 1, 14, -1) if text[i] == " ")):
        code = text[:end].replace(" ", "")
        if len(code) >= 15 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return 0


def _secret(text: str) -> int:
    return len(text) if any(c.isdigit() for c in text) and any(c.isalpha() for c in text) else 0


class Finder:
    """The automaton and its parsers; ``spans`` keeps no state between texts."""

    def __init__(self, cues: dict[str, str] = CUES):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for digit in "0123456789":
            self.automaton.add_word(digit, ("digit", 1))
        for word, kind in {"@": "email", "+": "phone", "://": "scheme"}.items():
            self.automaton.add_word(word, (kind, len(word)))
        for word, kind in cues.items():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()
        self.behind = {"iban": (_IBAN, _iban), "ssn": (_SSN, len), "account": (_ACCOUNT, len), "secret": (_SECRET, _secret)}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """``kind, start, end`` by start, then kind; code points, end exclusive."""
        base: list[tuple[int, int, int]] = []
        more: list[tuple[int, int, int]] = []
        mail = chain = four = 0  # where the search of a kind goes on
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: no length changes
        for last, (anchor, size) in self.automaton.iter(lowered):
            at = last - size + 1
            if anchor == "digit":
                if at >= chain:
                    chain = _CHAIN.match(text, at).end()
                    if 14 <= chain - at <= 37:
                        digits = _NO_DIGIT.sub("", text[at:chain])
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            base.append((at, 2, chain))
                if at >= four:
                    found = _FOUR.match(text, at)
                    four = found.end() if found else _DIGITS.match(text, at).end()
                    if found and all(map(_below_256, found[0].split("."))):
                        base.append((at, 1, four))
            elif anchor == "email":
                begin = at
                while begin > mail and text[begin - 1] in _LOCAL:
                    begin -= 1
                found = _DOMAIN.match(text, at + 1) if begin < at else None
                if found:
                    base.append((begin, 0, found.end()))
                    mail = found.end()
            elif anchor == "phone":
                found = _PHONE.match(text, at)
                if found and 10 <= len(_NO_DIGIT.sub("", found[0])) <= 15:
                    base.append((at, 3, found.end()))
            elif anchor == "scheme":
                found = _LOGIN.match(text, at + 3)
                if found:
                    more.append((found.start(), 4, found.end()))
                found = _BRACKETS.match(text, found.end() + 1 if found else at + 3)
                if found:
                    try:
                        ipaddress.IPv6Address(found[1])
                    except ValueError:
                        continue
                    more.append((found.start(1), 5, found.end(1)))
            elif at == 0 or not lowered[at - 1].isalnum():
                parser, length = self.behind[anchor]
                found = parser.match(text, last + 1)
                n = length(found[1]) if found else 0
                if n:
                    more.append((found.start(1), KINDS.index(anchor), found.start(1) + n))
        return [(KINDS[kind], start, end) for start, kind, end in self._merged(sorted(base), sorted(more))]

    @staticmethod
    def _merged(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not more:
            return base
        kept, i, covered, done = [], 0, 0, 0
        for span in more:
            while i < len(base) and base[i][0] < span[2]:  # base spans that begin before this one ends
                covered = max(covered, base[i][2])
                i += 1
            if span[0] >= max(covered, done):
                kept.append(span)
                done = span[2]
        return sorted(base + kept)


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"


def _batches(batches: Iterator[pa.RecordBatch], cues: dict[str, str]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[str, int, int]]]]]:
    finder = Finder(cues)
    for part in pieces(batches):
        yield part, [finder.spans(t) if t else [] for t in part.column("text").to_pylist()]


def find_personal(documents: DataFrame, cues: dict[str, str] = CUES) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base), a row per row of ``doc_id, text``."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, cues):
            rows = [[{"kind": k, "start": s, "end": e, "base": k in BASE_KINDS} for k, s, e in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(rows, schema.field("spans").type)], schema=schema)

    return lean(documents).select("doc_id", "text").mapInArrow(run, SPANS)


def redacted(documents: DataFrame, cues: dict[str, str] = CUES) -> DataFrame:
    """``doc_id, text`` with ``<kind>`` in place of every span; of spans that overlap the one that begins first is named. Null stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])

    def cleaned(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, cues):
            texts = [cleaned(t, s) for t, s in zip(part.column("text").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.large_string())], schema=schema)

    return lean(documents).select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text, of what ``find_personal`` returns."""
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE_KINDS), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
