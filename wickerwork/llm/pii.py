"""Personal data by anchors: one Aho-Corasick pass finds at-signs, plus signs, digits, schemes and cue words; a local parser at
each anchor finds where the datum begins and ends and validates it. Each text is worked on by itself, in linear time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wickerwork.llm.common import map_texts, unused

#: The kinds whose spans are fixed by pattern, in the order of the digest; the method's own kinds follow.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address")

#: Words that announce an account number, in four languages.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta")

# The patterns of the four base kinds, each anchored where its parser starts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

# Of the method's own kinds.
_ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number|num)\b\.?)?[\x20:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){5,33})(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"(?:[^\s/@<>\"']{1,256}@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_SCHEMES = frozenset(("http", "https", "ftp", "ftps", "sftp", "ssh", "ldap", "smb"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban(text: str) -> bool:
    """The international check: country and check digits moved to the end, letters as numbers, remainder 1 of 97."""
    return len(text) >= 15 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *sorted(_DIGITS)):
        found.add_word(mark, ("digit" if mark in _DIGITS else mark, len(mark)))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


class Finder:
    """Finds the spans of one text after another; built once in a task."""

    def __init__(self) -> None:
        self.anchors = _anchors()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Spans by kind, in code points, end exclusive, ascending and without overlap within a kind."""
        found: dict[str, list[tuple[int, int]]] = {}
        upto = dict.fromkeys(KINDS, 0)
        run_end = 0
        for last, (anchor, size) in self.anchors.iter(text):
            start = last - size + 1
            if anchor == "digit":
                if start < run_end:
                    continue
                run_end = start + 1
                while run_end < len(text) and text[run_end] in _DIGITS:
                    run_end += 1
                self._number(text, start, found, upto)
                continue
            span = None
            if anchor == "@":
                kind, span = "email", self._email(text, start, upto["email"])
            elif anchor == "+":
                kind = "phone"
                if start >= upto[kind] and (m := _PHONE.match(text, start)):
                    upto[kind] = m.end()
                    if 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                        span = m.span()
            elif anchor == "://":
                kind, span = "address", self._address(text, start, upto["address"])
            else:
                kind, span = "account", self._account(text, start, last + 1, upto["account"])
            if span:
                upto[kind] = span[1]
                found.setdefault(kind, []).append(span)
        return found

    @staticmethod
    def _number(text: str, start: int, found: dict, upto: dict) -> None:
        """IPv4 addresses and card numbers begin at the first digit of a run; a match that fails its test is passed over whole."""
        if start >= upto["ip"] and (m := _IP.match(text, start)):
            upto["ip"] = m.end()
            if all(map(_octet, m.groups())):
                found.setdefault("ip", []).append(m.span())
        if start >= upto["card"] and (m := _CARD.match(text, start)):
            upto["card"] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.setdefault("card", []).append(m.span())

    @staticmethod
    def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        return (start, domain.end()) if domain else None

    @staticmethod
    def _address(text: str, at: int, floor: int) -> tuple[int, int] | None:
        start = at
        while start > floor and at - start < 6 and text[start - 1] in _LETTERS:
            start -= 1
        rest = _ADDRESS.match(text, at + 3) if text[start:at].lower() in _SCHEMES else None
        return (start, at + 3 + len(rest.group().rstrip(".,;:!?)"))) if rest else None

    @staticmethod
    def _account(text: str, cue: int, after: int, floor: int) -> tuple[int, int] | None:
        if cue and text[cue - 1].isalnum():
            return None
        m = _ACCOUNT.match(text, after)
        if not m or m.start(1) < floor:
            return None
        code = m.group(1).replace(" ", "").replace("-", "")
        return m.span(1) if code[0] in _DIGITS or iban(code) else None


def digest(found: dict[str, list[tuple[int, int]]], kinds: Sequence[str]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found.get(kind, ()))


def find_pii(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` of each document with the counts of the base kinds, a digest of their spans, and all spans as text.

    Null and empty texts have no spans. Rows are answered one by one, repeated ones too; other columns stay behind."""
    fields = T.StructType([*[T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def make():
        finder = Finder()

        def work(texts):
            out = [[] for _ in fields.names]
            for value in texts:
                found = finder.spans(value.decode("utf-8", "replace")) if value else {}
                for column, kind in zip(out, BASE_KINDS):
                    column.append(len(found.get(kind, ())))
                out[-2].append(hashlib.sha256(digest(found, BASE_KINDS).encode()).hexdigest())
                out[-1].append(digest(found, KINDS))
            return out
        return work

    return map_texts(docs, text, keep, fields, make)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlapping spans go as one, under the first's kind.
    Columns stay; null texts stay null."""
    names = docs.columns
    made = unused("_redacted", names)
    fields = T.StructType([T.StructField(made, T.StringType())])

    def make():
        finder = Finder()

        def work(texts):
            out = []
            for value in texts:
                if value is None:
                    out.append(None)
                    continue
                whole = value.decode("utf-8", "replace")
                parts, at = [], 0
                for a, b, kind in sorted((a, b, k) for k, spans in finder.spans(whole).items() for a, b in spans):
                    if a >= at:
                        parts += [whole[at:a], f"<{kind}>"]
                    at = max(at, b)
                out.append("".join([*parts, whole[at:]]))
            return [out]
        return work

    return map_texts(docs, text, [c for c in names if c != text], fields, make).withColumnRenamed(made, text).select(*names)
