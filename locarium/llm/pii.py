"""Personal data: expressions propose spans, validators confirm, context words score.

Each kind has a proposer (a regular expression, matched leftmost and without
overlap), a validator (Luhn for cards, mod 97 for bank account numbers, ranges
and digit counts for the rest) and words that raise its score when they stand
near. Base kinds are always reported once they are valid; for the others, the
score decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table, text_udf
from .secret_scan import digest_columns

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs, and starts only where a run starts: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an international bank account number."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    free, at = 0, text.find("@")
    last = -1
    while at >= 0:
        low = max(free, last + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        last = at
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            yield m.span()


def _ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


@dataclass(frozen=True)
class Kind:
    name: str
    propose: object
    prior: float
    context: tuple[str, ...]
    base: bool = True
    numeric: bool = True


#: Kinds in the order in which equal starts are listed.
KINDS = (
    Kind("email", emails, 0.9, ("email", "e-mail", "mail", "contact", "write"), numeric=False),
    Kind("ip", _ips, 0.6, ("ip", "address", "server", "host", "login")),
    Kind("card", _cards, 0.7, ("card", "credit", "visa", "payment", "cvv", "account")),
    Kind("phone", _phones, 0.7, ("phone", "call", "tel", "mobile", "fax", "contact")),
    Kind("iban", _ibans, 0.8, ("iban", "bank", "account", "transfer"), False),
    Kind("ssn", _ssns, 0.3, ("ssn", "social", "security", "taxpayer"), False),
)
SCHEMA = "kinds array<string>, starts array<int>, ends array<int>, scores array<double>"
_WORD = re.compile(r"[a-z-]+")


def find_pii(text: str, kinds: tuple[Kind, ...] = KINDS, window: int = 60, boost: float = 0.3, least: float = 0.5):
    """(start, kind index, end, score), by start, then kind.

    The score is the kind's prior, plus ``boost`` if one of its context words
    stands within ``window`` code points before or after, 1 at most. Spans of
    kinds that aren't base need a score of ``least``.
    """
    found = []
    numbers = _DIGIT.search(text) is not None
    for k, kind in enumerate(kinds):
        if kind.numeric and not numbers:
            continue
        for start, end in kind.propose(text):
            near = text[max(0, start - window) : start] + " " + text[end : end + window]
            score = min(1.0, kind.prior + boost * (not set(_WORD.findall(near.lower())).isdisjoint(kind.context)))
            if kind.base or score >= least:
                found.append((start, k, end, score))
    found.sort()
    return found


def pii_spans(kinds: tuple[Kind, ...] = KINDS, **scoring):
    """A column function: text -> struct of parallel arrays kinds, starts, ends, scores."""

    def make():
        def one(text: str) -> tuple:
            found = find_pii(text, kinds, **scoring)
            return [kinds[k].name for _, k, _, _ in found], [a for a, *_ in found], [e for _, _, e, _ in found], [s for *_, s in found]

        return one

    return text_udf(make, SCHEMA)


def scan_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, **scoring) -> DataFrame:
    """doc_id and one struct column ``found`` of span arrays for every row of docs.

    A null or empty text has no spans; repeated rows are scanned each; other
    columns of docs are not read, so clashing names don't matter. Long texts
    take time in proportion to their length.
    """
    return docs.select("doc_id", pii_spans(kinds, **scoring)("text").alias("found"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = scan_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *digest_columns(F.col("found"), [k.name for k in KINDS if k.base]), F.col("found.scores").alias("scores"))
