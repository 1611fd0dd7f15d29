"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_texts, prepare

Match = tuple[int, int]

# The base patterns. Look-behinds keep the search from starting anew inside a run that it has
# already rejected; `_email` and `_runs` say why no match is lost.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = re.compile(rf"{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_START = re.compile(rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Spans the method adds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")

NEAR = 40  # code points on either side that count as context
REPORT = 0.5  # added spans with a lower score are left out

# Confidence of a confirmed match, before context; and the words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.35}
RAISE = {
    "email": "mail contact write", "ip": "ip host server address login", "card": "card visa mastercard credit payment",
    "phone": "phone call tel mobile fax", "iban": "iban account bank transfer", "national_id": "ssn social security id tax",
}
LOWER = "example test sample dummy version order invoice"
STEP = 0.2


def _email(text: str) -> Iterator[Match]:
    """A match starts where a run of local characters starts, or right after the match before it."""
    if "@" not in text:
        return
    at = 0
    while found := EMAIL.match(text, at) or EMAIL_START.search(text, at):
        yield found.span()
        at = found.end()


def _runs(pattern: re.Pattern) -> Callable[[str], Iterator[Match]]:
    """Matches of a pattern that starts at the start of a run, or whose runs end where it can't go on."""
    return lambda text: (m.span() for m in pattern.finditer(text))


def _iban(text: str) -> Iterator[Match]:
    """A candidate may run into the words after it: its longest prefix of whole groups that is an account number counts.

    The search goes on right after that prefix, or in the candidate's second group if there is none. Candidates are
    at most 44 characters long, so each place is looked at a bounded number of times.
    """
    at = 0
    while found := IBAN.search(text, at):
        start, end = found.span()
        ends = [end, *(i for i in range(end - 1, start, -1) if text[i] == " ")]
        stop = next((e for e in ends if account(text[start:e])), None)
        if stop:
            yield start, stop
        at = stop or start + 1


def _small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    doubled = (d * 2 - 9 if d > 4 else d * 2 for d in digits[1::2])
    return 12 <= len(digits) <= 19 and (sum(digits[::2]) + sum(doubled)) % 10 == 0


def mod97(text: str) -> bool:
    """The account number's check: moved to the end, letters as 10 to 35, the rest by 97 is 1."""
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account(text: str) -> bool:
    """An account number of its country's length, where that is known, with a right check."""
    return IBAN_LENGTHS.get(text[:2], len(text) - text.count(" ")) == len(text) - text.count(" ") and mod97(text)


def _phone_digits(text: str) -> bool:
    return 9 <= sum(c.isdigit() for c in text) <= 15


def _issued(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Detector:
    kind: str
    propose: Callable[[str], Iterator[Match]]
    confirm: Callable[[str], bool]


DETECTORS = (
    Detector("email", _email, lambda t: True),
    Detector("ip", _runs(IP), _small_parts),
    Detector("card", _runs(CARD), luhn),
    Detector("phone", _runs(PHONE), _phone_digits),
    Detector("iban", _iban, account),
    Detector("national_id", _runs(NATIONAL), _issued),
)

_WORDS = {k: re.compile(r"\b(?:" + "|".join(w.split()) + r")", re.I) for k, w in RAISE.items()}
_LOWER = re.compile(r"\b(?:" + "|".join(LOWER.split()) + r")\b", re.I)


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    value = PRIOR[kind]
    value += STEP if _WORDS[kind].search(around) else 0.0
    value -= STEP if _LOWER.search(around) else 0.0
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; places in code points, end exclusive.

    Base kinds are reported whenever they are confirmed; added kinds need a score of at least REPORT.
    """
    spans = []
    for order, d in enumerate(DETECTORS):
        for start, end in d.propose(text):
            if d.confirm(text[start:end]):
                points = score(text, d.kind, start, end)
                if d.kind in BASE_KINDS or points >= REPORT:
                    spans.append((start, order, end, points))
    return [(KINDS[order], start, end, points) for start, order, end, points in sorted(spans)]


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_email, n_ip, n_card, n_phone, base_sha256, spans and found (kind, start, end, score).

    Whole texts are searched, one row per input row; null text counts as empty. Repeated rows and null ids are
    searched like others; extra columns are left out, an empty table gives no rows. Spans that start together go by the
    order of their kinds. Each pattern is linear in the text, however long.
    """
    prepare(docs.sparkSession)

    def work():
        def joined(spans: list) -> str:
            return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)

        def batch(texts: list) -> dict[str, list]:
            found = [find(t) if t else [] for t in texts]
            base = [[x for x in spans if x[0] in BASE_KINDS] for spans in found]
            return {
                **{f"n_{k}": [sum(x[0] == k for x in spans) for spans in base] for k in BASE_KINDS},
                "base_sha256": [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base],
                "spans": [joined(spans) for spans in found],
                "found": [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans] for spans in found],
            }

        return batch

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    found = "array<struct<kind:string,start:bigint,`end`:bigint,score:double>>"
    return map_texts(docs, f"{kept}, {counts}, base_sha256 string, spans string, found {found}", work, keep)
