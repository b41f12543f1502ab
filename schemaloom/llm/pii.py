"""Personal data in texts: patterns propose spans, validators confirm them, words nearby move the score.

Four base kinds (email, ip, card, phone) always stay once their validator agrees: byte-sized parts of an
address, Luhn for cards, digit counts for phones. The added kinds are told from other numbers by more than
their shape: ``iban`` by its mod-97 remainder, ``ssn`` by the numbers never given out, ``tel`` (a number
without country code) by nothing but the words around it. Every span's score is its kind's prior, what the
validator adds, and what words in the 48 code points before and 24 after it add or take; added spans stay
from 0.5 on, unless they lie inside a base span.

Spans of one kind are leftmost and do not overlap; a match its validator refuses is dropped without a
second try, but for an IBAN's last short group, which may be the next word. Every pattern takes time in
proportion to the text (runs are matched once, addresses are found from their @), so long texts without
spaces are safe. A row is worked on by itself: no shuffle, no state between rows.

Defined results: null and empty texts have no spans; repeated rows and null ids are rows of their own; only
the two named columns are read (``redact`` keeps the others); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

BEFORE, AFTER, STAYS = 48, 24, 0.5
BASE = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN (no spaces, capitals) leaves the remainder 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """From each @ forwards over the domain and backwards over the run before it, down to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def matches(pattern: str) -> Callable[[str], Iterator[Span]]:
    compiled = re.compile(pattern, re.ASCII)
    return lambda text: (m.span() for m in compiled.finditer(text))


def whole(valid: Callable[[str], bool]) -> Callable[[str], int]:
    """A validator that takes all of a match or nothing; validators return the length that holds (0: none)."""
    return lambda found: len(found) if valid(found) else 0


def _address(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))


def _account(found: str) -> int:
    shorter = re.sub(r" [A-Z0-9]{1,3}\Z", "", found)
    for form in dict.fromkeys((found, shorter)):
        bare = form.replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            return len(form)
    return 0


def _given_out(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Rule:
    """A kind: what proposes its spans, what confirms them, and what words nearby say (for and against)."""

    kind: str
    propose: Callable[[str], Iterator[Span]]
    confirm: Callable[[str], int]
    score: float
    near: str
    against: str = "isbn|sku|serial|version|release|hash|token"
    moves: float = 0.3


# Scores count the validator in. ``near`` and ``against`` are whole words, in any case.
RULES = (
    Rule("email", emails, len, 0.9, "e-?mail|mail|contact|write"),
    Rule("ip", matches(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"), whole(_address), 0.6, "ip|host|server|address"),
    Rule("card", matches(r"[0-9](?:[\x20-]?[0-9])++"), whole(lambda x: 13 <= len(d := digits_of(x)) <= 19 and luhn(d)), 0.7,
         "card|visa|mastercard|credit|debit|karte|carte|tarjeta"),
    Rule("phone", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), whole(lambda x: 9 <= len(digits_of(x)) <= 15), 0.7,
         "tel|telephone|phone|call|fax|mobile|cell|telefon|mobil|portable|llamar"),
    Rule("iban", matches(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _account, 0.6,
         "iban|bic|swift|bank|account|konto|kontonummer|compte|cuenta"),
    Rule("ssn", matches(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"), whole(_given_out), 0.4, "ssn|social|security|taxpayer|insurance"),
    Rule("tel", matches(r"\b[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b"), len, 0.3,
         "tel|telephone|phone|call|fax|mobile|cell|telefon|mobil|portable|llamar"),
)


def words(alternatives: str) -> re.Pattern:
    return re.compile(rf"\b(?:{alternatives})\b", re.ASCII | re.IGNORECASE)


class Finder:
    def __init__(self, rules=RULES, before: int = BEFORE, after: int = AFTER, stays: float = STAYS):
        self.rules = [(r, words(r.near), words(r.against)) for r in rules]
        self.before, self.after, self.stays = before, after, stays

    def find(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, base, score) by kind as listed, then start; code points, end exclusive."""
        out: list = []
        if not text:
            return out
        numbers, inside = _DIGIT.search(text) is not None, None
        for rule, near, against in self.rules:
            base = rule.kind in BASE
            if not numbers and rule.propose is not emails:
                continue
            for start, end in rule.propose(text):
                end = start + rule.confirm(text[start:end])
                if end == start:
                    continue
                around = f"{text[max(0, start - self.before):start]}\n{text[end:end + self.after]}"
                score = rule.score + rule.moves * ((near.search(around) is not None) - (against.search(around) is not None))
                if not base:
                    inside = inside or _covered(out)
                    if score < self.stays or inside(start, end):
                        continue
                out.append((rule.kind, start, end, base, min(1.0, max(0.0, score))))
        return out


def _covered(spans: list) -> Callable[[int, int], bool]:
    """Whether a span lies inside one of these (all base kinds come first): the furthest end by start."""
    order = sorted((s, e) for _, s, e, _, _ in spans)
    starts, furthest = [s for s, _ in order], list(accumulate((e for _, e in order), max))

    def inside(start: int, end: int) -> bool:
        at = bisect_right(starts, start)
        return at > 0 and furthest[at - 1] >= end

    return inside


def redacted(text: str | None, spans) -> str | None:
    """The text with every span replaced by its kind; spans that overlap become one, under the first's name."""
    if not spans:
        return text
    parts, done = [], 0
    for kind, start, end, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


_FIELDS = ("kinds", "starts", "ends", "bases", "scores")


def _spans(text: Column, settings: dict) -> Column:
    """Spans of a text column as parallel arrays; Python sees the text alone."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(**settings)
        for batch in batches:
            found = [finder.find(t) for t in batch.tolist()]
            yield pd.DataFrame({name: [[s[i] for s in spans] for spans in found] for i, name in enumerate(_FIELDS)}, columns=_FIELDS)

    made = F.pandas_udf(run, "kinds array<string>, starts array<int>, ends array<int>, bases array<boolean>, scores array<double>")
    return made(text)


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, spans): an array of (kind, start, end, base, score), one row per row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), _spans(F.col(text), settings).alias("_found"))
    spans = F.transform(F.arrays_zip(*[f"_found.{name}" for name in _FIELDS]), lambda s: F.struct(
        s["kinds"].alias("kind"), s["starts"].alias("start"), s["ends"].alias("end"), s["bases"].alias("base"), s["scores"].alias("score")))
    return rows.select(F.col("_id").alias(id_col), spans.alias("spans"))


def redact(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The same rows and columns, every span in the text replaced by its kind in brackets."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(**settings)
        for batch in batches:
            yield pd.Series([redacted(t, finder.find(t)) for t in batch.tolist()], dtype=object)

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(text)))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
