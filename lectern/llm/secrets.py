"""Secret scans: known forms by pattern, unknown ones by sliding-window entropy.

A run of key-like characters is a candidate. A window slides over it with
counts that change by one character at each step; where the Shannon entropy
of the window reaches what random characters of the candidate's class have,
the windows are a span. Runs of letters and digits within a candidate are
scanned too, by the limit of their own class, so what a key is glued to does not
raise its limit. Candidates of the allow-list are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow

#: Fixed patterns of the known forms: kind, pattern, counted group, least characters of it.
FORMS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = (*[form[0] for form in FORMS], "entropy")
WINDOW = 20


class CharacterClass(NamedTuple):
    """Candidates made of these characters alone, and the bits a window needs."""

    name: str
    pattern: str
    bits: float


#: The first class that a candidate matches decides. Words in one case are text, whatever their entropy. The bits are what 95 of
#: 100 random windows of the class's smallest alphabet have: 16, 32, 52, 62 and 64 characters.
CLASSES = (
    CharacterClass("digits", r"[0-9_=+/-]+", math.inf),
    CharacterClass("word", r"[a-z_=+/-]+|[A-Z_=+/-]+|[A-Z][a-z_=+/-]+", math.inf),
    CharacterClass("hex", r"[0-9a-f]+|[0-9A-F]+", 3.0),
    CharacterClass("one case", r"[a-z0-9]+|[A-Z0-9]+", 3.46),
    CharacterClass("letters", r"[A-Za-z]+", 3.7),
    CharacterClass("alnum", r"[A-Za-z0-9]+", 3.6),
    CharacterClass("base64", r"[A-Za-z0-9+/_=-]+", 3.75),
)
#: A word in one case or capitalised, or several capitalised ones.
_NAME = r"[A-Z]?[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}[0-9]{0,2}(?:[A-Z]{1,4}[a-z]{2,}[0-9]{0,2}|By|To|Of|In|On|At|Is|Or|As)+"
#: Candidates that look random and are no secrets: identifiers, slugs, checksums that are named as such, names of capitalised words.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(sha1|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/=_-]+",
    rf"({_NAME})([-_/]({_NAME}))+[-_/]?",
    r"(.)\1+",
    _NAME,
)
_CANDIDATES = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Parts of a candidate, and the characters whose maximal runs within it are scanned by themselves.
_PART = re.compile(r"[A-Za-z0-9]+")
_RUNS = tuple(re.compile(rf"[{chars}]{{{WINDOW},}}") for chars in ("A-Za-z0-9", "0-9a-f", "0-9A-F", "A-Za-z"))


def entropy_spans(text: str, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal unions of windows of ``text`` with at least ``bits`` bits of entropy, as (start, end)."""
    cost = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    limit = window * (math.log2(window) - bits) + 1e-9  # H >= bits if the sum of n log n is at most this
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for at, new in enumerate(text):
        n = counts.get(new, 0)
        counts[new] = n + 1
        total += cost[n + 1] - cost[n]
        if at >= window:
            old = text[at - window]
            n = counts[old]
            counts[old] = n - 1
            total += cost[n - 1] - cost[n]
        if at >= window - 1 and total <= limit:
            start = at - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch, sorted."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scanner(classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED):
    """A function from a text to its spans (start, kind number, end), sorted."""
    forms = [(re.compile(p, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least) for kind, p, group, least in FORMS]
    kinds = [(re.compile(c.pattern), c.bits) for c in classes]
    passes = [re.compile(p) for p in allowed]

    def bits_of(run: str) -> float:
        return next((bits for pattern, bits in kinds if pattern.fullmatch(run)), math.inf)

    def runs(candidate: str) -> set[tuple[int, int]]:
        """(start, end) of the runs to scan; a part that the allow-list knows, also by the part before, has none."""
        found, before = set(), 0
        for part in _PART.finditer(candidate):
            if part.end() - part.start() >= WINDOW and not any(
                p.fullmatch(candidate, at, part.end()) for p in passes for at in (before, part.start())
            ):
                found |= {m.span() for run in _RUNS for m in run.finditer(candidate, *part.span())}
            before = part.start()
        return found

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = []
        for number, (pattern, group, least) in enumerate(forms):
            found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        known = list(found)
        for m in _CANDIDATES.finditer(text):
            candidate = m[0]
            bits = bits_of(candidate)
            if bits == math.inf or any(p.fullmatch(candidate) for p in passes):
                continue
            random = entropy_spans(candidate, bits)
            for a, b in runs(candidate) - {(0, len(candidate))}:
                limit = bits_of(candidate[a:b])
                if limit < math.inf:
                    random += [(a + start, a + end) for start, end in entropy_spans(candidate[a:b], limit)]
            for start, end in merged(random):
                start, end = m.start() + start, m.start() + end
                if not any(s <= start and end <= e for s, _, e in known):
                    found.append((start, len(forms), end))
        return sorted(found)

    return scan


def spans(text: Column, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> Column:
    """array<struct<kind, start, end>> of a text column, by start, then kind; code points, end exclusive.

    A null text has none. Entropy spans that lie inside a known form are left
    out; nothing removes a known form.
    """

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner(classes, allowed)
        for batch in batches:
            yield pd.Series(
                [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] if t else [] for t in batch], dtype=object
            )

    return run(text)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every row of ``df``, whole texts; repeated rows repeat."""
    rows = narrow(df, id=id_col, text=text_col)
    return rows.select(F.col("id").alias(id_col), spans(F.col("text")).alias("spans"))
