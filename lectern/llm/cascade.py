"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a sample, on the
executors. Rules then run in the order of rejections per second, and a text
leaves at the first rule that rejects it. The order changes the time that is
spent, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, narrow

SYMBOLS = "#*$%&|<>"
#: Rows the order of the rules is estimated from.
SAMPLE_ROWS = 1000
_BLANKS = "\t\n\x0b\x0c\r "
_WORDS = re.compile(rf"[^{_BLANKS}]+")


class Stats:
    """Statistics of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORDS.findall(self.text)

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(_BLANKS)]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur more than once, first occurrences included."""
        if self.n_words < 4:
            return 0
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], dtype=np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, window, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        repeated = np.flatnonzero(n[window] > 1)
        inside = np.zeros(len(ids), dtype=bool)
        for shift in range(3):
            inside[repeated + shift] = True
        return int(inside.sum())

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Stats], bool]


RULES = (
    Rule("few_words", lambda s: s.n_words < 50),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
    Rule("symbols", lambda s: 100 * s.n_symbols > 20 * s.n_words),
    Rule("repeated_lines", lambda s: 100 * s.n_dup_lines > 40 * s.n_lines),
    Rule("few_distinct_words", lambda s: 100 * s.n_distinct < 20 * s.n_words),
    Rule("word_length", lambda s: 2 * s.word_chars < 5 * s.n_words or s.word_chars > 12 * s.n_words),
    Rule("upper_case", lambda s: 100 * s.n_upper > 40 * s.n_letters),
)


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """rule -> (seconds per row, share rejected) on about ``sample_rows`` rows; an empty sample gives zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rule in rules:
                began = time.perf_counter()
                rejected = sum(bool(rule.rejects(Stats(text))) for text in batch["text"])
                found.append((rule.name, len(batch), time.perf_counter() - began, rejected))
            yield pd.DataFrame(found, columns=["rule", "rows", "seconds", "rejected"])

    sample = hash_sample(narrow(df, text=text_col), sample_rows, "text")
    measured = sample.mapInPandas(run, "rule string, rows long, seconds double, rejected long")
    sums = measured.groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    found = {r.rule: (r.seconds / r.rows, r.rejected / r.rows) for r in sums.collect() if r.rows}
    return {rule.name: found.get(rule.name, (0.0, 0.0)) for rule in rules}


def ordered(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing by cost; ties by name."""
    cost = {name: max(seconds, 1e-9) for name, (seconds, _) in measured.items()}
    return sorted(rules, key=lambda r: (-measured[r.name][1] / cost[r.name], cost[r.name], r.name))


def verdict(text: Column, rules: Sequence[Rule], wanted: Sequence[str] = ()) -> Column:
    """struct(kept, failed_rule, wanted statistics) of a text column, with the rules in the given order.

    ``failed_rule`` is the first that rejects in this order, null if none
    does. A null text is judged as the empty text. The whole text counts.
    """
    fields = "kept boolean, failed_rule string" + "".join(f", {name} long" for name in wanted)

    @F.pandas_udf(fields)
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for text in batch:
            stats = Stats(text)
            failed = next((rule.name for rule in rules if rule.rejects(stats)), None)
            rows.append((failed is None, failed, *[getattr(stats, name) for name in wanted]))
        table = pd.DataFrame(rows, columns=["kept", "failed_rule", *wanted])
        return table.astype({"kept": bool, "failed_rule": object} | dict.fromkeys(wanted, "int64"))

    return run(text)


def screen(
    df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", wanted: Sequence[str] = ()
) -> DataFrame:
    """id, kept, failed_rule and the wanted statistics of every row of ``df``; repeated rows repeat."""
    order = ordered(rules, estimate(df, rules, text_col))
    rows = narrow(df, id=id_col, text=text_col).select("id", verdict(F.col("text"), order, wanted).alias("found"))
    return rows.select(F.col("id").alias(id_col), "found.*")
