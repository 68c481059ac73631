"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period ``q``, at least ``MIN_WORDS``
and ``MIN_REPEATS * q`` long, that no neighbouring word extends. The words of
many texts stand in one array, a separator of its own behind each text, and are
searched together:

1. Suffixes are ranked by their first 1, 2, 4, ... words, each rank being the
   place where its group begins in the suffix array. So the occurrences of any
   block of ``2^k`` words are one interval of the suffix array, and equal ranks
   say that two stretches are equal.
2. A run of period ``q`` holds a block of ``L`` words, ``L`` the largest power
   of two up to ``q`` (8 at least) and the block's place a multiple of ``L``,
   that occurs again ``q`` words on. A wavelet tree over the suffix array gives
   the next occurrence behind a place (range successor), for all blocks at
   once. Only the neighbouring window of less than ``2 L`` places is asked for.
3. Occurrences at most ``L / 2`` apart are a progression: they lie in a stretch
   whose period is their distance. A run of another period maps the stretch
   around the block onto theirs, so the distances of the two left and the two
   right ends are its only candidates; other occurrences are candidates each.
4. A candidate is extended to both sides by the ranks. Of candidates with one
   stretch the smallest is the period.

All of it is exact; work is O(words * log(words)) whatever repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow

MIN_WORDS, MIN_REPEATS = 24, 3
#: Exponent of the smallest block: runs of any period up to 15 hold one of 8 words that recurs.
FIRST = 3
#: Words searched together, about; a longer text is searched by itself.
TOGETHER = 1 << 18


class WaveletTree:
    """Next larger value within a range of an array, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            ones = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            values = np.concatenate([values[~bit], values[bit]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` within ``[low, high)``; -1 if there is none."""
        skip = self._below(low, high, least)
        found = np.flatnonzero(skip < high - low)
        out = np.full(len(low), -1, dtype=np.int64)
        out[found] = self._smallest(low[found], high[found], skip[found])
        return out

    def _below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        count = np.where(bound >> self.bits, high - low, 0)  # a bound beyond all values
        for ones, b in zip(self.ones, range(self.bits - 1, -1, -1), strict=True):
            up = (bound >> b & 1).astype(bool)
            one_low, one_high = ones[low], ones[high]
            count = count + np.where(up & (bound >> self.bits == 0), (high - low) - (one_high - one_low), 0)
            zeros = self.n - ones[-1]
            low, high = np.where(up, zeros + one_low, low - one_low), np.where(up, zeros + one_high, high - one_high)
        return count

    def _smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), dtype=np.int64)
        for ones in self.ones:
            one_low, one_high = ones[low], ones[high]
            n_zero = (high - low) - (one_high - one_low)
            up = k >= n_zero
            value = value << 1 | up
            k = np.where(up, k - n_zero, k)
            zeros = self.n - ones[-1]
            low, high = np.where(up, zeros + one_low, low - one_low), np.where(up, zeros + one_high, high - one_high)
        return value


class Suffixes:
    """Ranks of all suffixes by their first ``2^k`` words, and the sizes of the groups of equal ones."""

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        by = np.argsort(words, kind="stable")
        new = np.flatnonzero(np.diff(words[by], prepend=words[by[0]] - 1))
        lengths = np.diff(np.append(new, n))
        rank, size = np.empty(n, np.int64), np.empty(n, np.int64)
        rank[by], size[by] = np.repeat(new, lengths), np.repeat(lengths, lengths)
        self.ranks, self.sizes = [rank], [size]
        active = by  # suffixes that share their rank, in the order of their ranks
        while 1 << len(self.ranks) <= longest:
            rank, size = self.ranks[-1], self.sizes[-1]
            active = active[size[active] > 1]
            if len(active):
                after = active + (1 << len(self.ranks) - 1)
                follows = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
                key = rank[active] * (n + 1) + follows
                by = np.argsort(key, kind="stable")
                active, key = active[by], key[by]
                base = rank[active]
                starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
                lengths = np.diff(np.append(starts, len(key)))
                bases = np.flatnonzero(np.diff(base, prepend=-1))
                first = np.repeat(bases, np.diff(np.append(bases, len(base))))
                rank, size = rank.copy(), size.copy()
                rank[active] = base + np.repeat(starts, lengths) - first
                size[active] = np.repeat(lengths, lengths)
            self.ranks.append(rank)
            self.sizes.append(size)

    def array(self) -> np.ndarray:
        """The suffix array, sorted as deep as blocks go."""
        return np.argsort(self.ranks[-1], kind="stable")

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on."""
        n, total = len(self.ranks[0]), np.zeros(len(a), dtype=np.int64)
        top = len(self.ranks) - 1
        again = np.ones(len(a), dtype=bool)
        while again.any():  # the largest power may fit in several times
            at = np.maximum(a, b) + total
            again &= (at < n) & (self.ranks[top][np.minimum(a + total, n - 1)] == self.ranks[top][np.minimum(b + total, n - 1)])
            total += again << top
        for k in range(top - 1, -1, -1):
            at = np.maximum(a, b) + total
            same = (at < n) & (self.ranks[k][np.minimum(a + total, n - 1)] == self.ranks[k][np.minimum(b + total, n - 1)])
            total += same << k
        return total

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before ``a`` and ``b``, these excluded."""
        total = np.zeros(len(a), dtype=np.int64)
        top = len(self.ranks) - 1

        def same(k: int) -> np.ndarray:
            x, y = a - total - (1 << k), b - total - (1 << k)
            fits = np.minimum(x, y) >= 0
            return fits & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)])

        again = np.ones(len(a), dtype=bool)
        while again.any():
            again &= same(top)
            total += again << top
        for k in range(top - 1, -1, -1):
            total += same(k) << k
        return total

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the widest stretch of the period around ``at``."""
        return at - self.common_before(at, at + period), at + period + self.common_after(at, at + period)


def _candidates(suffixes: Suffixes, k: int, tree: WaveletTree, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, distance) of what may be a run's period, from the blocks of ``2^k`` words."""
    length = 1 << k
    blocks = np.arange(0, len(place) - length, length)
    rank, size = suffixes.ranks[k][blocks], suffixes.sizes[k][blocks]
    live = size > 1
    blocks, rank, size = blocks[live], rank[live], size[live]
    low = place[rank]
    high = low + size
    end = blocks + 2 * length
    now = tree.successor(low, high, blocks + (1 if k == FIRST else length))
    while True:
        live = (now >= 0) & (now < end)
        if not live.any():
            return
        blocks, low, high, end, now = blocks[live], low[live], high[live], end[live], now[live]
        later = tree.successor(low, high, now + 1)
        step = later - now
        close = (later >= 0) & (later < end) & (2 * step <= length)
        yield blocks[~close], (now - blocks)[~close]
        b, p, d = blocks[close], now[close], step[close]
        if len(b):
            begin, stop = suffixes.stretch(b, d)
            begin2, stop2 = suffixes.stretch(p, d)
            same = begin == begin2
            yield b, np.where(same, d, begin2 - begin)
            yield b, np.where(same, d, stop2 - stop)
            last = p + (stop2 - length - p) // d * d
            later[close] = tree.successor(low[close], high[close], last + 1)
        now = later


def find(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    ``words`` are numbers of words; texts are divided by numbers that occur
    once, the last of them at the end. ``longest`` is the words of the longest.
    """
    none = np.empty((0, 3), dtype=np.int64)
    if longest < MIN_WORDS:
        return none
    suffixes = Suffixes(words, max(longest // MIN_REPEATS, 1 << FIRST))
    ordered = suffixes.array()
    # a suffix whose first words occur once is in no interval that is asked for
    shared = suffixes.sizes[FIRST][ordered] > 1
    if not shared.any():
        return none
    place = np.concatenate([[0], np.cumsum(shared)])
    tree = WaveletTree(ordered[shared])
    found = []
    for k in range(FIRST, len(suffixes.ranks)):
        for at, period in _candidates(suffixes, k, tree, place):
            fits = (period > 0) & (at + period < len(words))
            at, period = at[fits], period[fits]
            if len(at):
                begin, end = suffixes.stretch(at, period)
                enough = end - begin >= np.maximum(MIN_WORDS, MIN_REPEATS * period)
                found.append(np.stack([begin, end - begin, period], axis=1)[enough])
    rows = np.concatenate(found) if found else none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split(text: bytes | None) -> list[bytes]:
    """The words of a text; ``bytes.split`` divides at the six ASCII blanks."""
    return (text or b"").split()


def of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, given as its words."""
    out: list[np.ndarray] = []
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    bounds = [0]

    def flush() -> None:
        lengths = np.diff(bounds)
        rows = find(np.array(flat, dtype=np.int64), int(lengths.max(initial=1)) - 1)
        cuts = np.searchsorted(rows[:, 0], bounds)
        for i in range(len(bounds) - 1):
            mine = rows[cuts[i] : cuts[i + 1]].copy()
            mine[:, 0] -= bounds[i]
            out.append(mine)
        numbers.clear()
        flat.clear()
        bounds[1:] = []

    for words in texts:
        if flat and len(flat) + len(words) > TOGETHER:
            flush()
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
        flat.append(-len(bounds))  # a separator that occurs once
        bounds.append(len(flat))
    if flat:
        flush()
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The text without what runs repeat: of each run its first period stays, unless another run drops it."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run repeated most often; ties: the smallest start, then period."""
    if not len(runs):
        return None
    return min(map(tuple, runs.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None
) -> DataFrame:
    """id, n_runs, runs (array of start, length, period; word numbers from 0), best (the strongest), collapsed (text) of every row.

    A null, empty or wordless text has no word, no run and the collapsed text
    "". Repeated rows and ids are rows of their own, an empty table gives none.
    A text of any length is searched whole. ``change`` maps (id, words) to the
    words that are searched in their stead. A task holds one Arrow batch; there
    is no shuffle, so no key can be hot.
    """
    kind = df.select(f"`{id_col}`").dtypes[0][1]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, n = [], 0
                while at + len(texts) < batch.num_rows and (not texts or n < TOGETHER):
                    row = at + len(texts)
                    words = split(batch.column(1)[row].as_py())
                    texts.append(change(batch.column(0)[row].as_py(), words) if change else words)
                    n += len(texts[-1])
                found = of_texts(texts)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for runs in found]
                best = [strongest(runs) for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(r) for r in found], pa.int64()),
                        pa.array(rows, pa.list_(run_type)),
                        pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], run_type),
                        pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_runs", "runs", "best", "collapsed"],
                )
                at += len(texts)

    run = "struct<start:long,length:long,period:long>"
    rows = narrow(df, id=id_col, text=text_col).selectExpr("id", "cast(text AS binary) AS text")
    return rows.mapInArrow(search, f"id {kind}, n_runs long, runs array<{run}>, best {run}, collapsed string")
