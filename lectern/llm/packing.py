"""Packing of documents into token sequences by minimum bin slack.

A document is its token ids and one end id. It is cut into windows of
``CAPACITY`` ids; each whole window is a sequence of its own, and what remains
of the document is shorter than a window. Remainders are packed bundle by
bundle, a bundle being ``BUNDLE`` of them in the order in which a task meets
them:

* The remainders of a bundle are a multiset of lengths, at most ``CAPACITY - 1``
  different ones. The longest one opens a sequence.
* A subset-sum table over the lengths that are left, one bitset per length,
  says which sums they reach. The multiset whose sum comes closest to what is
  free is read back from the table, with the number of each length, and is
  taken as often as the lengths last.
* Where no multiset fills a sequence, the longest remainder is cut for it, so
  slack is closed too. What is too little for a sequence goes on to the next
  bundle.

At the end of a task's input less than one sequence is left; it is cut at
powers of two, which need no padding. So nothing is padded, and about one
remainder in ten is cut when lengths are spread evenly.

Documents are packed where they are read: there is no shuffle, a task holds one
bundle, and neither the number of documents nor one frequent length changes that.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import narrow

CAPACITY, BUNDLE, END_ID = 1024, 16_384, 0
#: Texts are tokenised in groups of about so many bytes.
GROUP = 4 << 20


def reach(lengths: Iterable[tuple[int, int]], target: int) -> dict[int, int]:
    """How many to take of each of (length, count), so that their sum comes closest to ``target`` without exceeding it.

    Bit ``s`` of a bitset says that the sum ``s`` is reached with the lengths
    so far; a length that may be taken ``c`` times is added in powers of two.
    """
    mask = (1 << target + 1) - 1
    bits, states, seen = 1, [1], []
    for length, count in lengths:
        left, step = min(count, target // length), 1
        while left:
            step = min(step, left)
            bits |= bits << step * length & mask
            left -= step
            step *= 2
        states.append(bits)
        seen.append(length)
        if bits >> target & 1:
            break  # filled; further lengths cannot do better
    total, taken = bits.bit_length() - 1, {}
    for i in range(len(seen) - 1, -1, -1):
        while not states[i] >> total & 1:
            total -= seen[i]
            taken[seen[i]] = taken.get(seen[i], 0) + 1
    return taken


@dataclass
class Piece:
    """``ids`` of the document ``name``, which has ``tokens`` of them, from the id ``start`` on."""

    name: object
    tokens: int
    start: int
    ids: np.ndarray

    def part(self, begin: int, end: int) -> Piece:
        return Piece(self.name, self.tokens, self.start + begin, self.ids[begin:end])


@dataclass
class Packer:
    """Remainders of documents by length, and the sequences made of them."""

    capacity: int = CAPACITY
    by_length: dict[int, deque[Piece]] = field(default_factory=dict)
    total: int = 0

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(len(piece.ids), deque()).append(piece)
        self.total += len(piece.ids)

    def _take(self, length: int) -> Piece:
        held = self.by_length[length]
        piece = held.popleft()
        if not held:
            del self.by_length[length]
        self.total -= length
        return piece

    def _cut(self, length: int, size: int) -> Piece:
        """The first ``size`` ids of a remainder of ``length`` ids; the others stay a remainder."""
        piece = self._take(length)
        if size < length:
            self.add(piece.part(size, length))
        return piece.part(0, size)

    def fill(self) -> Iterator[list[Piece]]:
        """Full sequences as long as there is enough for one."""
        while self.total >= self.capacity:
            lengths = sorted(self.by_length, reverse=True)
            first = lengths[0]
            counts = ((x, len(self.by_length[x]) - (x == first)) for x in lengths)
            taken = reach(counts, self.capacity - first)
            taken[first] = taken.get(first, 0) + 1
            slack = self.capacity - sum(x * n for x, n in taken.items())
            # a pattern with slack is closed by a cut, which changes the lengths
            times = 1 if slack else min(len(self.by_length[x]) // n for x, n in taken.items())
            for _ in range(times):
                made = [self._take(x) for x, n in taken.items() for _ in range(n)]
                if slack:
                    made.append(self._cut(max(self.by_length), slack))
                yield made

    def rest(self) -> Iterator[list[Piece]]:
        """What is too little for a sequence, in sequences whose sizes are powers of two."""
        while self.total:
            free, made = 1 << self.total.bit_length() - 1, []
            while free:
                fits = [x for x in self.by_length if x <= free]
                size = max(fits) if fits else free
                made.append(self._cut(size if fits else max(self.by_length), size))
                free -= size
            yield made


#: How the byte-level tokenizer divides a text into words before it merges bytes, a fixed value, in the classes of ``re``.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters that libraries may not agree on, whether they are letters, numbers or blank. Not among them: Latin, Greek and
#: Cyrillic letters, the usual dashes, quotes and symbols, kana, and the common ideographs and Hangul syllables.
_DOUBTFUL = re.compile(
    "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0500-\u200f\u2028-\u202f\u205f-\u3040\u3097-\u30a0\u30fb-\u4dff\u9fa6-\uabff\ud7a4-\U0010ffff]"
)
#: New words that are encoded as one text.
JOINED = 200
#: Words whose ids a task keeps, and characters of a text that are divided at once.
HELD_WORDS, SPAN = 400_000, 1 << 20
_SEAM = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


class _Numbers(dict):
    """Words in the order in which they were met; a new word gets the next number."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Texts to token ids by the tokenizer of a file.

    A byte-level tokenizer merges bytes within words only, so each distinct
    word is encoded once and a text is a lookup of its words. Any other
    tokenizer gets whole texts, and so do texts that hold one of its special
    tokens or a character that is not surely divided alike.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_words = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
            and made["model"]["type"] == "BPE"
            and not made["normalizer"]
            and not made["truncation"]
        )
        self.words = re.compile(WORDS)
        if self.by_words:
            # a byte is one character of a token's name
            names = made["model"]["vocab"]
            self.bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)
            for name, number in names.items():
                self.bytes[number] = len(name)
        special = [t["content"] for t in made["added_tokens"] or [] if t["content"]]
        self.special = re.compile("|".join(map(re.escape, special)) if special else "(?!)")
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.length, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _divided(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of the words of a text; a blank between two letters always begins a word, so a text can be cut there."""
        at, find = 0, self.words.findall
        while at < len(text):
            seam = _SEAM.search(text, at + SPAN) if len(text) - at > SPAN else None
            end = seam.start() if seam else len(text)
            yield np.fromiter(map(self.number.__getitem__, find(text, at, end)), np.int64)
            at = end

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > HELD_WORDS:
            self._clear()
        known = len(self.number)
        plain = [self.by_words and not _DOUBTFUL.search(t) and not self.special.search(t) for t in texts]
        divided = [list(self._divided(t)) if p else None for t, p in zip(texts, plain, strict=True)]
        rest = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        words = list(islice(self.number, known, None))
        if words:
            # a blank and letters stay words of their own when they follow each other
            simple = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool)
            lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            held, at = [self.flat], len(self.flat)
            for which, encode in ((np.flatnonzero(simple), self._joined), (np.flatnonzero(~simple), self._single)):
                lengths[which], flat = encode([words[i] for i in which.tolist()])
                ends = np.cumsum(lengths[which])
                starts[which] = at + ends - lengths[which]
                at += len(flat)
                held.append(flat)
            self.start, self.length = np.concatenate([self.start, starts]), np.concatenate([self.length, lengths])
            self.flat = np.concatenate(held)
        return [next(rest) if spans is None else self._looked_up(spans) for spans in divided]

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64), np.fromiter(chain.from_iterable(found), np.uint32)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that can be written one after the other; their bytes tell them apart again."""
        texts = ["".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        flat = self._single(texts)[1]
        sizes = map(len, words) if all(map(str.isascii, texts)) else (len(w.encode()) for w in words)
        ends = np.cumsum(np.fromiter(sizes, np.int64))
        last = np.searchsorted(np.cumsum(self.bytes[flat]), ends) + 1
        return np.diff(last, prepend=0), flat

    def _looked_up(self, spans: list[np.ndarray]) -> np.ndarray:
        words = np.concatenate([np.zeros(0, np.int64), *spans])
        lengths = self.length[words]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[words] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].astype("<u4")


def sequences(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    bundle: int = BUNDLE,
    with_ids: bool = True,
) -> DataFrame:
    """(sequence_id, ids, pieces) of all rows of ``df``, written.

    ``ids`` are the token ids of a sequence (null without ``with_ids``), and a
    piece is (id, start, length, ids_crc32, doc_tokens, offset): ``length`` ids
    of a document from its id ``start`` on, at ``offset`` in the sequence. Each
    sequence holds ``capacity`` ids or a power of two.

    A null, empty or blank text is packed like any other; null and empty ones
    are the end id alone. Repeated rows and ids are documents of their own, a
    null id stays null. An empty table gives an empty result. A long text is
    tokenised whole, in one task.
    """
    kind = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4")

    def rows_of(made: list[list[Piece]], first: int, id_type: pa.DataType) -> pa.RecordBatch:
        flat = [p for pieces in made for p in pieces]
        sizes = np.array([len(p.ids) for p in flat])
        bounds = np.concatenate([[0], np.cumsum([len(pieces) for pieces in made])])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
        columns = [
            pa.array([p.name for p in flat], id_type),
            pa.array([p.start for p in flat], pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array([zlib.crc32(p.ids.tobytes()) for p in flat], pa.int64()),
            pa.array([p.tokens for p in flat], pa.int64()),
            pa.array(offsets, pa.int64()),
        ]
        pieces = pa.StructArray.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "offset"])
        if with_ids:
            every = np.concatenate([p.ids for p in flat]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(every))
        else:
            ids = pa.nulls(len(made), pa.list_(pa.int32()))
        numbers = pa.array(range(first, first + len(made)), pa.int64())
        return pa.RecordBatch.from_arrays(
            [numbers, ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces)], ["sequence_id", "ids", "pieces"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, not the machine
        encoder = Encoder(tokenizer)
        packer, held = Packer(capacity), 0
        number = TaskContext.get().partitionId() << 40
        id_type = None
        for batch in batches:
            id_type, at = batch.column(0).type, 0
            while at < batch.num_rows:
                texts, size, made = [], 0, []
                while at + len(texts) < batch.num_rows and (not texts or size < GROUP):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                for row, found in enumerate(encoder.ids(texts), at):
                    n = len(found) + 1
                    document = Piece(batch.column(0)[row].as_py(), n, 0, np.concatenate([found, end]))
                    cut = n - n % capacity
                    made += [[document.part(k, k + capacity)] for k in range(0, cut, capacity)]
                    if cut < n:
                        packer.add(document.part(cut, n))
                        held += 1
                if held >= bundle:
                    made += packer.fill()
                    held = 0
                if made:
                    yield rows_of(made, number, id_type)
                    number += len(made)
                at += len(texts)
        made = [*packer.fill(), *packer.rest()]
        if made:
            yield rows_of(made, number, id_type)

    piece = f"struct<id:{kind},start:long,length:long,ids_crc32:long,doc_tokens:long,offset:long>"
    rows = narrow(df, id=id_col, text=text_col)
    return materialise(rows.mapInArrow(run, f"sequence_id long, ids array<int>, pieces array<{piece}>"), "sequences")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; see ``sequences``."""
    made = sequences(df, tokenizer, id_col, text_col, with_ids=False, **options)
    return made.select("sequence_id", F.explode("pieces").alias("p")).select(
        F.col("p.id").alias(id_col), "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset"
    )
