import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import rows
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.packing import Packer, Piece, reach

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


WHOLE = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def check(made, texts, capacity=1024):
    """Each id in one piece, digests right, sequences gapless, full or of a power of two; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in made:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return len(by_sequence)


def test_reach_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(300):
        lengths = rng.sample(range(1, 30), rng.randint(1, 6))
        counts = [rng.randint(0, 4) for _ in lengths]
        target = rng.randint(0, 60)
        sums = {0}
        for length, count in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(count + 1)}
        taken = reach(zip(lengths, counts, strict=True), target)
        assert all(n <= dict(zip(lengths, counts, strict=True))[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize("sizes", [[7] * 100, [900] * 30, list(range(1, 200)), [1], [1023, 1], [1000, 1000]])
def test_no_padding(sizes):
    packer = Packer()
    for k, n in enumerate(sizes):
        packer.add(Piece(k, n, 0, np.arange(n, dtype="<u4")))
    full, rest = list(packer.fill()), list(packer.rest())
    assert len(full) == sum(sizes) // 1024
    assert all(sum(len(p.ids) for p in made) == 1024 for made in full)
    assert sorted(sum(len(p.ids) for p in made) for made in rest) == [1 << b for b in range(10) if sum(sizes) % 1024 >> b & 1]


def test_most_remainders_stay_whole():
    rng = random.Random(1)
    packer = Packer()
    for k in range(5000):
        n = rng.randint(1, 1023)
        packer.add(Piece(k, n, 0, np.zeros(n, dtype="<u4")))
    made = [*packer.fill(), *packer.rest()]
    assert sum(len(s) for s in made) < 5000 + 600


def test_pieces_of_odd_rows(frame, odd, n_odd):
    made = packing.pack(odd, TOKENIZER).collect()
    assert sum(p.start + p.length == p.doc_tokens for p in made) == n_odd
    texts = {k: t for k, t in enumerate([None, "", " \n\t", "word", "of the two <|endoftext|>", "a b " * 3000, "çé 日本 " * 50])}
    assert check(packing.pack(frame(rows(*texts.values())).repartition(3), TOKENIZER).collect(), texts) > 3


def test_small_bundles_and_real_sequences(frame):
    rng = random.Random(2)
    texts = {k: " ".join(rng.choices(["over", "the", "lazy", "dog", "quick"], k=rng.randint(0, 90))) for k in range(300)}
    documents = frame(rows(*texts.values())).coalesce(1)
    check(packing.pack(documents, TOKENIZER, capacity=64, bundle=7).collect(), texts, 64)
    for s in packing.sequences(documents, TOKENIZER, capacity=64, bundle=50).collect():
        for p in s.pieces:
            ids = np.array(s.ids[p.offset : p.offset + p.length], dtype="<u4")
            assert (ids == ids_of(texts[p.id])[p.start : p.start + p.length]).all()


def test_classes_of_characters_agree():
    """All that is not doubtful is a letter, a number or blank to both."""
    import re

    import regex

    for one, two in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        a, b = re.compile(one), regex.compile(two)
        for c in map(chr, range(0x110000)):
            if not packing._DOUBTFUL.match(c) and not "\ud800" <= c <= "\udfff":
                assert bool(a.match(c)) == bool(b.match(c)), hex(ord(c))


def test_words_give_the_ids_of_whole_texts(monkeypatch, folder):
    """Also with special tokens, doubtful characters, long texts cut at seams, and a small memory of words."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(packing, "SPAN", 500)
    monkeypatch.setattr(packing, "HELD_WORDS", 3000)
    rng = random.Random(9)
    signs = "ab Z09 '\n\t  .,<|>_-éß\xa0\x85\u0416\u05d0\x1c\u3000\u65e5\U0001f600's'll don't“ab”—…あア一字한²"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 200))) for _ in range(2000)]
    texts += ["", " ", "a<|endoftext|>b", "x" * 3000, "word " * 2000, " lead", "trail  "]
    texts += [t or "" for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()]
    encoder = packing.Encoder(TOKENIZER)
    assert encoder.by_words and not packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).by_words
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, one, two in zip(some, encoder.ids(some), encoder.whole(some), strict=True):
            assert one.tolist() == two.tolist(), text


def test_empty(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0
