"""The trie against prediction by partial matching done symbol by symbol."""

import math
import random
from collections import Counter, defaultdict

import pytest

from lectern.llm import ppm
from llm_rows import rows

ORDER = ppm.ORDER


class ByHand:
    def __init__(self, training, share_bits):
        self.seen = [defaultdict(Counter) for _ in range(ORDER + 1)]
        total = 0
        for text in training:
            data = bytes([ppm.PAD]) * ORDER + ppm.lowered(text) + bytes([ppm.END])
            for i in range(ORDER, len(data)):
                total += 1
                for k in range(ORDER + 1):
                    self.seen[k][data[i - k : i]][data[i]] += 1
        self.least = total / 2**share_bits

    def probability(self, context, symbol):
        excluded, p = set(), 1.0
        for k in range(ORDER, -1, -1):
            follows = self.seen[k].get(context[ORDER - k :], {})
            kept = {s: n for s, n in follows.items() if n >= self.least}
            if not kept:
                continue
            free = {s: n for s, n in kept.items() if s not in excluded}
            whole = sum(follows.values())
            room = whole - sum(n for s, n in kept.items() if s in excluded) + len(free)
            if room and symbol in free:
                return p * free[symbol] / room
            if room:
                p *= (len(free) + whole - sum(kept.values())) / room
            excluded |= set(kept)
        return p / (256 - len(excluded))

    def score(self, text):
        data = bytes([ppm.PAD]) * ORDER + ppm.lowered(text) + bytes([ppm.END])
        return sum(math.log10(self.probability(data[i - ORDER : i], data[i])) for i in range(ORDER, len(data)))


@pytest.mark.parametrize("share_bits", [20, 7])
def test_scores(frame, share_bits, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE", 64)
    rng = random.Random(2)
    made = ["".join(rng.choices("abcdeÄ \nB", k=rng.randint(0, 70))) for _ in range(40)] + ["", "zzz", None]
    training = made[:25]
    by_hand = ByHand(training, share_bits)
    assert sum(by_hand.probability(b"ab cd", s) for s in range(256)) == pytest.approx(1)
    docs = frame(rows(*made))
    got = {r.doc_id: r for r in ppm.score(docs, docs.where("doc_id < 25"), share_bits=share_bits).collect()}
    counts = Counter(t for text in training for t in [*ppm.lowered(text).split(), b""])
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(made):
        tokens = [*ppm.lowered(text).split(), b""]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
        assert got[i].base_score == pytest.approx(base)
        assert got[i].score == pytest.approx(by_hand.score(text), rel=1e-9)


def test_rare_words_are_joined(frame, monkeypatch):
    """With a tiny head all words go through the join, with the same sums; repeated rows repeat."""
    docs = frame(rows("a b b c", "c c d é", "c c d é", "x") + rows("a b b c"))
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in ppm.score(docs, docs.where("doc_id < 3")).collect())
    got = sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in ppm.score(docs, docs.where("doc_id < 3"), share_bits=0).collect())
    assert got == want and len(got) == 5


@pytest.mark.parametrize("head_bits, group", [(22, 1 << 21), (7, 40), (0, 1 << 21), (0, 40)])
def test_every_gram_counts(frame, head_bits, group, monkeypatch):
    """However small a gram's share, its count is in the score: values at hand or joined give the scores of the whole trie."""
    monkeypatch.setattr(ppm, "PIECE", 64)
    monkeypatch.setattr(ppm, "GROUP", group)
    monkeypatch.setattr(ppm, "SLICE", 150)
    rng = random.Random(3)
    made = ["".join(rng.choices("abcdeÄ \nB", k=rng.randint(0, 70))) for _ in range(40)] + ["", "zzz", None]
    by_hand = ByHand(made[:25], 60)
    docs = frame(rows(*made) + rows(*made[:3]))
    got = ppm.score(docs, frame(rows(*made[:25])), head_bits=head_bits).collect()
    assert len(got) == len(made) + 3
    for r in got:
        assert r.score == pytest.approx(by_hand.score(made[r.doc_id]), rel=1e-9)


def test_a_small_share_is_not_dropped(frame):
    """One rare text beside 2^24 bytes of others: each of its grams has less than one byte in 2^20."""
    docs = frame(rows("qxzvjw kyqzx", "ab" * (1 << 23)))
    rare = docs.where("doc_id = 0")
    assert ppm.score(rare, docs).first().score > -6
    assert ppm.score(rare, docs, share_bits=20).first().score < -25  # what a bounded trie gives


def test_a_task_looks_at_a_megabyte_of_texts_at_a_time():
    """Four megabytes, and the counts of four million grams, took more than an executor has."""
    assert ppm.SLICE <= 1 << 20 and ppm.GROUP <= 1 << 19 and ppm.HELD_GRAMS <= 1_000_000
