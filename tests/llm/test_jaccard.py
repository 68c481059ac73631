"""The join against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import jaccard
from llm_rows import rows


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("small, misses", [(64, 8), (0, 1), (64, 0)])
def test_link_is_all_pairs(monkeypatch, small, misses):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "MISSES", misses)
    rng = random.Random(3)
    for _ in range(150):
        bases = [set(rng.sample(range(60), rng.randint(1, 40))) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 30)):
            made = set(rng.choice(bases))
            for _ in range(rng.randint(0, 8)):
                made ^= {rng.randrange(60)}
            sets.append(made or {1})
        assert jaccard.link([len(s) for s in sets], [np.array(sorted(s)) for s in sets]) == components(sets)


def test_occurrences_is_counting():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(80), rng.randint(0, 60))) for _ in range(rng.randint(1, 25))]
        least = rng.randint(1, len(lists))
        counts = {x: sum(x in members for members in lists) for x in range(80)}
        want = {x: n for x, n in counts.items() if n >= least}
        assert jaccard.occurrences(lists, least) == want
        filled = [np.array(x) for x in lists if x]
        if len(filled) >= least:
            assert jaccard.occurrences(filled, least) == want
        odd = np.arange(80) % 2 == 1
        assert jaccard.occurrences(lists, least, odd) == {x: n for x, n in want.items() if x % 2}


def words(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def texts():
    """Near copies of a few bases, a hot group, and a passage that unrelated texts share."""
    rng = random.Random(11)
    vocabulary = ["w%03d" % i for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    made = []
    for base in range(12):
        first = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(60 if base == 0 else rng.randint(1, 6)):
            copy = list(first)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += rng.choices(vocabulary, k=rng.randint(0, 4))
            if rng.random() < 0.2:
                copy += passage
            made.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    made += [" ".join(passage + rng.choices(vocabulary, k=80)) for _ in range(40)]
    made += [made[0]] * 20 + ["one two", "ONE two", "one two three"]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("bucket, block", [(4_000_000, 4_000_000), (2_000, 1_500)])
def test_join_is_all_pairs(frame, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard._batches, "__defaults__", (bucket,))
    monkeypatch.setattr(jaccard, "HUBS", 2)
    monkeypatch.setattr(jaccard, "_MOST", 3 if bucket < 4_000_000 else 65_535)
    made = texts()
    sets = [words(t) for t in made]
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.join(frame(rows(*made))).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


@pytest.fixture
def parted(monkeypatch):
    """Blocks so small that many have several parts; how often these were completed."""
    monkeypatch.setattr(jaccard, "BLOCK", 150)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    calls, completed = [], jaccard._completed
    monkeypatch.setattr(jaccard, "_completed", lambda *a: calls.append(a) or completed(*a))
    return calls


def test_stage_with_blocks_in_parts_is_all_pairs(frame, spark, parted):
    made = texts()
    want = components([words(t) for t in made])
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    assert sorted(r.doc_id for r in stage(spark, frame(rows(*made)), "").collect()) == sorted(set(want)) and parted


def test_join_with_blocks_in_parts_is_all_pairs(frame, parted):
    made = texts()
    sets = [words(t) for t in made]
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.join(frame(rows(*made))).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)} and parted


def test_across_is_all_pairs():
    """A query links to each component that has a set similar to it, but for its own."""
    rng = random.Random(6)
    for _ in range(100):
        base = [set(rng.sample(range(50), rng.randint(1, 30))) for _ in range(3)]

        def some(n):
            made = []
            for _ in range(n):
                x = set(rng.choice(base))
                for _ in range(rng.randint(0, 4)):
                    x ^= {rng.randrange(50)}
                made.append(x or {1})
            return made, np.array([rng.randrange(4) for _ in range(n)])

        (sets, label), (asked, own) = some(rng.randint(1, 20)), some(rng.randint(1, 6))
        want = {
            (q, int(label[x])) for q, a in enumerate(asked) for x, b in enumerate(sets)
            if own[q] != label[x] and 100 * len(a & b) >= 80 * len(a | b)
        }
        got = jaccard.across(*[([len(s) for s in of], [np.array(sorted(s)) for s in of], k) for of, k in ((sets, label), (asked, own))])
        assert {(q, int(label[x])) for q, x in got} == want and len(got) == len(want)


def test_words_are_cut_at_ascii_blanks_only():
    assert list(jaccard.shingles("a b c d e f")) == list(jaccard.shingles("A B\tc\n\x0bd  e f"))
    assert len(jaccard.shingles("a b c d e f")) == 1


def test_pieces_do_not_matter(monkeypatch):
    text = " ".join(map(str, range(3000)))
    whole = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "PIECE", 100)
    assert list(jaccard.shingles(text)) == list(whole) and len(whole) == 2996
