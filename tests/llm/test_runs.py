import random

import numpy as np
from llm_rows import rows

from lectern.llm import runs
from lectern.llm.catalog import _stretched


def brute(words):
    """Each period in turn: maximal stretches of words that equal the one a period on."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        unit = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 32, 40, 70]))]
        if rng.random() < 0.5:
            unit = unit[: rng.randint(1, 3)] * rng.randint(1, 12) + unit
        words += [unit[i % len(unit)] for i in range(rng.choice([10, 24, 25, 48, 100, 300]))]
    return words


def test_all_runs_against_brute_force(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(runs, "TOGETHER", 900)
    texts = [made(rng) for _ in range(400)]
    for words, found in zip(texts, runs.of_texts(texts), strict=True):
        assert [tuple(r) for r in found.tolist()] == brute(words)


def test_long_repetitions():
    """Many levels: one word, Fibonacci words, and a long unit with a short one inside."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 4000:
        a, b = b, b + a
    unit = [b"x"] * 700 + [b"y%d" % i for i in range(300)]
    texts = [[b"w"] * 30_000, b, unit * 4 + [b"x"] * 700]
    found = runs.of_texts(texts)
    assert found[0].tolist() == [[0, 30_000, 1]]
    assert [tuple(r) for r in found[1].tolist()] == brute(b)
    assert [tuple(r) for r in found[2].tolist()] == [(0, 700, 1), (0, 4700, 1000), (1000, 700, 1), (2000, 700, 1), (3000, 700, 1), (4000, 700, 1)]


def test_successor():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 300):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        low, least = rng.integers(0, n, 500), rng.integers(0, 2 * n + 2, 500)
        high = np.minimum(n, low + rng.integers(0, n + 1, 500))
        want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least, strict=True)]
        assert tree.successor(low, high, least).tolist() == want


def test_collapse_and_strongest():
    words = b"p q r".split() + [b"x", b"y"] * 12 + b"s".split()
    (found,) = runs.of_texts([words])
    assert found.tolist() == [[3, 24, 2]]
    assert runs.collapsed(words, found) == b"p q r x y s"
    assert runs.strongest(np.array([[9, 30, 3], [5, 20, 2], [5, 30, 3]])) == (5, 20, 2)
    assert runs.strongest(found[:0]) is None


def test_rows_of_any_kind(odd, empty, n_odd, frame):
    found = runs.scan(odd).collect()
    assert len(found) == n_odd and all(r.collapsed is not None for r in found)
    assert runs.scan(empty).count() == 0
    one = runs.scan(frame(rows("A b " * 20 + "c\n"))).first()
    assert (one.n_runs, tuple(one.best), one.collapsed) == (1, (0, 40, 2), "A b c")


def test_stretched():
    words = [b"%d" % i for i in range(100)]
    kept = [k for k in range(200) if _stretched(k, words) == words]
    assert 150 < len(kept) < 200 and _stretched(None, words) == words
    assert all(len(_stretched(k, words)) == 100 for k in range(200))
