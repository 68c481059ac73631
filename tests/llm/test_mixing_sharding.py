"""Mixing and sharding against plain loops."""

import math
import random
from collections import defaultdict

from llm_rows import rows

from lectern.llm import mixing, sharding


def shares(sizes):
    """Targets by sharing again and again, as the task states it."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    left, target, active = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while active:
        level = left / sum(weight[i] for i in active)
        over = {i for i in active if level * weight[i] > 2 * sizes[i]}
        for i in over or active:
            target[i] = 2.0 * sizes[i] if over else level * weight[i]
            left -= target[i]
        active -= over or active
    return target


def corpus(rng):
    made, names = [], ["b", "a", None, "ä", "Z", "hot", "tiny"]
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(names[:6])
        made += rows(" ".join(["w"] * rng.choice([0, 1, 3, 40, 300, 2500])), source=source, first=i)
    return made + rows("one two", source="tiny", first=400)


def test_targets_and_takes(frame, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    made = corpus(random.Random(1))
    mixed = mixing.mix(frame(made))
    got = mixing.taken(mixed).collect()
    assert sorted(r.id for r in got) == list(range(401))
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.source_size == sum(len(m[1].split()) for m in made if m[3] == r.source)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    for name, want in zip(order, shares([total[s] for s in order]), strict=True):
        assert abs(target[name] - want) < 1e-4
        assert taken[name] == math.floor(target[name])
    spans = mixed.spans.collect()
    by_slot = defaultdict(int)
    for s in spans:
        by_slot[s.slot] += s.to_word - s.from_word
    assert max(by_slot.values()) <= 2 * 64
    again = {(r.id, r.taken) for r in mixing.taken(mixing.mix(frame(made[::-1]))).collect()}
    assert again == {(r.id, r.taken) for r in got}


def test_slots_interleave(frame, monkeypatch):
    """In any stretch of slots a source has its share, give or take a few."""
    monkeypatch.setattr(mixing, "BLOCK", 8)
    made = corpus(random.Random(2))
    mixed = mixing.mix(frame(made))
    owner = {s.slot: s.src for s in mixed.spans.select("slot", "src").distinct().collect()}
    n = max(owner) + 1
    whole = defaultdict(int)
    for src in owner.values():
        whole[src] += 1
    seen = defaultdict(int)
    for slot in range(n):
        seen[owner.get(slot)] += 1
        for src in whole:
            assert abs(seen[src] - whole[src] * (slot + 1) / n) < 10


def test_every_slot_is_filled_evenly(frame, monkeypatch):
    """Blocks of a source differ by one word at most, so none of its slots stays empty."""
    monkeypatch.setattr(mixing, "BLOCK", 8)
    mixed = mixing.mix(frame(corpus(random.Random(2))))
    filled = defaultdict(int)
    for s in mixed.spans.collect():
        filled[s.src, s.slot] += s.to_word - s.from_word
    for src in {src for src, _ in filled}:
        held = [n for (own, _), n in filled.items() if own == src]
        assert max(held) - min(held) <= 1
    slots = {slot for _, slot in filled}
    assert slots == set(range(len(slots)))


def test_copies_come_in_slot_order(frame, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = frame(corpus(random.Random(3)))
    mixed = mixing.mix(docs, identity=mixing.F.xxhash64(mixing.F.struct("*")))
    first = mixed.spans.where("from_word = 0").join(mixed.documents.where("size > 0"), ["src", "start"])
    want = [r.id for r in sorted(first.collect(), key=lambda r: (r.slot, r.cycle, r.start))]
    assert [r.doc_id for r in mixing.apply(docs).collect()] == want


def test_rows_that_repeat(frame):
    """Equal rows share their takes; rows of one id and text that differ elsewhere stay apart."""
    docs = frame(rows("a b c d") * 3 + rows("a b c d", lang="de") + rows("e f", first=1))
    got = [(r.doc_id, r.lang) for r in mixing.apply(docs).collect()]
    want = mixing.taken(mixing.mix(docs)).agg({"copies": "sum"}).first()[0]
    assert len(got) == want and {(0, "en"), (0, "de"), (1, "en")} <= set(got)


def test_copies_follow_the_mix(frame):
    docs = frame(corpus(random.Random(3)))
    want = {r.id: r.copies for r in mixing.taken(mixing.mix(docs)).collect() if r.copies}
    got = defaultdict(int)
    for r in mixing.apply(docs).collect():
        got[r.doc_id] += 1
    assert got == want


def test_heap_is_least_load_by_hand():
    rng = random.Random(4)
    items = [(k, rng.randint(1, 50)) for k in range(200)]
    loads, placed = [0] * 7, {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        shard = min(range(7), key=lambda s: (loads[s], s))
        loads[shard] += size
        placed[key] = shard
    assert sharding.schedule(items, 7) == placed
    assert max(loads) - min(loads) <= min(size for _, size in items) + 2


def test_shards(frame, monkeypatch, tmp_path):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 400) + str(i % 150) for i in range(300)] + ["same text"] * 200 + [None, ""]
    docs = frame(rows(*texts))
    for fineness in (1024, 20):  # all groups on their own; most of them in bundles
        monkeypatch.setattr(sharding, "FINENESS", fineness)
        got = sharding.shard(docs, 6).collect()
        loads, slots, place = defaultdict(int), defaultdict(list), {}
        for r in got:
            text = texts[r.doc_id] or ""
            assert r.size == len(text.encode()) + 8
            assert place.setdefault(text, r.shard) == r.shard
            loads[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(loads.values()) - min(loads.values()) < (0.02 if fineness > 100 else 0.2) * max(loads.values())
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 6)
    assert docs.sparkSession.read.parquet(path).count() == len(texts)
