"""N-gram Jaccard join: T-occurrence search with heap-merged short and probed long lists.

Two texts link when their shingle sets have a Jaccard similarity of at least
4/5. The join is exact up to collisions of hashes of more than 40 bits:

1. Texts with equal sets are one class; a class is searched once.
2. Shingles are counted in buckets. Only shingles that two classes share can be
   in an intersection, and a class of which less than 4/5 is shared has no
   link; it leaves here. Tasks count what they hold before they send it on, so
   a shingle that very many texts share arrives once per task.
3. The rarest shared shingles of a class, one more than may differ, must meet
   each partner. Classes that share one of them, and whose sizes do not rule
   each other out, are in one block.
4. In a block, inverted lists are searched for the classes that occur often
   enough: the longest lists are left out of the heap merge and probed for
   what it finds (DivideSkip). A class that links directly to an earlier query
   needs no search of its own, see ``link``; so a block of copies costs one
   pass over its lists, not a look at each pair.
5. Blocks above a size are cut into parts. Each part is searched by itself,
   then a few classes of each of its components with those of the other parts.
   Then most of a large group of copies is one component, inside which nothing
   is left to find; only the classes outside of the block's largest component
   are searched in all parts, see ``_completed``.
6. Links become components.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import WORD, narrow
from .components import components

WORDS = 5
#: Shingles of a scan that are sent together, shingles counted together, and postings searched together.
BATCH, BUCKET, BLOCK = 4_000_000, 4_000_000, 1_000_000
#: A bucket is counted range by range of its keys, so that memory is a fraction of it.
RANGES = 4
#: Of each component of a part, the classes that are searched with other parts first.
HUBS = 8
#: Bytes hashed at once.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 40) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per blank-separated word: polynomials from running sums, all words at once."""
    if not data:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power = np.cumprod(np.full(len(raw), _BASE, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * power, dtype=np.uint64)])
    back = np.cumprod(np.full(len(raw), _INVERSE, dtype=np.uint64))
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles: ``WORDS`` lower-case words each, or all words if there are fewer."""
    data = (text or "").encode("utf-8", "replace").lower()
    parts, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        parts.append(_word_hashes(data[at:end]))
        at = end
    words = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        short = (words * _PLACE[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return _mixed(np.array([short], dtype=np.uint64)) if len(words) else words
    n = len(words) - WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        total += words[j : n + j] * _PLACE[j]
    return np.unique(_mixed(total))


def _class(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, n, cls) of every row, written: a hash of the text, size of its set, its class; an empty set has class null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = [], []
            for text in batch.column(2):  # one at a time, as only numbers of each are kept
                found = shingles(text.as_py())
                n.append(len(found))
                cls.append(_class(found) if len(found) else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "print", "n", "cls"])

    rows = narrow(df, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("print"), "text")
    return materialise(rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, print long, n long, cls long"), "sets")


#: A class and how many of the keys that follow are its own; a longer run is named again.
_NAMED = np.dtype([("cls", "<i8"), ("n", "<u2")])
_MOST = 65_535


def _named(cls: np.ndarray, n: np.ndarray) -> bytes:
    times = -(-n // _MOST)
    made = np.empty(int(times.sum()), dtype=_NAMED)
    made["cls"] = np.repeat(cls, times)
    before = np.arange(len(made)) - np.repeat(np.cumsum(times) - times, times)
    made["n"] = np.minimum(np.repeat(n, times) - before * _MOST, _MOST)
    return made.tobytes()


def _owners(named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct classes, and for each entry the number of its class."""
    cls, number = np.unique(named["cls"], return_inverse=True)
    return cls, number.astype(np.uint32)


def _packed(keys: np.ndarray) -> bytes:
    """40-bit keys as bytes: all low words, then all high bytes."""
    return (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (keys >> np.uint64(32)).astype("u1").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _batches(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[tuple]:
    """(name, classes, owner, hash) of up to about ``size`` postings, sorted by hash; each class once.

    The name is a digest of the classes, so a task that runs again gives the
    same names.
    """
    held: dict[int, np.ndarray] = {}
    total = 0

    def out() -> tuple:
        classes = np.array(list(held), dtype=np.int64)
        sizes = np.array([len(s) for s in held.values()], dtype=np.int64)
        hashes = np.concatenate(list(held.values()))
        held.clear()
        by = np.argsort(hashes, kind="stable").astype(np.uint32)
        return _class(classes), classes, np.repeat(np.arange(len(classes), dtype=np.uint32), sizes)[by], hashes[by]

    for batch in batches:
        for text in batch.column(0):
            found = shingles(text.as_py())
            cls = _class(found) if len(found) else None
            if cls is not None and cls not in held:
                held[cls] = found
                total += len(found)
                if total >= size:
                    total = 0
                    yield out()
    if held:
        yield out()


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(ordered)))


def _cuts(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, slice) of the runs of equal values of a sorted array."""
    starts, lengths = _runs(values)
    for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        yield int(values[at]), slice(at, at + n)


def _buckets(ordered: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted hashes; a bucket is a range of their first 24 bits."""
    at = 0
    while at < len(ordered):
        bucket = (int(ordered[at]) >> 40) * buckets >> 24
        end = -(-(bucket + 1 << 24) // buckets) << 40  # the first hash beyond it
        to = len(ordered) if end >> 64 else int(np.searchsorted(ordered, np.uint64(end)))
        yield bucket, slice(at, to)
        at = to


_SENT = pa.schema(
    [("bucket", pa.int64()), ("sender", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())]
)
#: ``part`` rows hold whole keys of the named classes; ``sender`` rows the low bits of one bucket.
_SHARED = pa.schema(
    [("sender", pa.int64()), ("part", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary()), ("classes", pa.binary())]
)


def _by_part(keys: np.ndarray, ranks: np.ndarray, owner: np.ndarray, cls: np.ndarray, parts: int) -> list[tuple]:
    """Rows of ``_SHARED``, one per part that has some of the classes; a class is in one part. ``owner`` numbers the classes."""
    part = cls.astype(np.uint64) % np.uint64(parts)
    order = np.lexsort((cls, part))  # of the classes, which are fewer than the keys
    place = np.empty(len(cls), dtype=np.uint32)
    place[order] = np.arange(len(cls), dtype=np.uint32)
    at = place[owner]
    by = np.argsort(at, kind="stable")
    at = at[by]
    rows = []
    for value, mine in _cuts(part[order][at]):
        first, n = _runs(at[mine])
        who = order[at[mine][first]]
        rows.append((None, value, None, keys[by[mine]].astype("<i8").tobytes(), ranks[by[mine]].tobytes(), _named(cls[who], n)))
    return rows


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _send(buckets: int):
    """Postings of a scan to their buckets.

    A shingle of one class of the batch goes with its class; one of several
    goes once, with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, classes, owner, hashes in _batches(batches):
            for bucket, at in _buckets(hashes, buckets):
                starts, lengths = _runs(hashes[at])
                who, once = owner[at][starts], hashes[at][starts] & _LOW
                # those of one class first, by class, so that a class is named once
                by = np.lexsort((who, lengths > 1))
                alone = int((lengths == 1).sum())
                first, n = _runs(who[by][:alone])
                named = _named(classes[who[by][first]], n)
                yield _table([(bucket, name, _packed(once[by]), lengths[by][alone:].astype("<u4").tobytes(), named)], _SENT)

    return run


def _rank(counts: np.ndarray) -> np.ndarray:
    """How many classes share a shingle, on a logarithmic scale of a byte."""
    return np.minimum(255, np.floor(8 * np.log2(counts))).astype("u1")


def _count(parts: int):
    """What is shared in a bucket: for the part of a class that was named, else for the sender; a class counts once.

    A key of 40 bits and the number of its class of 24 are one number, so a
    range of the bucket is one array that is sorted in place.
    """

    def one_range(rows: list[tuple], number: list[np.ndarray], at: int) -> tuple:
        """Shared keys of one class each with their owners and ranks, then for each sender's other keys in range their places and ranks."""
        found, owners, places, keys_of, weights = [], [], [], [], []
        for (_, data, counts, named), own in zip(rows, number, strict=True):
            keys, several = _unpacked(data), np.frombuffer(counts, "<u4")
            alone = len(keys) - len(several)
            mine = keys[:alone] >> np.uint64(38) == at
            found.append(keys[:alone][mine])
            owners.append(np.repeat(own, named["n"])[mine])
            place = np.flatnonzero(keys[alone:] >> np.uint64(38) == at)
            places.append(place)
            keys_of.append(keys[alone:][place])
            weights.append(several[place])
        pairs, owner = np.concatenate(found), np.concatenate(owners)
        if owner.max(initial=0) >> 24:  # more classes than a bucket is meant to have keys
            by = np.lexsort((owner, pairs))
            pairs, owner = pairs[by], owner[by]
            new = np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])])[: len(pairs)]
            pairs, owner = pairs[new], owner[new]
        else:
            pairs = pairs << np.uint64(24) | owner
            pairs.sort()
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
            owner = (pairs & np.uint64((1 << 24) - 1)).astype(np.uint32)
            pairs >>= np.uint64(24)
        starts, lengths = _runs(pairs)
        several, where = np.unique(np.concatenate(keys_of), return_inverse=True)
        weight = np.bincount(where, np.concatenate(weights), len(several)).astype(np.int64)
        _, alone, both = np.intersect1d(pairs[starts], several, assume_unique=True, return_indices=True)
        total, whole = lengths.copy(), weight.copy()
        total[alone] += weight[both]
        whole[both] += lengths[alone]
        shared = np.repeat(total > 1, lengths)
        return pairs[shared], owner[shared], _rank(np.repeat(total, lengths)[shared]), places, np.split(_rank(whole)[where], np.cumsum([len(p) for p in places])[:-1])

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = {}
        for at in range(table.num_rows):
            name, data, counts, named = (table.column(c)[at] for c in ("sender", "keys", "counts", "classes"))
            # two scans that held the same classes have one name; the bytes stay where they are
            rows[name.as_py()] = (name.as_py(), data.as_buffer(), counts.as_buffer(), np.frombuffer(named.as_buffer(), _NAMED))
        rows = list(rows.values())
        cls, number = _owners(np.concatenate([r[3] for r in rows]))
        numbers = np.split(number, np.cumsum([len(r[3]) for r in rows])[:-1])
        ranks = [np.zeros(len(r[2]) // 4, dtype="u1") for r in rows]
        made = []
        for at in range(RANGES):
            *alone, places, given = one_range(rows, numbers, at)
            made.append(alone)
            for rank, place, value in zip(ranks, places, given, strict=True):
                rank[place] = value
        keys, owner, rank = map(np.concatenate, zip(*made, strict=True))
        out = _by_part(keys | np.uint64(bucket) << np.uint64(40), rank, owner, cls, parts)
        for (name, data, _, _), rank in zip(rows, ranks, strict=True):
            if len(rank):
                keys = _unpacked(data)[-len(rank) :]
                by = np.argsort(keys)
                out.append((name, None, bucket, _packed(keys[by]), rank[by].tobytes(), b""))
        return pa.Table.from_batches([_table(out, _SHARED)] if out else [], schema=_SHARED)

    return run


_LOCAL = pa.schema([("sender", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("classes", pa.binary())])


def _keep(buckets: int):
    """The same scan again: the shingles that several classes of a batch share, by bucket, with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, classes, owner, hashes in _batches(batches):
            for bucket, at in _buckets(hashes, buckets):
                lengths = _runs(hashes[at])[1]
                several = np.repeat(lengths > 1, lengths)
                who, keys = owner[at][several], hashes[at][several]
                if len(keys):
                    by = np.lexsort((keys, who))
                    first, n = _runs(who[by])
                    yield _table([(name, bucket, _packed(keys[by] & _LOW), _named(classes[who[by][first]], n))], _LOCAL)

    return run


def _returned(parts: int):
    """The shared shingles of a sender's classes with the ranks that the buckets gave them, by part."""

    def run(local: pa.Table, counted: pa.Table) -> pa.Table:
        ranks = {
            b: (_unpacked(k), np.frombuffer(r, "u1"))
            for b, k, r in zip(*(counted.column(c).to_pylist() for c in ("bucket", "keys", "ranks")), strict=True)
        }
        keys, rank, names = [], [], []
        for bucket, data, named in zip(*(local.column(c).to_pylist() for c in ("bucket", "keys", "classes")), strict=True):
            known, value = ranks[bucket]
            low = _unpacked(data)
            keys.append(low | np.uint64(bucket) << np.uint64(40))
            rank.append(value[np.searchsorted(known, low)])
            names.append(np.frombuffer(named, _NAMED))
        if not keys:
            return _SHARED.empty_table()
        named = np.concatenate(names)
        cls, number = _owners(named)
        owner = np.repeat(number, named["n"])
        return pa.Table.from_batches([_table(_by_part(np.concatenate(keys), np.concatenate(rank), owner, cls, parts), _SHARED)])

    return run


_KEPT = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])


def _gather(table: pa.Table, sizes: pa.Table) -> pa.Table:
    """Of a part with the sizes of its classes, the classes of which at least 4/5 is shared: all shared shingles, and the rarest that must meet a partner.

    A class comes once from each bucket and once from each sender that held it.
    """
    if not table.num_rows:
        return _KEPT.empty_table()
    named = np.concatenate([np.frombuffer(x, _NAMED) for x in table.column("classes").to_pylist()])
    cls, number = _owners(named)
    owner = np.repeat(number, named["n"])
    known, size = sizes.column("cls").to_numpy(), sizes.column("n").to_numpy()
    by = np.argsort(known)
    size = size[by][np.searchsorted(known[by], cls)]
    keys = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("keys").to_pylist()])
    ranks = np.concatenate([np.frombuffer(x, "u1") for x in table.column("ranks").to_pylist()])
    by = np.argsort(owner, kind="stable")
    rows = []
    for number, at in _cuts(owner[by]):
        n = int(size[number])
        mine, first = np.unique(keys[by[at]], return_index=True)
        if 5 * len(mine) < 4 * n:
            continue
        differ = n - -(-4 * n // 5) - (n - len(mine))  # shared ones that a partner may lack
        rank = ranks[by[at]][first]
        rows.append((int(cls[number]), n, mine, mine[np.lexsort((mine, rank))[: differ + 1]]))
    return pa.Table.from_batches([_table(rows, _KEPT)] if rows else [], schema=_KEPT)


def occurrences(lists: list, least: int, wanted: np.ndarray | None = None) -> dict[int, int]:
    """Members of at least ``least`` of the sorted lists, with the number of lists: DivideSkip.

    The longest lists stay out of the merge. Who is in so many of the others
    that the long ones could complete the number is looked up there by binary
    search, and dropped as soon as it can't get there. ``wanted`` says which
    members matter. Lists are Python lists, merged by a heap and probed one by
    one, or arrays, whose runs a stable sort merges and which are probed for
    all candidates at once.
    """
    lists = sorted(lists, key=len)
    if len(lists) < least:
        return {}
    n_long = min(least - 1, int(least / (0.01 * np.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    if isinstance(lists[0], list):
        return _by_heap(short, long, least, wanted)
    member, n = np.unique(np.concatenate(short), return_counts=True)
    keep = n >= least - n_long if wanted is None else (n >= least - n_long) & wanted[member]
    member, n = member[keep], n[keep]
    for k, members in enumerate(long):
        at = np.minimum(np.searchsorted(members, member), len(members) - 1)
        n = n + (members[at] == member)
        keep = n + len(long) - k - 1 >= least
        member, n = member[keep], n[keep]
        if not len(member):
            break
    return dict(zip(member.tolist(), n.tolist(), strict=True))


def _by_heap(short: list[list[int]], long: list[list[int]], least: int, wanted: np.ndarray | None) -> dict[int, int]:
    at, found = [0] * len(long), {}
    for member, same in groupby(heapq.merge(*short)):
        n = sum(1 for _ in same)
        if n < least - len(long) or (wanted is not None and not wanted[member]):
            continue
        for k, members in enumerate(long):
            if n + len(long) - k < least:
                break
            at[k] = bisect_left(members, member, at[k])  # members come in order, so each search starts where the last ended
            n += at[k] < len(members) and members[at[k]] == member
        if n >= least:
            found[member] = n
    return found


#: Sets up to which lists are merged by a heap; queries without a find before the rest is taken by components.
SMALL, MISSES = 64, 8


def link(sizes: list[int], keys: list[np.ndarray]) -> list[int]:
    """For each set the smallest number of a set of its component.

    A query finds all links of a set, but for those inside its component, which
    change nothing. A pair is settled once one of both was a query, or both are
    in one component. So it ends when all sets that were no query are in one
    component: first the sets with the least of their own are queries, as they
    link to most; then those of the smaller components. A block of copies costs
    few queries, not one per set.
    """
    count = len(sizes)
    label = np.arange(count)
    members = {x: [x] for x in range(count)}
    open_in = dict.fromkeys(range(count), 1)  # sets per component that were no query yet
    lengths = np.array([len(k) for k in keys])
    owner = np.repeat(np.arange(count), lengths)
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    by = np.lexsort((owner, number))
    lists = np.split(owner[by], np.cumsum(np.bincount(number))[:-1])
    if count <= SMALL:
        lists = [x.tolist() for x in lists]
    numbers = np.split(number, np.cumsum(lengths)[:-1])
    n_open = count
    asked = np.zeros(count, dtype=bool)

    def query(q: int) -> bool:
        nonlocal n_open
        asked[q] = True
        open_in[label[q]] -= 1
        n_open -= open_in[label[q]] == 0
        mine = [lists[s] for s in numbers[q].tolist()]
        joined = False
        for x, n in occurrences(mine, -(-4 * sizes[q] // 5), label != label[q]).items():
            a, b = int(label[q]), int(label[x])
            if a != b and 9 * n >= 4 * (sizes[q] + sizes[x]):
                joined = True
                n_open -= bool(open_in[a]) and bool(open_in[b])
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                label[members[b]] = a
                members[a] += members.pop(b)
                open_in[a] += open_in.pop(b)
        return joined

    misses = 0
    for q in sorted(range(count), key=lambda x: (-lengths[x] / sizes[x], -sizes[x], x)):
        if n_open <= 1 or misses >= MISSES:
            break
        misses = 0 if query(q) else misses + 1
    for q in sorted(range(count), key=lambda x: (len(members[label[x]]), x)):
        if n_open <= 1:
            break
        if not asked[q]:
            query(q)
    least = {c: min(m) for c, m in members.items()}
    return [least[c] for c in label.tolist()]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(table: pa.Table) -> pa.Table:
    cls = table.column("cls").to_pylist()
    if len(cls) < 2:
        return _LINKS.empty_table()
    by = sorted(range(len(cls)), key=cls.__getitem__)  # the result does not depend on the order of arrival
    keys = table.column("keys").combine_chunks()
    roots = link([table.column("n")[i].as_py() for i in by], [keys[i].values.to_numpy() for i in by])
    pairs = [(cls[by[i]], cls[by[r]]) for i, r in enumerate(roots) if i != r]
    return pa.table({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, schema=_LINKS)


def _part(cls: str, parts: int):
    """The part of a class: its number without a sign, modulo ``parts``."""
    return F.expr(f"(shiftrightunsigned({cls}, 1) % {parts} * 2 + ({cls} & 1)) % {parts}").cast("long")


def _candidates(df: DataFrame, text_col: str, buckets: int, classes: DataFrame) -> DataFrame:
    """(cls, n, keys, prefix) of the classes that may have links, written; ``classes`` has their sizes (cls, n)."""
    texts = narrow(df, text=text_col)
    sent = texts.mapInArrow(_send(buckets), "bucket long, sender long, keys binary, counts binary, classes binary")
    shared = "sender long, part long, bucket long, keys binary, ranks binary, classes binary"
    counted = materialise(sent.groupBy("bucket").applyInArrow(_count(buckets), shared), "counted")
    local = texts.mapInArrow(_keep(buckets), "sender long, bucket long, keys binary, classes binary")
    returned = local.groupBy("sender").cogroup(counted.where("sender IS NOT NULL").groupBy("sender")).applyInArrow(_returned(buckets), shared)
    parts = counted.where("part IS NOT NULL").unionByName(returned).select("part", "keys", "ranks", "classes")
    sizes = classes.select("cls", "n", _part("cls", buckets).alias("part")).groupBy("part")
    gathered = parts.groupBy("part").cogroup(sizes).applyInArrow(_gather, "cls long, n long, keys array<long>, prefix array<long>")
    return materialise(gathered, "candidates")


def across(
    sets: tuple[list[int], list[np.ndarray], np.ndarray], queries: tuple[list[int], list[np.ndarray], np.ndarray]
) -> list[tuple[int, int]]:
    """(query, set) for a link of each query to each component but its own; both are sizes, keys, component numbers."""
    (sizes, keys, label), (asked_sizes, asked_keys, asked_label) = sets, queries
    owner = np.repeat(np.arange(len(sizes)), [len(k) for k in keys])
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    by = np.lexsort((owner, number))
    lists = np.split(owner[by], np.cumsum(np.bincount(number, minlength=len(distinct)))[:-1])
    found = []
    for q, (size, mine) in enumerate(zip(asked_sizes, asked_keys, strict=True)):
        at = np.minimum(np.searchsorted(distinct, mine), len(distinct) - 1)
        held = [lists[x] for x in at[distinct[at] == mine].tolist()]
        met = {}
        for x, n in occurrences(held, -(-4 * size // 5), label != asked_label[q]).items():
            if 9 * n >= 4 * (size + sizes[x]):
                met.setdefault(int(label[x]), x)
        found += [(q, x) for x in met.values()]
    return found


def _across(table: pa.Table, asked: pa.Table) -> pa.Table:
    if not table.num_rows or not asked.num_rows:
        return _LINKS.empty_table()

    def side(rows: pa.Table) -> tuple:
        keys = rows.column("keys").combine_chunks()
        return rows.column("n").to_pylist(), [keys[i].values.to_numpy() for i in range(rows.num_rows)], rows.column("root").to_numpy()

    found = across(side(table), side(asked))
    cls, own = table.column("cls").to_pylist(), asked.column("cls").to_pylist()
    return pa.table({"a": [own[q] for q, _ in found], "b": [cls[x] for _, x in found]}, schema=_LINKS)


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the root of their class by ``edges``."""
    found = materialise(components(edges), "roots")
    return rows.join(found, rows["cls"] == found["node"], "left").select(rows["*"], F.coalesce("root", "cls").alias("root"))


def _completed(large: DataFrame, first: DataFrame) -> DataFrame:
    """The links that ``first``, which holds those inside of parts, lacks between the parts of ``large`` blocks.

    A few classes of each component of several are searched without regard to
    parts. After that, what is in the block's largest component needs no search
    any more: two of its classes are linked already, and a link to any other
    class is found by that one's search, which goes through all parts.
    """
    hub = F.row_number().over(Window.partitionBy("block", "part", "root").orderBy("cls"))
    several = F.count("*").over(Window.partitionBy("block", "part", "root"))
    hubs = _rooted(large, first).withColumn("hub", hub).withColumn("several", several).where(F.col("hub") <= HUBS).where("several > 1")
    groups = hubs.groupBy("block").agg(F.sum(F.size("keys").cast("long")).alias("postings")).select(
        "block", F.ceil(F.col("postings") / BLOCK).cast("long").alias("groups")
    )
    dealt = hubs.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("cls"), F.col("groups")))
    second = dealt.select("block", "group", "cls", "n", "keys").groupBy("block", "group").applyInArrow(_search, "a long, b long")
    known = first.unionByName(materialise(second, "links"))

    rooted = materialise(_rooted(large, known), "rooted")
    sizes = rooted.groupBy("block", "root").agg(F.count("*").alias("classes"))
    largest = sizes.groupBy("block").agg(F.max(F.struct("classes", "root")).alias("of")).select("block", F.col("of.root").alias("largest"))
    asked = rooted.join(largest, "block").where("root <> largest")
    # columns of their own: Spark refuses a cogroup whose two sides have the columns of one table as ambiguous
    asked = asked.select(*[F.col(c).alias(c) for c in ("block", "parts", "cls", "n", "keys", "root")])
    shares = asked.groupBy("block").agg(F.sum(F.size("keys").cast("long")).alias("postings")).select(
        "block", F.ceil(F.col("postings") / BLOCK).cast("long").alias("shares")
    )
    share = F.pmod(F.xxhash64("cls"), F.col("shares"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = rooted.join(shares, "block").select("block", "part", every("shares").alias("share"), "cls", "n", "keys", "root")
    right = asked.join(shares, "block").select("block", share.alias("share"), every("parts").alias("part"), "cls", "n", "keys", "root")
    by = ["block", "part", "share"]
    third = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_across, "a long, b long")
    return known.unionByName(materialise(third, "links"))


def links(df: DataFrame, text_col: str, n_shingles: int, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that have a link; ``n_shingles`` sets how many buckets count, ``classes`` are all (cls, n)."""
    kept = _candidates(df, text_col, max(1, -(-n_shingles // BUCKET)), classes)
    # sizes of partners differ by a factor of 1.25 at most, so by one level, and are in one pair of levels of the two divisions
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(1.26)))
    pairs = F.explode(F.array(F.floor(level / 2) * 2, F.floor((level + 1) / 2) * 2 + 1))
    meets = kept.select("cls", pairs.alias("sizes"), "prefix").select(F.explode("prefix").alias("key"), "sizes", F.col("cls").alias("a"))
    first = meets.groupBy("key", "sizes").agg(F.min("a").alias("b"), F.count("*").alias("times")).where("times > 1").drop("times")
    blocks = components(meets.join(first, ["key", "sizes"]).where("a <> b").select("a", "b").distinct())
    sized = kept.join(blocks, kept["cls"] == blocks["node"]).select("cls", "n", "keys", F.col("root").alias("block"))
    parts = materialise(
        sized.groupBy("block").agg(F.sum(F.size("keys").cast("long")).alias("postings")).select(
            "block", F.ceil(F.col("postings") / BLOCK).cast("long").alias("parts")
        ),
        "blocks",
    )
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part")
    dealt = sized.join(parts, "block").select("block", "parts", part, "cls", "n", "keys")
    inside = dealt.select("block", "part", "cls", "n", "keys").groupBy("block", "part").applyInArrow(_search, "a long, b long")
    found = materialise(inside, "links")
    if not parts.where("parts > 1").isEmpty():
        found = _completed(materialise(dealt.where("parts > 1"), "large"), found)
    return components(found)


def _resolved(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, print, n, cls), and (cls, root, first) with the class's first row (no_id, id, print)."""
    rows = documents(df, id_col, text_col)
    total = rows.agg(F.sum("n").alias("n")).first().n or 0
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print")).alias("first")
    classes = materialise(rows.where("cls IS NOT NULL").groupBy("cls").agg(first, F.first("n").alias("n")), "firsts")
    linked = links(df, text_col, total, classes)
    grouped = classes.join(linked, classes["cls"] == linked["node"], "left")
    return rows, materialise(grouped.select("cls", F.coalesce("root", "cls").alias("root"), "first"), "classes")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component (smallest id reachable by links, its own included) of every row of ``df``.

    Null and wordless texts have the empty set and link with nothing. Rows
    with equal sets link, whatever their ids; null ids count as the largest.
    """
    rows, classes = _resolved(df, id_col, text_col)
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    component = classes.join(least, "root").select("cls", F.col("least.id").alias("component"))
    some = rows.where("cls IS NOT NULL").join(component, "cls").select("id", "n", "component")
    none = rows.where("cls IS NULL").select("id", "n", F.col("id").alias("component"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` per component, columns unchanged: the one with the smallest id; rows without a word all stay.

    Should several texts have that id, the one with the smallest hash stays,
    and of equal rows any one. Null ids come last.
    """
    _, classes = _resolved(df, id_col, text_col)
    kept = classes.groupBy("root").agg(F.min("first").alias("f")).select("f.id", "f.print").alias("kept")
    text = F.col(f"`{text_col}`")
    worded = F.coalesce(text.rlike(WORD), F.lit(False))
    rows = df.where(worded).select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("print"))
    met = rows.alias("rows").join(kept, F.col("rows.id").eqNullSafe(F.col("kept.id")) & (F.col("rows.print") == F.col("kept.print")), "left_semi")
    # tasks keep one of the rows that repeat before they send any
    once = met.groupBy("id", "print").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(df.where(~worded))
