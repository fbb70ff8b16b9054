"""Substring dedup by collinear chaining of shared k-mers of words: finds fuzzy passages that repeat across documents.

* Seeds are runs of K words, the least by hash of each NEAR neighbours, so an equal stretch of K + NEAR - 1 words has a common seed in
  both places, a shorter one of K words at least with even chances. A seed brings 4 bits of each of the SIDE words on either side of it,
  and two places are only linked if ALIKE of these words are equal; by chance one in 15 is. That keeps stock phrases apart.
* Places of a seed with equal words on their sides are a class. Its places in the text of least name, the leader, are linked to those of
  each other text, first to first and so on, which keeps periodic passages on one diagonal; a place is also linked to the one before in its
  own text (so a line repeated a thousand times is one passage). Texts of seeds that PAIRED texts have, or fewer, are all linked to each
  other, and those of other seeds to the text of least name. Then each class is linked to the most alike of those before it (of seeds with
  WIDE classes or more, to the most alike of some), and classes
  that are alike but not yet connected are linked: however many texts have a seed, places of it that any chain of alike ones connects
  are connected, and none that is like another is left alone. Each FAR-th seed or so is also linked to the least text in which it stands
  amid the same words: that with the same least hash of the seeds around it.
* Places are linked in each task first, and only the leaders of classes go on to the block of their seed.
* For each pair of documents, linked places are chained in order: a chain scores the words that its matches cover, less
  a cost for gaps, and the best predecessor comes from a tree over the other document's positions, which holds those within REACH.
* Chains are aligned: the words of both passages are joined, gaps between matches are aligned by edit distance and ends
  are extended while matches outweigh misses. Passages of LEAST words, and IDENTITY of them equal, count. Pieces of one
  passage that have different leaders are taken together.

Texts with the same words are handled once; their copies are reported against the smallest doc_id. Result: a row for
each repeated passage of a document: doc_id, source_id, start and end (words), source_start, source_end, n_equal.

Defined cases: null and empty texts have no passages; a passage repeated inside one document is reported with source_id = doc_id; rows
that repeat a doc_id are texts of their own if their words differ, and one if not; a null doc_id is reported as null, and counts as greater than
all others; of equal texts the smallest doc_id stands for all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, byte_column, mixed, partitions, release, remove, row_key, settled, table, word_hashes

K = 6
#: Neighbouring seeds of which the least stays; of which one is linked amid its words too; words on either side of a seed for that.
NEAR = 3
FAR = 24
AMID = 17
#: Words compared on either side of a seed, and how many must be equal.
SIDE = 8
ALIKE = 6
TOUCH = 18
#: Classes of a seed from which two words at a time say which of them are compared; pairs compared at once.
WIDE = 64
PAIRS = 500_000
#: Seeds that a task holds at once; seeds of a block, about.
CHUNK = 1_000_000
IN_BLOCK = 1_000_000
#: Texts of a seed of which all are linked to each other.
PAIRED = 8
LEAST = 40
IDENTITY = 0.75
GAP = 0.2
REACH = 60
MARGIN = 30
#: Words of passages are fetched in steps of so many.
STEP = 32

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
TEXT = pa.schema([("d", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64())])
PACKED = pa.schema([("block", pa.int32()), ("names", pa.binary()), ("of", pa.binary()), ("at", pa.binary()), ("seed", pa.binary()), ("sides", pa.binary()), ("links", pa.binary())])
PACKED_DDL = "block int, names binary, of binary, at binary, seed binary, sides binary, links binary"
LINK = pa.schema([("d", pa.int64()), ("x", pa.int64()), ("o", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])
LINK_DDL = "d long, x long, o long, y long, n long"
CHAIN_DDL = "d long, o long, x0 long, x1 long, y0 long, y1 long, sx binary, sy binary, sn binary"
CHAIN = pa.schema([("d", pa.int64()), ("o", pa.int64()), ("x0", pa.int64()), ("x1", pa.int64()), ("y0", pa.int64()), ("y1", pa.int64()), ("sx", pa.binary()), ("sy", pa.binary()), ("sn", pa.binary())])
FOUND = pa.schema([("d", pa.int64()), ("o", pa.int64()), ("x0", pa.int64()), ("x1", pa.int64()), ("y0", pa.int64()), ("y1", pa.int64()), ("equal", pa.int64())])


def _name(words: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).view(np.int64))


def _texts(it):
    memo = Hashes()
    for b in it:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            words = [word_hashes(text, memo) for text in byte_column(part, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([_name(w) for w in words], pa.int64()), pa.array([len(w) for w in words], pa.int64()), part.column("doc_id"), part.column("h")], schema=TEXT)
    release()


def least_of(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbours."""
    done = 1
    while done * 2 <= size:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (size - done)], h[size - done :]) if done < size else h


def _lows(h: np.ndarray, size: int) -> np.ndarray:
    """Which are the least of some size neighbours."""
    low = least_of(h, size)
    out = np.zeros(len(h), bool)
    for k in range(size):
        out[k : k + len(low)] |= h[k : k + len(low)] == low
    return out & (h != NONE)


def seeds(texts: list[np.ndarray]):
    """(text, place, seed, words on its sides, whether it is one of FAR, what it stands amid) of the seeds of texts, given as hashes of words."""
    pad = AMID + K
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = pad + np.cumsum(size + pad) - (size + pad)
    w = np.zeros(int(size.sum()) + pad * (len(texts) + 1), np.uint64)
    place = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    w[place] = np.concatenate(texts)
    h = w[: len(w) - K + 1].copy()
    for j in range(1, K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - K + 1 + j]
    h = np.minimum(mixed(h), NONE - np.uint64(1))
    inside = np.zeros(len(h), bool)
    n = size - K + 1
    inside[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)] = True
    h[~inside] = NONE
    # of the words around each seed those that count as few neighbours: texts are PAD words apart
    near, far = _lows(h, NEAR), _lows(h, FAR)
    other = np.where(inside, mixed(h ^ np.uint64(0x5851F42D4C957F2D)), NONE)
    amid = np.full(len(h), NONE)
    amid[AMID : len(h) - AMID] = least_of(other, 2 * AMID + 1)
    at = np.flatnonzero(near | far)
    bits = np.zeros(len(w), np.uint64)  # 0 is beyond the text
    bits[place] = (w[place] >> np.uint64(17)) % np.uint64(15) + np.uint64(1)
    sides = np.zeros(len(at), np.uint64)
    for k in (*range(-SIDE, 0), *range(K, K + SIDE)):
        sides = (sides << np.uint64(4)) | bits[at + k]
    of = np.searchsorted(start, at, side="right") - 1
    return of, at - start[of], h[at], sides, far[at], amid[at]


def _groups(key: np.ndarray, d: np.ndarray, at: np.ndarray):
    """Of rows in order of key, d and place: where each one's group begins, its text's number in the group and its own number in the text, and where the text begins."""
    i = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    doc = new.copy()
    doc[1:] |= d[1:] != d[:-1]
    group = np.maximum.accumulate(np.where(new, i, 0))
    text = np.maximum.accumulate(np.where(doc, i, 0))
    number = np.cumsum(doc) - 1
    return group, number - number[group], i - text, text, number, np.flatnonzero(doc)


def _classes(key: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of key and sides, the number of the class and where each class begins."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sides[1:] != sides[:-1])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def equal_sides(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of the words next to a seed are equal on the left without a break, on the right, and in all."""
    four, runs, total = np.uint64(0xF), [], np.zeros(len(a), np.int64)
    for shifts in (range(4 * SIDE, 8 * SIDE, 4), range(4 * SIDE - 4, -4, -4)):  # the nearest word first
        go, n = np.ones(len(a), bool), np.zeros(len(a), np.int64)
        for k in shifts:
            x = (a >> np.uint64(k)) & four
            same = (x == (b >> np.uint64(k)) & four) & (x > 0)
            go &= same
            n += go
            total += same
        runs.append(n)
    return *runs, total


def _joined(i: np.ndarray, j: np.ndarray, d, at, sides):
    """Links of places i to places j whose words on the sides are alike, grown by those that are equal without a break."""
    left, right, total = equal_sides(sides[i], sides[j])
    go = total >= ALIKE
    i, j, left, right = i[go], j[go], left[go], right[go]
    return d[i], at[i] - left, d[j], at[j] - left, K + left + right


def _other(i, to, count, r, sides) -> tuple[np.ndarray, np.ndarray]:
    """Places i, each the r-th of its text, and the places of the same number, or the last, in texts that begin at to and have count places."""
    go = (r[i] < count) | (sides[i] != sides[i - 1])
    return i[go], (to + np.minimum(r[i], count - 1))[go]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the words on the sides are equal, as equal_sides has it."""
    ones = np.uint64(0x1111111111111111)

    def some(x):
        x = x | (x >> np.uint64(1))
        return (x | (x >> np.uint64(2))) & ones

    return np.bitwise_count(some(a) & ~some(a ^ b))


def _joint(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the edges i-j, the first ones first, are a spanning forest of what root, each node's least, has not yet connected; root then has."""
    kept, at = [], np.arange(len(i))
    while True:
        at = at[root[i[at]] != root[j[at]]]
        if not len(at):
            return np.concatenate(kept) if kept else at
        x, y = root[i[at]], root[j[at]]
        hi, first = np.unique(np.maximum(x, y), return_index=True)
        kept.append(at[first])
        root[hi] = np.minimum(x, y)[first]
        while (root[root] != root).any():
            root[:] = root[root]


def bridges(group: np.ndarray, sides: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of alike rows of one group, given in order of it: of each row to the most alike one before it (from WIDE rows on, to one of these), and those that connect what chains of alike rows do; root is as for _joint.

    Rows of a group of WIDE or more are compared if two of their words are equal that are in one of ALIKE - 1 parts of the places, as
    of ALIKE equal words two must be.
    """
    found, whole = [(np.zeros(0, np.int64),) * 2], root.copy()
    most, to = np.full(len(root), ALIKE - 1), np.full(len(root), -1)

    def compare(rows, key, wide=False):
        """Pairs of rows of one key, given in order of it; if wide, no more of those that are connected."""
        if wide and len(key):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            open_ = np.repeat(np.minimum.reduceat(whole[rows], begin) != np.maximum.reduceat(whole[rows], begin), np.diff(np.concatenate([begin, [len(key)]])))
            rows, key = rows[open_], key[open_]
        end = np.searchsorted(key, key, side="right")
        count = end - np.arange(len(key)) - 1
        ends = np.cumsum(count)
        at = 0
        while at < len(key):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            # one row may have more partners than are compared at once
            for lo in range(0, max(1, int(ends[stop - 1] - done)), PAIRS):
                c = count[at:stop] if stop > at + 1 else np.minimum(count[at:stop] - lo, PAIRS)
                i = np.repeat(np.arange(at, stop), c)
                j = lo + i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                i, j = rows[i], rows[j]
                if wide:
                    open_ = (whole[i] != whole[j]) | (to[j] < 0)
                    i, j = i[open_], j[open_]
                equal = alike(sides[i], sides[j]).astype(np.int64)
                some = equal >= ALIKE
                i, j, equal = i[some], j[some], equal[some]
                best = np.lexsort((i, -equal, j))
                best = best[np.concatenate([[True], np.diff(j[best]) != 0])[: len(best)]]
                x, y, n = i[best], j[best], equal[best]
                better = (n > most[y]) | ((n == most[y]) & (x < to[y]))
                most[y[better]], to[y[better]] = n[better], x[better]
                for level in range(2 * SIDE, ALIKE - 1, -1):
                    some = np.flatnonzero(equal == level)
                    if len(some):
                        some = some[_joint(whole, i[some], j[some])]
                        found.append((i[some], j[some]))
            at = stop

    size = np.bincount(group)[group] if len(group) else group
    few, many = np.flatnonzero(size < WIDE), np.flatnonzero(size >= WIDE)
    compare(few, group[few])
    if len(many):
        four = np.uint64(0xF)
        for part in np.array_split(np.arange(2 * SIDE), ALIKE - 1):
            for m, k in enumerate(part.tolist()):
                for n in part[:m].tolist():
                    x, y = ((sides[many] >> np.uint64(4 * z)) & four for z in (k, n))
                    rows, key = many[(x > 0) & (y > 0)], (group[many] * 256 + (x * np.uint64(16) + y).astype(np.int64))[(x > 0) & (y > 0)]
                    order = np.argsort(key, kind="stable")
                    compare(rows[order], key[order], True)
    j = np.flatnonzero(to >= 0)
    _joint(root, to[j], j)
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    more = _joint(root, x, y)
    return np.concatenate([to[j], x[more]]), np.concatenate([j, y[more]])


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, as most of the high ones are zero."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _seeds(blocks: int):
    """Seeds by block, packed, of about CHUNK words: of each class of a seed the places of its leader, and those of the first PAIRED + 1 texts of the seed; the others are linked here.

    A key is a seed (low bit 0) or a seed with what it stands amid (1).
    """

    def send(texts, names):
        of, at, seed, sides, far, amid = seeds(texts)
        key = np.concatenate([seed & ~np.uint64(1), mixed(seed[far] ^ (amid[far] >> np.uint64(1))) | np.uint64(1)])
        of, at, sides = (np.concatenate([v, v[far]]) for v in (of, at, sides))
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        names = np.sort(names)
        of = rank[of]
        # most seeds stand in one place
        order = np.argsort(key)
        again = np.zeros(len(key), bool)
        again[1:] = key[order[1:]] == key[order[:-1]]
        again[:-1] |= again[1:]
        many = order[again]
        many = many[np.lexsort((at[many], of[many], key[many]))]
        _, nth, *_ = _groups(key[many], of[many], at[many])
        by = np.lexsort((at[many], of[many], sides[many], key[many]))
        many, nth = many[by], nth[by]
        class_, _ = _classes(key[many], sides[many])
        group, q, r, text, number, heads = _groups(class_, of[many], at[many])
        count = np.diff(np.concatenate([heads, [len(many)]]))
        held = np.flatnonzero((q > 0) & (nth > np.where(key[many] & np.uint64(1), 0, PAIRED)))
        same, to = held[r[held] > 0], held[r[held] < count[number[group[held]]]]
        pairs = (to, group[to] + r[to]), (same, same - 1)
        links = [np.concatenate(v) for v in zip(*(_joined(many[i], many[j], names[of], at, sides) for i, j in pairs), strict=True)]
        go = np.ones(len(key), bool)
        go[many[held]] = False
        key, of, at, sides = key[go], of[go], at[go], sides[go]
        at_block = ((key >> np.uint64(1)) % np.uint64(blocks)).astype(np.int32)
        short = ((((key >> np.uint64(1)) // np.uint64(blocks)) << np.uint64(1)) | (key & np.uint64(1))).astype(np.uint32)
        order = np.lexsort((at, of, at_block))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(at_block[order]) != 0, [True]]))
        rows = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            o = order[lo:hi]
            used, ref = np.unique(of[o], return_inverse=True)
            rows.append((int(at_block[o[0]]), names[used].tobytes(), _planes(ref), _planes(at[o]), short[o].tobytes(), sides[o].tobytes(), b""))
        if len(links[0]):
            rows.append((int(names[0] % blocks), b"", b"", b"", b"", b"", np.concatenate(links).astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)

    def run(it):
        memo, seen, texts, names, size = Hashes(), set(), [], [], 0
        for b in it:
            for i in range(0, b.num_rows, 500):
                for text in byte_column(b.slice(i, 500), "text"):
                    w = word_hashes(text, memo)
                    d = _name(w)
                    if len(w) < K or d in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(d)
                    texts.append(w)
                    names.append(d)
                    size += len(w)
                    if size >= CHUNK:
                        yield send(texts, np.array(names, np.int64))
                        texts, names, size = [], [], 0
        if names:
            yield send(texts, np.array(names, np.int64))
        release()

    return run


def _links(tab):
    """Links of a block's seeds: each text's places to those of its class's leader, and to its own place before; of few texts, all to each other; of classes, the bridges."""
    ready = [np.frombuffer(x, np.int64).reshape(5, -1) for x in tab.column("links").to_pylist() if x]
    rows = [i for i, x in enumerate(tab.column("seed").to_pylist()) if x]
    out = [np.concatenate(ready, axis=1)] if ready else []
    if rows:
        part = tab.take(pa.array(rows))
        names, of, at = (part.column(k).to_pylist() for k in ("names", "of", "at"))
        d = np.concatenate([np.frombuffer(n, np.int64)[_from_planes(o)] for n, o in zip(names, of, strict=True)])
        at = np.concatenate([_from_planes(x) for x in at]).astype(np.int64)
        key, sides = (np.concatenate([np.frombuffer(x, t) for x in part.column(k).to_pylist()]) for k, t in (("seed", np.uint32), ("sides", np.uint64)))
        order = np.lexsort((at, d, key))
        d, at, key, sides = (v[order] for v in (d, at, key, sides))
        # a text that two tasks read comes twice
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (at[1:] != at[:-1])
        d, at, key, sides = (v[once] for v in (d, at, key, sides))
        # most seeds stand in one place
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        d, at, key, sides = (v[again] for v in (d, at, key, sides))
        group, q, r, text, number, heads = _groups(key, d, at)
        count = np.diff(np.concatenate([heads, [len(key)]]))
        i = np.arange(len(key))
        texts = np.zeros(len(key), np.int64)
        np.maximum.at(texts, group, q + 1)
        later = i[q > 0]
        pairs = [(i[r > 0], i[r > 0] - 1), _other(later, group[later], count[number[group[later]]], r, sides)]
        few = i[(key % 2 == 0) & (texts[group] <= PAIRED)]
        for step in range(1, PAIRED - 1):
            some = few[q[few] > step]
            if not len(some):
                break
            to = number[some] - step
            pairs.append(_other(some, heads[to], count[to], r, sides))
        by = np.lexsort((at, d, sides, key))
        class_, first = _classes(key[by], sides[by])
        head, _, r, _, number, heads = _groups(class_, d[by], at[by])
        count = np.diff(np.concatenate([heads, [len(key)]]))
        to = np.flatnonzero((heads[number] > head) & (r < count[number[head]]))
        pairs += [(by[to], by[head[to] + r[to]]), (by[r > 0], by[np.flatnonzero(r > 0) - 1])]
        a, b = (np.concatenate(v) for v in zip(*pairs, strict=True))
        a, b = np.divmod(np.unique(np.maximum(a, b) * len(key) + np.minimum(a, b)), max(1, len(key)))
        ok = alike(sides[a], sides[b]) >= ALIKE
        a, b = a[ok], b[ok]
        # classes of seeds in order of their leaders
        first = np.sort(by[first])
        first = first[key[first] % 2 == 0]
        of = np.empty(len(key), np.int64)
        of[by] = by[head]
        seed = key[a] % 2 == 0
        root = np.arange(len(first))
        _joint(root, np.searchsorted(first, of[a[seed]]), np.searchsorted(first, of[b[seed]]))
        x, y = bridges(np.searchsorted(np.unique(group), group[first]), sides[first], root)
        x, y = first[x], first[y]
        a, b = np.divmod(np.unique(np.concatenate([a * len(key) + b, np.maximum(x, y) * len(key) + np.minimum(x, y)])), max(1, len(key)))
        out.append(np.stack(_joined(a, b, d, at, sides)))
    got = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    return pa.table(list(got), schema=LINK)


class Window:
    """Greatest (value, index) over a range of positions, of the entries that came since a time; times only rise."""

    def __init__(self, n: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.tree: list[tuple[float, int]] = [(-1e18, -1)] * (2 * self.size)
        self.held: list[deque] = [deque() for _ in range(n)]
        self.times: deque[tuple[int, int]] = deque()

    def _put(self, i: int) -> None:
        at = i + self.size
        self.tree[at] = self.held[i][0][1] if self.held[i] else (-1e18, -1)
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])

    def add(self, i: int, time: int, value: tuple[float, int]) -> None:
        # an entry that a later one outdoes is never the best again
        while self.held[i] and self.held[i][-1][1] <= value:
            self.held[i].pop()
        self.held[i].append((time, value))
        self.times.append((time, i))
        self._put(i)

    def expire(self, time: int) -> None:
        """Drops entries from before a time."""
        while self.times and self.times[0][0] < time:
            i = self.times.popleft()[1]
            if self.held[i] and self.held[i][0][0] < time:
                while self.held[i] and self.held[i][0][0] < time:
                    self.held[i].popleft()
                self._put(i)

    def best(self, lo: int, hi: int) -> tuple[float, int]:
        """Over positions from lo to below hi."""
        out, lo, hi = (-1e18, -1), lo + self.size, hi + self.size
        while lo < hi:
            if lo & 1:
                out = max(out, self.tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = max(out, self.tree[hi])
            lo, hi = lo // 2, hi // 2
        return out


def segments(x: np.ndarray, y: np.ndarray, n: np.ndarray | int) -> list[tuple[int, int, int]]:
    """(x, y, length) of matches of lengths n: those on one diagonal that are within TOUCH words are one."""
    n = np.broadcast_to(n, x.shape)
    order = np.lexsort((x, x - y))
    x, y, n = x[order], y[order], n[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(x) > TOUCH)
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(x + n, first)
    return sorted(zip(x[first].tolist(), y[first].tolist(), (end - x[first]).tolist(), strict=True))


def chains(parts: list[tuple[int, int, int]], gap: float = GAP, reach: int = REACH) -> list[list[tuple[int, int, int]]]:
    """Collinear chains, best first, no match in two: score is the words matched less gap for each word skipped on either side.

    A predecessor is the best of those that end at most reach words before on both sides.
    """
    if len(parts) == 1:
        return [parts]
    # a match may start once its predecessor has ended on both sides: ends are entered in order of x
    n = len(parts)
    rows = sorted({p[1] + p[2] for p in parts})
    at = {v: i for i, v in enumerate(rows)}
    tree, score, back = Window(len(rows)), [0.0] * n, [-1] * n
    ends = sorted(range(n), key=lambda i: parts[i][0] + parts[i][2])
    e = 0
    for i, (x, y, size) in enumerate(parts):
        while e < n and parts[ends[e]][0] + parts[ends[e]][2] <= x:
            j = ends[e]
            tree.add(at[parts[j][1] + parts[j][2]], parts[j][0] + parts[j][2], (score[j] + gap * (parts[j][0] + parts[j][1] + 2 * parts[j][2]), j))
            e += 1
        tree.expire(x - reach)
        value, j = tree.best(bisect_left(rows, y - reach), bisect_right(rows, y))
        gain = value - gap * (x + y)
        if j >= 0 and gain > 0:
            score[i], back[i] = size + gain, j
        else:
            score[i] = float(size)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(parts[j])
            j = back[j]
        if chain:
            out.append(chain[::-1])
    return out


def _chain(tab):
    d, o, x, y, n = (tab.column(k).to_numpy() for k in ("d", "o", "x", "y", "n"))
    order = np.lexsort((y, x, o, d))
    d, o, x, y, n = d[order], o[order], x[order], y[order], n[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1])
    cuts = np.concatenate([np.flatnonzero(new), [len(d)]])
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for c in chains(segments(x[a:b], y[a:b], n[a:b])):
            sx, sy, sn = (np.array([p[k] for p in c], np.int32).tobytes() for k in range(3))
            rows.append((int(d[a]), int(o[a]), c[0][0], c[-1][0] + c[-1][2], c[0][1], c[-1][1] + c[-1][2], sx, sy, sn))
    return pa.table([list(v) for v in zip(*rows, strict=True)] if rows else [[] for _ in CHAIN], schema=CHAIN)


def _slices(it):
    """Words of passages: rows come with a text, its name and its stretches (from, to)."""
    schema = pa.schema([("d", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary())])
    memo = Hashes()
    for b in it:
        for i in range(0, b.num_rows, 200):
            part = b.slice(i, 200)
            rows = []
            for text, d, asked in zip(byte_column(part, "text"), part.column("d").to_pylist(), part.column("asked").to_pylist(), strict=True):
                w = word_hashes(text, memo).astype(np.uint32)
                rows += [(d, q["lo"], q["hi"], w[q["lo"] : q["hi"]].tobytes()) for q in asked]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
    release()


def equal_in_gap(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in an alignment of least edit distance, counted as the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        take = np.where(b == x, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], take))
    return int(row[-1])


def extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, equal words) that matches outweigh misses for, word by word from the start."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    gain = np.cumsum(np.where(same, 1, -2))
    best = int(np.argmax(gain))
    return (best + 1, int(same[: best + 1].sum())) if gain[best] > 0 else (0, 0)


def _aligned(it):
    for b in it:
        for i in range(0, b.num_rows, 1000):
            yield from _align(pa.Table.from_batches([b.slice(i, 1000)])).to_batches()
    release()


def _align(tab):
    rows = []
    cols = {k: tab.column(k).to_pylist() for k in tab.column_names}
    for i in range(tab.num_rows):
        a, b = (np.frombuffer(cols[k][i], np.uint32) for k in ("wa", "wb"))
        fa, fb = cols["fa"][i], cols["fb"][i]
        xs, ys, ns = (np.frombuffer(cols[k][i], np.int32).tolist() for k in ("sx", "sy", "sn"))
        equal = sum(int((a[x - fa : x - fa + n] == b[y - fb : y - fb + n]).sum()) for x, y, n in zip(xs, ys, ns, strict=True))
        for j in range(1, len(xs)):
            equal += equal_in_gap(a[xs[j - 1] + ns[j - 1] - fa : xs[j] - fa], b[ys[j - 1] + ns[j - 1] - fb : ys[j] - fb])
        x0, x1, y0, y1 = (cols[k][i] for k in ("x0", "x1", "y0", "y1"))
        left, more = extension(a[: x0 - fa][::-1], b[: y0 - fb][::-1])
        right, yet = extension(a[x1 - fa :], b[y1 - fb :])
        if equal >= IDENTITY * max(x1 - x0, y1 - y0):
            rows.append((cols["d"][i], cols["o"][i], x0 - left, x1 + right, y0 - left, y1 + right, equal + more + yet))
    return pa.table([list(v) for v in zip(*rows, strict=True)] if rows else [[] for _ in FOUND], schema=FOUND)


def _passages(tab):
    """Of a document's passages those that, with others that they touch, have LEAST words."""
    x = {k: tab.column(k).to_numpy() for k in FOUND.names}
    order = np.lexsort((x["x1"], x["x0"], x["d"]))
    x = {k: v[order] for k, v in x.items()}
    new = np.ones(len(order), bool)
    width = int(x["x1"].max()) + 1
    doc = np.cumsum(np.concatenate([[True], x["d"][1:] != x["d"][:-1]])) - 1
    top = np.maximum.accumulate(doc * width + x["x1"]) - doc * width
    new[1:] = (doc[1:] != doc[:-1]) | (x["x0"][1:] > top[:-1] + MARGIN // 2)
    g = np.cumsum(new) - 1
    lo, hi = np.full(g[-1] + 1, width), np.zeros(g[-1] + 1, np.int64)
    np.minimum.at(lo, g, x["x0"])
    np.maximum.at(hi, g, x["x1"])
    keep = (hi - lo >= LEAST)[g]
    return pa.table([x[k][keep] for k in FOUND.names], schema=FOUND)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, source_id, start, end, source_start, source_end, n_equal of every repeated passage."""
    spark = docs.sparkSession
    i, h = row_key()
    docs = docs.select(i.alias("doc_id"), h, "text")
    first = settled(docs.mapInArrow(_texts, "d long, n long, doc_id long, h long"), "names")
    texts = settled(first.where("n > 0").groupBy("d").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("r"), F.max("n").alias("n"), F.count("*").alias("copies")).select("d", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_h"), "n", "copies"), "texts")
    total, words = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    packed = docs.select("text").mapInArrow(_seeds(partitions(spark, words, IN_BLOCK)), PACKED_DDL)
    links = packed.groupBy("block").applyInArrow(_links, LINK_DDL)
    blocks = partitions(spark, total, 4000)
    found = links.withColumn("block", F.pmod(F.xxhash64("d", "o"), F.lit(blocks))).groupBy("block").applyInArrow(_chain, CHAIN_DDL)
    edge = lambda k, up: (F.greatest(F.lit(0), F.floor((F.col(k) + (MARGIN + STEP - 1 if up else -MARGIN)) / STEP) * STEP)).cast("long")
    found = settled(found.withColumns({"fa": edge("x0", False), "ta": edge("x1", True), "fb": edge("y0", False), "tb": edge("y1", True)}), "chains")

    # a stretch is asked for once, however many chains lead to it, so a text's stretches are bounded by its length
    asked = found.select("d", F.col("fa").alias("lo"), F.col("ta").alias("hi")).union(found.select("o", "fb", "tb")).distinct()
    asked = settled(asked.groupBy("d").agg(F.collect_list(F.struct("lo", "hi")).alias("asked")).join(texts.select("d", "rep", "rep_h"), "d"), "asked")
    # ids may be null or repeated, so that a row is named by its text's hash too
    rows = docs.join(asked.hint("merge"), docs["doc_id"].eqNullSafe(asked["rep"]) & (docs["h"] == asked["rep_h"])).select("d", "text", "asked").mapInArrow(_slices, "d long, lo long, hi long, words binary")
    slices = settled(rows.dropDuplicates(["d", "lo", "hi"]), "slices")
    side = lambda d, lo, hi, w: slices.select(F.col("d").alias(d), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("words").alias(w))
    both = found.join(side("d", "fa", "ta", "wa"), ["d", "fa", "ta"]).join(side("o", "fb", "tb", "wb"), ["o", "fb", "tb"])
    aligned = both.mapInArrow(_aligned, "d long, o long, x0 long, x1 long, y0 long, y1 long, equal long")
    kept = aligned.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(blocks))).groupBy("block").applyInArrow(_passages, "d long, o long, x0 long, x1 long, y0 long, y1 long, equal long")
    name = lambda k, v: texts.select(F.col("d").alias(k), F.col("rep").alias(v))
    near = kept.join(name("d", "doc_id"), "d").join(name("o", "source_id"), "o").select("doc_id", "source_id", F.col("x0").alias("start"), F.col("x1").alias("end"), F.col("y0").alias("source_start"), F.col("y1").alias("source_end"), F.col("equal").alias("n_equal"))
    near = settled(near, "passages")
    remove(found, asked, slices)
    copies = first.select("d", "doc_id").distinct().join(texts.where(f"copies > 1 and n >= {LEAST}"), "d").where("not (doc_id <=> rep)")
    zero = F.lit(0).cast("long")
    return near.union(copies.select("doc_id", F.col("rep").alias("source_id"), zero, "n", zero, "n", "n"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
