"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when den * |A & B| >= num * |A | B| for their sets of word shingles. Equal sets
are one class, so copies are not expanded. The columns (n-grams, by hash) are cut into blocks:

* Candidates: sizes bound how many n-grams a linked pair may not share, D = na + nb - 2 * least overlap. With more than
  D column blocks in which a row has n-grams, a linked pair agrees wholly in one of them. So each row gets a name for each of its
  blocks, and only rows with a name in common are multiplied. How many blocks there are follows from the sum of
  both sizes alone (a scheme; each row is in the one to three that its partners' sizes allow). A row whose n-grams happen
  to lie in too few blocks also gets the names of a finer cut, of LEVELS at most, the last of which parts all its n-grams.
* First product, sparse: of the rows with a name in common each meets the smallest that may link to it, and neighbours in
  size. Links give components, so that a group of near copies becomes one from a few pairs a row.
* Further products: pairs of rows of different components with a name in common. First the closest pair of each two
  components in each block, then every pair. So no link between different components is lost, and links inside one would
  change nothing.
* Pairs whose column counts already differ too much are discarded where they meet: rows carry the counts of their n-grams in
  some hundred column blocks, and the least overlap is na + nb - sum |a - b|, halved, at most. For the others overlap is
  accumulated column block by column block, and a pair goes as soon as what is left cannot reach the least overlap.

A name that very many rows share is dealt to sub-blocks by row; delegates of these meet in the first
product, and pairs of sub-blocks in the others.

Sets are named by 64 bits of their XXH3 digest, n-grams by 64-bit hashes. A clash of block names only costs a comparison.

Defined cases: a null or wordless text has no shingles and links with nothing; fewer words than k are one
shingle; rows with equal sets are in one component, also under one doc_id; a null doc_id counts as greater than all
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, byte_column, components, freed, mixed, narrow, partitions, release, remove, row_key, shingle_hashes, signed, table, without, word_hashes, written

#: The largest sum of sizes of a scheme is so many times the next smaller scheme's.
RATIO = 1.4
SCHEMES = 64
LEVELS = 4
#: Names held while a task counts its own (half as many while it deals them), names of a block, about, and rows of a block of the further products, which come with their column counts.
CHUNK = 1_000_000
IN_BLOCK = 400_000
WHOLE_BLOCK = 25_000
#: log2 of the rows from which a name is dealt to sub-blocks of half as many; 2^HOTTEST names are dealt at most, the least number of rows rises with the corpus.
SPLIT_AT = 14
HOTTEST = 18
#: Pairs compared at once, and bytes of their column counts; a task holds some ten times as much.
PAIRS = 250_000
COMPARED = 4 << 20
#: Rows under one name from which neighbours in size are tried too.
NEIGHBOURS = 8

FIRST = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("names", pa.binary())])
FIRST_DDL = "kind byte, a long, n long, id long, h long, ids binary, counts binary, names binary"
DEALT = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("of", pa.binary()), ("names", pa.binary()), ("salts", pa.binary())])
DEALT_DDL = "block int, ids binary, of binary, names binary, salts binary"
COLUMN = pa.schema([("tok", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("id", pa.int64())])
COLUMN_DDL = "tok long, salt int, salts int, id long"
SET = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("s", pa.binary()), ("counts", pa.binary())])
SET_DDL = "id long, n int, s binary, counts binary"
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIR_DDL = "a long, b long"


def shingle_set(text: bytes | None, k: int, memo: Hashes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text, memo), k))


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


class Schemes:
    """Into how many column blocks a row is cut, by the sum of its own and its partner's size."""

    def __init__(self, num: int, den: int):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the similarity must be above a half, and 1 at most")
        self.num, self.den = num, den
        self.sums = [math.ceil((den + num) / (den - num))] if num < den else []
        while self.sums and len(self.sums) < SCHEMES:
            self.sums.append(max(self.sums[-1] + 1, int(self.sums[-1] * RATIO)))
        self.blocks = [self._blocks(x) for x in self.sums]

    def _blocks(self, total: int) -> int:
        # enough that the blocks without n-grams, of which this allows the mean and two deviations, leave more than may differ
        need = (self.den - self.num) * total // (self.den + self.num) + 1
        empty = math.exp(-total / (2 * RATIO * need))
        return math.ceil(need / (1 - empty) + 2 * math.sqrt(need * empty) + 0.5)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(scheme, n-grams that may differ at most) of each scheme of a row with n n-grams."""
        if not self.sums or not n:
            return []
        most = n * self.den // self.num
        if n + most < self.sums[0]:
            return []
        lo, hi = bisect_left(self.sums, n - (-self.num * n // self.den)), bisect_left(self.sums, n + most)
        if hi >= len(self.sums):
            raise ValueError(f"a set of {n} n-grams is too large")
        return [(j, (self.den - self.num) * min(self.sums[j], n + most) // (self.den + self.num)) for j in range(lo, hi + 1)]

    def names(self, s: np.ndarray) -> list[np.ndarray]:
        """Names of the blocks in which the sorted set s has n-grams; the low byte is the scheme and the level of the cut."""
        out, spread = [], None
        for j, differ in self.of(len(s)):
            cut = self.blocks[j]
            for level in range(LEVELS):
                if level == LEVELS - 1:
                    cut = 1 << 32  # an n-gram a block but for chance
                at = (s >> np.uint64(32)) * np.uint64(cut) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                if spread is None:
                    spread = mixed(s)
                kind = j * LEVELS + level
                h = mixed(np.add.reduceat(spread, starts) + mixed(at[starts] + np.uint64(kind << 40)))
                out.append((h & ~np.uint64(0xFF)) | np.uint64(kind))
                if len(starts) > differ:
                    break
                cut *= 4
        return out

    def least_overlap(self, na, nb):
        return -(-self.num * (na.astype(np.int64) + nb) // (self.den + self.num))

    def may_differ(self, na, nb):
        return na.astype(np.int64) + nb - 2 * self.least_overlap(na, nb)

    def meant(self, tok, na, nb):
        """Whether a name's scheme is the one of the sum of both sizes."""
        sums = np.array([0, *self.sums])
        j = (tok & 0xFF) // LEVELS
        total = na.astype(np.int64) + nb
        return (total > sums[j] - (j == 0)) & (total <= sums[j + 1])


def column_counts(s: np.ndarray) -> bytes:
    """n-grams in each of 64 or more column blocks, at least as many as half the n-grams, modulo 256."""
    size = 1 << max(6, min(15, (len(s) // 2).bit_length()))
    return (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 0xFF).astype(np.uint8).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams two rows of counts differ in at least; of two lengths the longer is folded first."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] + a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] + b[:, b.shape[1] // 2 :]
    d = a - b  # modulo 256
    return np.minimum(d, -d).sum(axis=1, dtype=np.int64)


class Counts:
    """Column counts of rows, by width, and which pairs they let pass."""

    def __init__(self, counts: list[bytes]):
        size = np.fromiter(map(len, counts), np.int64, len(counts))
        self.size, self.at, self.table = size, np.zeros(len(counts), np.int64), {}
        for w in np.unique(size).tolist():
            rows = np.flatnonzero(size == w)
            self.at[rows] = np.arange(len(rows))
            self.table[w] = np.frombuffer(b"".join(counts[r] for r in rows.tolist()), np.uint8).reshape(len(rows), w)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        wide = self.size[i] * (1 << 20) + self.size[j]
        for w in np.unique(wide).tolist():
            some = np.flatnonzero(wide == w)
            a, b = w >> 20, w & 0xFFFFF
            step = max(1, COMPARED // (a + b))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                out[part] = apart(self.table[a][self.at[i[part]]], self.table[b][self.at[j[part]]])
        return out


def _signatures(k: int, num: int, den: int):
    """A row for each document (kind 0); for each 500 documents the names of their blocks (1); names that several documents of a chunk have (2)."""
    none = [pa.nulls(1, f.type) for f in FIRST]

    def local(held):
        tok = np.concatenate(held)
        tok.sort()
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        n = np.diff(np.concatenate([first, [len(tok)]]))
        some = n >= 2
        rows = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, 2, np.int8)), signed(tok[first[some]]), pa.array(n[some]), *[pa.nulls(rows, f.type) for f in list(FIRST)[3:]]], schema=FIRST)

    def run(it):
        schemes, memo, held, size, seen = Schemes(num, den), Hashes(), [], 0, set()
        for b in it:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n, ids, new, counts, names = [], [], [], [], []
                for text in byte_column(part, "text"):
                    s = shingle_set(text, k, memo)
                    n.append(len(s))
                    ids.append(set_id(s))
                    if len(s) and ids[-1] not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(ids[-1])
                        got = schemes.names(s)
                        new.append(ids[-1])
                        counts.append(sum(map(len, got)))
                        names += got
                rest = [pa.nulls(len(n), pa.binary())] * 3
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), part.column("h"), *rest], schema=FIRST)
                if names:
                    all_names = np.concatenate(names)
                    packed = (np.array(new, np.int64).tobytes(), np.array(counts, np.int32).tobytes(), all_names.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), none[1], pa.array([len(all_names)], pa.int64()), *none[3:5], *(pa.array([x], pa.binary()) for x in packed)], schema=FIRST)
                    held.append(all_names)
                    size += len(all_names)
                if size >= CHUNK:
                    yield local(held)
                    held, size = [], 0
        if held:
            yield local(held)
        release()

    return run


def hot_names(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted names, log2 of their sub-blocks) of those with 2^SPLIT_AT rows, or total / 2^HOTTEST: so there are 2^HOTTEST at most."""
    least = max(1 << SPLIT_AT, total >> HOTTEST)
    got = counts.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a", F.greatest(F.floor(F.log2("n")) - (SPLIT_AT - 1), F.lit(0)).cast("int").alias("c")).toArrow()
    tok, c = got.column("a").to_numpy().view(np.uint64), got.column("c").to_numpy().astype(np.uint8)
    order = np.argsort(tok)
    return tok[order], c[order]


def _deal(blocks: int, hot):
    """Names to blocks: a row for each block of about CHUNK / 2 names, with the rows' ids, which of these each name is of, and its sub-blocks."""

    def send(ids, of, names):
        tok, cls = hot.value
        ids, of, names = np.concatenate(ids), np.concatenate(of), np.concatenate(names)
        salts = np.ones(len(names), np.int32)
        salt = np.zeros(len(names), np.int64)
        if len(tok):
            at = np.minimum(np.searchsorted(tok, names), len(tok) - 1)
            hit = tok[at] == names
            salts[hit] = np.left_shift(1, cls[at[hit]].astype(np.int32))
            salt[hit] = salt_of(ids[of[hit]], salts[hit])
        block = (mixed(names + salt.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]]))
        rows = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            o = order[lo:hi]
            used, ref = np.unique(of[o], return_inverse=True)
            many = salts[o]
            rows.append((int(block[o[0]]), ids[used].tobytes(), ref.astype(np.uint32).tobytes(), names[o].tobytes(), many.tobytes() if (many > 1).any() else b""))
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)

    def run(it):
        ids, of, names, size, base = [], [], [], 0, 0
        for b in it:
            for i, c, x in zip(*(b.column(k).to_pylist() for k in ("ids", "counts", "names")), strict=True):
                ids.append(np.frombuffer(i, np.int64))
                of.append(np.repeat(np.arange(base, base + len(ids[-1])), np.frombuffer(c, np.int32)))
                names.append(np.frombuffer(x, np.uint64))
                base += len(ids[-1])
                size += len(names[-1])
                if size >= CHUNK // 2:
                    yield send(ids, of, names)
                    ids, of, names, size, base = [], [], [], 0, 0
        if names:
            yield send(ids, of, names)
        release()

    return run


def salt_of(ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % salts


def _lists(*keys: np.ndarray) -> np.ndarray:
    """Number of the list that each row is in; rows are sorted by the keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _shared(tab):
    """The rows of names that two rows or more have, each row once."""
    cols = [[np.frombuffer(v, t) for v in tab.column(k).to_pylist()] for k, t in (("ids", np.int64), ("of", np.uint32), ("names", np.int64), ("salts", np.int32))]
    ids = np.concatenate([i[o] for i, o in zip(cols[0], cols[1], strict=True)])
    tok = np.concatenate(cols[2])
    salts = np.concatenate([m if len(m) else np.ones(len(o), np.int32) for m, o in zip(cols[3], cols[1], strict=True)])
    order = np.lexsort((ids, tok))
    ids, tok, salts = ids[order], tok[order], salts[order]
    # a set that two tasks met comes twice
    once = np.ones(len(ids), bool)
    once[1:] = (tok[1:] != tok[:-1]) | (ids[1:] != ids[:-1])
    ids, tok, salts = ids[once], tok[once], salts[once]
    salt = salt_of(ids, salts)
    g = _lists(tok)
    keep = (np.bincount(g)[g] > 1) | (salts > 1)
    return pa.table([tok[keep], salt[keep].astype(np.int32), salts[keep], ids[keep]], schema=COLUMN)


def _once(a, b):
    """Each pair once, smaller id first."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return pa.table([lo[new], hi[new]], schema=PAIR)


def _numbers(tab, *names):
    return (tab.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in names)


def _taken(col: pa.ChunkedArray, rows: np.ndarray) -> list[bytes]:
    """Values at these rows, without a copy of the others."""
    out, ends = np.empty(len(rows), object), np.cumsum([len(c) for c in col.chunks])
    chunk = np.searchsorted(ends, rows, side="right")
    for k in np.unique(chunk).tolist():
        some = np.flatnonzero(chunk == k)
        out[some] = col.chunk(k).take(pa.array(rows[some] - (ends[k] - len(col.chunk(k))))).to_pylist()
    return out.tolist()


def _sparse(num: int, den: int):
    def run(tab):
        schemes = Schemes(num, den)
        tok, salt, ids, n = _numbers(tab, "tok", "salt", "id", "n")
        order = np.lexsort((ids, n, salt, tok))
        tok, salt, ids, n = tok[order], salt[order], ids[order], n[order].astype(np.int64)
        g = _lists(tok, salt)
        row = np.arange(len(g))
        width = int(n.max()) + 1
        # the smallest that may link is the same for most names of a group
        head = np.searchsorted(g * width + n, g * width + -(-num * n // den))
        some = np.bincount(g)[g] > NEIGHBOURS
        i, j = np.concatenate([head, row[:-1][some[1:]]]), np.concatenate([row, row[1:][some[1:]]])
        ok = (g[i] == g[j]) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        ok = schemes.meant(tok[i], n[i], n[j])
        return _once(ids[i[ok]], ids[j[ok]])

    return run


def _whole(num: int, den: int, every: bool):
    """Pairs of rows of different components under one name; if not every, the closest of each two components."""

    def closest(root, i, j, far):
        p, q = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        best = np.lexsort((far, q, p))
        p, q = p[best], q[best]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        best = best[new]
        return i[best], j[best], far[best]

    def run(tab):
        schemes = Schemes(num, den)
        cols = dict(zip(names := ("tok", "i", "j", "salt", "id", "n", "root"), _numbers(tab, *names), strict=True))
        order = np.lexsort((cols["id"], cols["n"], cols["j"], cols["i"], cols["tok"]))
        x = {k: v[order] for k, v in cols.items()}
        g = _lists(x["tok"], x["i"], x["j"])
        lo, hi = np.full(g[-1] + 1, np.iinfo(np.int64).max), np.full(g[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(lo, g, x["root"])
        np.maximum.at(hi, g, x["root"])
        keep = (lo != hi)[g]
        if not keep.any():
            return pa.table([[], []], schema=PAIR)
        x, g, order = {k: v[keep] for k, v in x.items()}, g[keep], order[keep]
        ids, n, root, salt, tok = x["id"], x["n"].astype(np.int64), x["root"], x["salt"], x["tok"]
        _, first, of = np.unique(ids, return_index=True, return_inverse=True)
        counts = Counts(_taken(tab.column("counts"), order[first]))
        across = x["i"] != x["j"]
        width = int(n.max()) + 1
        end = np.searchsorted(g * width + n, g * width + np.minimum(n * den // num, width - 1), side="right")
        count = end - np.arange(len(g)) - 1
        ends = np.cumsum(count)
        found, at = [], 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            c = count[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            ok = (root[i] != root[j]) & (~across[i] | (salt[i] != salt[j]))
            i, j = i[ok], j[ok]
            ok = schemes.meant(tok[i], n[i], n[j])
            i, j = i[ok], j[ok]
            # pairs met under several names of the block are compared once
            a, b = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
            _, once = np.unique(a * len(first) + b, return_index=True)
            i, j = i[once], j[once]
            far = counts.apart(of[i], of[j])
            ok = far <= schemes.may_differ(n[i], n[j])
            i, j, far = i[ok], j[ok], far[ok]
            found.append((i, j, far) if every else closest(root, i, j, far))
            at = to
        i, j, far = (np.concatenate(p) for p in zip(*found, strict=True))
        if not every:
            i, j, far = closest(root, i, j, far)
        return _once(ids[i], ids[j])

    return run


def _sets(k: int):
    def run(it):
        memo = Hashes()
        for b in it:
            for at in range(0, b.num_rows, 500):
                got = [shingle_set(t, k, memo) for t in byte_column(b.slice(at, 500), "text")]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int32()), pa.array([s.tobytes() for s in got], pa.binary()), pa.array(map(column_counts, got), pa.binary())], schema=SET)
        release()

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], need: np.ndarray, steps: int = 8) -> np.ndarray:
    """Of each pair of sorted sets the overlap, accumulated over steps blocks of columns; -1 once it cannot reach need."""
    of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    tok = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    block = [(t >> np.uint64(61)).astype(np.int64) * steps // 8 for t in tok]
    held = [np.bincount(o * steps + k, minlength=len(a) * steps).reshape(-1, steps) for o, k in zip(of, block, strict=True)]
    left = np.minimum(*held)
    got, live = np.zeros(len(a), np.int64), left.sum(axis=1) >= need
    for k in range(steps):
        t, o = (np.concatenate([v[side][(block[side] == k) & live[of[side]]] for side in (0, 1)]) for v in (tok, of))
        order = np.lexsort((t, o))
        t, o = t[order], o[order]
        same = (t[1:] == t[:-1]) & (o[1:] == o[:-1])
        got += np.bincount(o[1:][same], minlength=len(a))
        live &= got + left[:, k + 1 :].sum(axis=1) >= need
    return np.where(live, got, -1)


def _linked(num: int, den: int):
    """The pairs (a, b, na, nb, sa, sb) whose overlap is large enough."""

    def run(it):
        schemes = Schemes(num, den)
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [[np.frombuffer(x, np.uint64) for x in part.column(k).to_pylist()] for k in ("sa", "sb")]
                need = schemes.least_overlap(*(part.column(k).to_numpy() for k in ("na", "nb")))
                yield part.select(["a", "b"]).filter(pa.array(overlaps(*sets, need) >= need))
        release()

    return run


def _near(num: int, den: int):
    """The pairs (a, b, na, nb, ca, cb) that column counts let pass."""

    def run(it):
        schemes = Schemes(num, den)
        for batch in it:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                m = part.num_rows
                counts = Counts(part.column("ca").to_pylist() + part.column("cb").to_pylist())
                far = counts.apart(np.arange(m), np.arange(m, 2 * m))
                yield part.select(["a", "b"]).filter(pa.array(far <= schemes.may_differ(*(part.column(k).to_numpy() for k in ("na", "nb")))))
        release()

    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, tag: str) -> DataFrame:
    """Those of the pairs (a, b) that link, as a written table."""
    side = lambda x, *cols: sets.select(F.col("id").alias(x), *[F.col(c).alias(c[0] + x) for c in cols])
    close = pairs.join(side("a", "n", "counts"), "a").join(side("b", "n", "counts"), "b").mapInArrow(_near(num, den), PAIR_DDL)
    close = narrow(close, tag + "-pairs")
    freed(close.sparkSession)
    links = narrow(close.join(side("a", "n", "s"), "a").join(side("b", "n", "s"), "b").mapInArrow(_linked(num, den), PAIR_DDL), tag + "-links")
    remove(close)
    freed(links.sparkSession)
    return links


def representatives(sets: DataFrame) -> DataFrame:
    """(id, doc_id, h) of one row of each set, the smallest doc_id's, a null one last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("r")
    return sets.where("n_shingles > 0").groupBy("id").agg(least).select("id", "r.doc_id", "r.h")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text), its set's id and h, a hash of its text."""
    spark = docs.sparkSession
    i, h = row_key()
    keyed = docs.select(i.alias("doc_id"), h, "text")
    first = narrow(keyed.mapInArrow(_signatures(k, num, den), FIRST_DDL), "signatures")
    total = first.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    hot = spark.sparkContext.broadcast(hot_names(first.where("kind = 2"), total))
    blocks = partitions(spark, total, IN_BLOCK)
    dealt = first.where("kind = 1").select("ids", "counts", "names").mapInArrow(_deal(blocks, hot), DEALT_DDL)
    columns = narrow(dealt.groupBy("block").applyInArrow(_shared, COLUMN_DDL), "columns")
    # the names are done with: what is still asked for of each document is a small table of its own
    packed, first = first, written(first.where("kind = 0").select("a", "n", "id", "h"), "documents")
    remove(packed)
    freed(spark)
    sets = first.select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "id", "h")
    reps = representatives(sets)

    # whole sets of the rows that share a name; ids may be null or repeated, so that a row is named by its text's hash too
    wanted = written(columns.select("id").distinct().join(reps, "id").select(F.col("doc_id").alias("i"), F.col("h").alias("text_h")).distinct(), "wanted")
    chosen = keyed.join(wanted.hint("merge"), keyed["doc_id"].eqNullSafe(wanted["i"]) & (keyed["h"] == wanted["text_h"]), "left_semi").select("text")
    whole = narrow(chosen.mapInArrow(_sets(k), SET_DDL).dropDuplicates(["id"]), "sets")
    remove(wanted)
    freed(spark)

    shared = columns.join(whole.select("id", "n"), "id")
    # of a name in sub-blocks, every 64th row (by id) of each also meets the others' in one list
    delegates = shared.where("salts > 1 and pmod(xxhash64(id), salts * 64) < 64").withColumn("salt", F.lit(-1))
    block = F.pmod(F.xxhash64("tok", "salt"), F.lit(blocks)).alias("block")
    near = shared.union(delegates).select("tok", "salt", "id", "n", block).groupBy("block").applyInArrow(_sparse(num, den), PAIR_DDL)
    links = verified(near.distinct(), whole, num, den, "near")
    roots = written(components(links), "roots")

    rows = columns
    for every in (False, True):
        info = whole.select("id", "n", "counts").join(roots.withColumnRenamed("a", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        # names under which components meet; rows of the others are not read again, as components only grow
        met = rows.join(info.select("id", "root"), "id").groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
        old, rows = rows, written(rows.join(met, "tok", "left_semi"), "met")
        remove(old)
        freed(spark)
        mixed_blocks = partitions(spark, rows.count(), WHOLE_BLOCK)
        tiles = rows.where("salts > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("i", F.least("salt", "o")).withColumn("j", F.greatest("salt", "o")).drop("o")
        alone = rows.where("salts = 1").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
        tile = F.pmod(F.xxhash64("tok", "i", "j"), F.lit(mixed_blocks)).alias("block")
        far = alone.unionByName(tiles).join(info, "id").select("tok", "i", "j", "salt", "id", "n", "root", "counts", tile).groupBy("block").applyInArrow(_whole(num, den, every), PAIR_DDL)
        links = links.union(verified(far.distinct(), whole, num, den, "far"))
        old, roots = roots, written(components(links), "roots")
        remove(old)
        freed(spark)
    remove(rows, whole, links)

    # a component's smallest doc_id: of each class, then of the linked classes
    least = reps.join(roots.withColumnRenamed("a", "id"), "id").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = written(roots.join(written(least, "least"), "root").select(F.col("a").alias("id"), F.col("component_id").alias("linked_id")), "linked")
    label = written(reps.join(linked, "id", "left").select("id", F.coalesce("linked_id", "doc_id").alias("component_id")), "label")
    out = sets.where("n_shingles > 0").join(label, "id").select("doc_id", "n_shingles", "component_id", "id", "h")
    return out.union(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "id", "h"))


def survivors(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs less all but one of each component: the smallest doc_id's, of its texts the one of least h."""
    got = written(join(docs, k, num, den), "joined")
    some = got.where("n_shingles > 0 and component_id is not null")
    best = some.where("doc_id = component_id").groupBy("component_id").agg(F.min("h").alias("best"))
    dropped = some.join(best, "component_id").where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("best"))))
    return without(docs, dropped.select(F.col("doc_id").alias("i"), "h").distinct())


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, n, unnest(s) AS t FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.t = b.t AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, root) USING KEY (id) AS (
  SELECT id, id FROM c
  UNION
  SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.id JOIN recurring.r AS o ON o.id = e.b WHERE r.root < o.root GROUP BY e.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN r ON r.id = c.id
"""
