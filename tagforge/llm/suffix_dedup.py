"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

Difference-cover blockwise suffix sorting, one suffix bucket at a time, after a content-defined deal:

* Every window of `length` bytes belongs to the anchor that its own bytes choose: its K-gram of least hash. Equal windows
  have equal anchors, so suffixes with different anchors never need comparing, wherever they start. The windows that one
  place's anchor owns form a span of less than 2 * length bytes; spans are what the corpus is dealt as.
* An anchor that occurs once has no repeated window. Spans that are equal throughout are one class (counts are combined
  map-side): all their windows are repeated. What is left are the open spans at the edges of repeats.
* The open spans of an anchor, with one span of each of its closed classes as witness, are sorted in suffix buckets. An anchor with more
  than HOT classes is parted further: each of its windows is a text of its own, in a bucket by all of its bytes; of those that are
  equal in one segment, byte by byte, one goes on as witness. In a task, the text is
  that of its spans; sample suffixes at a difference cover of period 57 get their ranks once, then suffixes are sorted by their first
  bytes bucket by bucket, and long ties are ordered by the sample ranks at the shift that puts both suffixes on the cover.
  Neighbours with `length` equal bytes are repeats: ranks of the cover go by as many bytes as a window has beyond its first. Memory is a task's spans.

Texts are handled once for all their copies; a text with copies is repeated as a whole. Texts are named by a 64-bit
hash, K-grams and spans by 64-bit polynomial hashes, so whole copies and closed spans are not compared byte by byte. Two spans
can only be taken for each other if they share an anchor, and have fewer bytes than the strings that make such hashes meet at any base.

Defined cases: a null text is empty; texts shorter than `length` keep all; rows that repeat a doc_id are separate documents; a
repeat inside one document counts, overlapping or not; very long texts are handled in segments; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, freed, mixed, partitions, release, remove, semi_by_id, signed, table, written

LENGTH = 200
GRAM = 48
#: Bytes handled at once, spans of one anchor that are sorted together, bytes of spans in a task, suffixes in a bucket.
SEGMENT = 1 << 20
HOT = 5000
IN_TASK = 4 << 20
BUCKET = 1 << 19
#: A perfect difference cover: fixed values.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes of a sample rank, and of the last part of a window that it may not reach.
RANKED, FIRST = 136, 64

BASE = 0x9E3779B97F4A7C15
ANCHOR = pa.schema([("d", pa.int64()), ("at", pa.int64()), ("a", pa.int64()), ("s", pa.int64())])
SPANS = pa.schema([("kind", pa.int8()), ("d", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("a", pa.int64()), ("h", pa.int64()), ("bytes", pa.binary())])
RUN = pa.schema([("d", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


class Roller:
    """Polynomial hashes of all substrings of a segment."""

    def __init__(self, most: int):
        one = np.ones(most + 1, np.uint64)
        one[1:] = np.uint64(BASE)
        self.power = np.cumprod(one)
        one[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        self.inverse = np.cumprod(one)
        self.byte = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prefix(self, text: np.ndarray) -> np.ndarray:
        p = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.byte[text] * self.power[: len(text)], out=p[1:])
        return p

    def at(self, prefix: np.ndarray, start: np.ndarray, size) -> np.ndarray:
        return mixed((prefix[start + size] - prefix[start]) * self.inverse[start] + np.asarray(size, np.uint64))


_roller: Roller | None = None


def roller() -> Roller:
    global _roller
    if _roller is None:
        _roller = Roller(2 * SEGMENT)
    return _roller


def spans_of(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor's hash, span's hash) of each anchor; documents end at ends, windows do not cross them."""
    r, none = roller(), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    size = np.maximum(ends - starts - length + 1, 0)
    if not size.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = r.prefix(text)
    grams = r.at(p, np.arange(len(text) - GRAM + 1), GRAM)
    low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    w, done = length - GRAM + 1, 1
    while done * 2 <= w:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < w:
        low = np.minimum(low[: len(low) - (w - done)], low[w - done :])
    doc = np.repeat(np.arange(len(ends)), size)
    t = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(size) - size), size)
    own = (low[t] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(own, prepend=-1))
    last = t[np.concatenate([new[1:], [len(t)]]) - 1]
    first = t[new]
    return doc[new], first, last, grams[own[new]], r.at(p, first, last + length - first)


def segments(texts: list[bytes], length: int):
    """(bytes, ends, document of each piece, where the piece begins in it): short texts together, long ones in pieces that overlap."""
    held, ends, docs, offsets, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), SEGMENT):
            piece = text[at : at + SEGMENT + length - 1]
            if len(piece) < length:
                continue
            held.append(piece)
            size += len(piece)
            ends.append(size)
            docs.append(i)
            offsets.append(at)
            if size >= SEGMENT // 2:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(ends), np.array(docs), np.array(offsets)
                held, ends, docs, offsets, size = [], [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(ends), np.array(docs), np.array(offsets)


def located(texts: list[bytes], length: int):
    """(segment, document, first and last window in the document, shift from document to segment, anchor, span) for each segment."""
    for seg, ends, docs, offsets in segments(texts, length):
        doc, first, last, a, s = spans_of(seg, ends, length)
        shift = np.concatenate([[0], ends[:-1]])[doc] - offsets[doc]
        yield seg, docs[doc], first - shift, last - shift, shift, a, s


def _anchors(length: int):
    def run(it):
        for b in it:
            names = b.column("d").to_numpy()
            for i in range(0, b.num_rows, 1000):
                for _, doc, first, _, _, a, s in located([t or b"" for t in byte_column(b.slice(i, 1000), "text")], length):
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([pa.array(names[i:][doc]), pa.array(first), signed(a), signed(s)], schema=ANCHOR)

    return run


def _pieces(length: int):
    """Of each text with its spans' states: closed runs (kind 0), bytes of spans to sort (1 open, 2 witness); h is the bucket within the anchor."""

    def run(it):
        for b in it:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                names = part.column("d").to_numpy()
                texts = [t or b"" for t in byte_column(part, "text")]
                state = [dict(zip(at, f, strict=True)) for at, f in zip(part.column("at").to_pylist(), part.column("state").to_pylist(), strict=True)]
                for seg, doc, first, last, shift, a, _ in located(texts, length):
                    rows = {k: [] for k in SPANS.names}
                    hot = []
                    for j, (d, t0, t1, sh, x) in enumerate(zip(doc.tolist(), first.tolist(), last.tolist(), shift.tolist(), a.view(np.int64).tolist(), strict=True)):
                        f = state[d].get(t0, -1)
                        if f < 0:
                            continue
                        name = names[d]
                        if f & 1:
                            for k, v in zip(SPANS.names, (0, name, t0, t1 + length, None, None, None), strict=True):
                                rows[k].append(v)
                        if f & 4:
                            hot.append((name, t0, t1, sh, x, 2 if f & 1 else 1))
                        elif f & 2:
                            for k, v in zip(SPANS.names, (2 if f & 1 else 1, name, t0, t1 + length, x, 0, seg[t0 + sh : t1 + sh + length].tobytes()), strict=True):
                                rows[k].append(v)
                    if rows["d"]:
                        yield pa.RecordBatch.from_pydict(rows, schema=SPANS)
                    if hot:
                        yield from _windows(seg, hot, length)
        release()

    return run


def _windows(seg: np.ndarray, spans: list[tuple], length: int):
    """The windows of a segment's spans of hot anchors: of equal ones all are repeated (kind 0) and one is a witness, the others are to sort."""
    name, first, last, shift, anchor, kind = (np.array(v, np.int64) for v in zip(*spans, strict=True))
    n = last - first + 1
    of = np.repeat(np.arange(len(spans)), n)
    at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    place = at + shift[of]
    h = roller().at(roller().prefix(seg), place, length)
    every = np.lib.stride_tricks.sliding_window_view(seg, length)
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] ^ np.uint64(1)))
    lead = order[new][np.cumsum(np.diff(h[order], prepend=h[order][:1] ^ np.uint64(1)) != 0) - 1]
    equal, step = np.zeros(len(order), bool), 1 << 15
    for i in range(0, len(order), step):
        equal[i : i + step] = (every[place[order[i : i + step]]] == every[place[lead[i : i + step]]]).all(axis=1)
    again = order[equal & (lead != order)]
    twice = np.zeros(len(order), bool)
    twice[again] = twice[lead[np.isin(order, again)]] = True
    goes = np.ones(len(order), bool)
    goes[again] = False
    for hit, kinds in ((twice, np.zeros(len(of), np.int64)), (goes, np.where(twice, 2, kind[of]))):
        i = np.flatnonzero(hit)
        for k in range(0, len(i), 20_000):
            j = i[k : k + 20_000]
            data = [every[p].tobytes() for p in place[j].tolist()] if hit is goes else [None] * len(j)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[j].astype(np.int8)), pa.array(name[of[j]]), pa.array(at[j]), pa.array(at[j] + length), pa.array(anchor[of[j]]), signed(h[j]), pa.array(data, pa.binary())], schema=SPANS)


def cover_shifts() -> np.ndarray:
    """shift[x, y]: the least d that puts residues x and y, both moved by d, on the cover."""
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    shift = np.full((PERIOD, PERIOD), -1, np.int64)
    x = np.arange(PERIOD)
    for d in range(PERIOD - 1, -1, -1):
        moved = on[(x + d) % PERIOD]
        shift[np.ix_(moved, moved)] = d
    if (shift < 0).any():
        raise ValueError("not a difference cover")
    return shift


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, in the order of strings; beyond the end are zeros."""
    t = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = np.zeros(len(text), np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | t[k : k + len(text)]
    return w


def _refine(group: np.ndarray, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order by (group, key), and the group numbers that tell keys apart."""
    o = np.lexsort((key, group))
    g, k = group[o], key[o]
    new = np.ones(len(o), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order[o], np.cumsum(new) - 1


def sample_ranks(word: np.ndarray, n: int) -> np.ndarray:
    """Rank among the cover's suffixes, by their first RANKED bytes, at each position of the cover (-1 elsewhere)."""
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    last = len(word) - 1
    order, group = at, np.zeros(len(at), np.int64)
    for k in range(0, RANKED, 8):
        order, group = _refine(group, np.where(order + k <= last, word[np.minimum(order + k, last)], 0), order)
    rank = np.full(n, -1, np.int64)
    rank[order] = group
    return rank


def repeated(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows at starts have an equal one among them. Blockwise: a bucket of suffixes at a time."""
    found = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return found
    word, shift = words_at(text), cover_shifts()
    rank = sample_ranks(word, len(text))
    head = word[starts]
    by_head = np.argsort(head, kind="stable")
    cut, at = head[by_head], 0
    while at < len(by_head):
        to = min(at + BUCKET, len(by_head))
        to = int(np.searchsorted(cut, cut[to - 1], side="right"))  # equal beginnings stay in one bucket
        _bucket(by_head[at:to], starts, word, rank, shift, length, found)
        at = to
    return found


def _bucket(members, starts, word, rank, shift, length, found) -> None:
    order, group = members, np.zeros(len(members), np.int64)
    for k in range(0, FIRST, 8):
        order, group = _refine(group, word[starts[order] + k], order)
        keep = np.bincount(group)[group] > 1
        order, group = order[keep], group[keep]
        if not len(order):
            return
    tails = range(length - FIRST, length - 7, 8)
    while len(order):
        # each tie of FIRST bytes is parted around its first suffix: before, equal or after it
        new = np.flatnonzero(np.diff(group, prepend=-1))
        number = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        i, p = starts[order], starts[order[new[number]]]
        d = shift[i % PERIOD, p % PERIOD]
        side = np.sign(rank[i + d] - rank[p + d])
        for k in tails:
            x, y = word[i + k], word[p + k]
            side = np.where(side == 0, (x > y).astype(np.int64) - (x < y), side)
        equal = side == 0
        more = np.bincount(number, weights=equal)[number] > 1
        found[order[equal & more]] = True
        order, group = order[~equal], number[~equal] * 2 + (side[~equal] > 0)
        o = np.argsort(group, kind="stable")
        order, group = order[o], group[o]
        keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        order, group = order[keep], group[keep]


def _sorted(length: int):
    def run(tab):
        spans = tab.column("bytes").to_pylist()
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        base = np.cumsum(size) - size
        n = size - length + 1
        of = np.repeat(np.arange(len(spans)), n)
        starts = np.arange(int(n.sum())) + np.repeat(base - (np.cumsum(n) - n), n)
        hit = repeated(np.frombuffer(b"".join(spans), np.uint8), starts, length)
        hit &= (tab.column("kind").to_numpy() == 1)[of]
        of, starts = of[hit], starts[hit]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(of)]]) - 1 if len(first) else first
        move = (tab.column("s").to_numpy() - base)[of[first]] if len(first) else np.zeros(0, np.int64)
        return pa.table([tab.column("d").to_numpy()[of[first]], starts[first] + move, starts[last] + move + length] if len(first) else [np.zeros(0, np.int64)] * 3, schema=RUN)

    return run


def _merged(tab):
    """Runs of a text that meet are one."""
    d, s, e = (tab.column(k).to_numpy() for k in ("d", "s", "e"))
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    new = np.ones(len(d), bool)
    new[1:] = d[1:] != d[:-1]
    doc = np.cumsum(new) - 1
    width = int(e.max()) + 1
    top = np.maximum.accumulate(doc * width + e) - doc * width
    new[1:] |= s[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(d)]]) - 1
    docs = np.flatnonzero(np.diff(doc[first], prepend=-1))
    ends = pa.array(np.concatenate([docs, [len(first)]]).astype(np.int32))
    return pa.table({"d": d[first][docs], "starts": pa.ListArray.from_arrays(ends, pa.array(s[first])), "ends": pa.ListArray.from_arrays(ends, pa.array(top[last]))})


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(docs' rows as doc_id, text, d) and (d, starts, ends): the byte runs of each text, named d, that are covered by repeated strings."""
    if length % 8 or not FIRST + RANKED <= length < 3 * FIRST + RANKED:
        raise ValueError("length must be a multiple of 8, 200 to 320")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).withColumn("d", F.xxhash64("text"))
    texts = written(rows.select("doc_id", "d", F.octet_length("text").cast("long").alias("n")).groupBy("d").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("r"), F.count("*").alias("copies"), F.first("n").alias("n")).select("d", F.col("r.doc_id").alias("rep"), "copies", "n"), "texts")
    count = texts.count()
    long_enough = rows.select("d", "text").where(F.octet_length("text") >= length)
    anchors = written(long_enough.mapInArrow(_anchors(length), "d long, at long, a long, s long"), "anchors")

    # copies of a text give equal rows: a place counts once
    met = anchors.groupBy("a").agg(F.count("*").alias("k"), F.min(F.struct("d", "at")).alias("lo"), F.max(F.struct("d", "at")).alias("hi")).where("k > 1 and lo <> hi").select("a")
    met = written(met, "met")
    again = written(semi_by_id(anchors, met, "a").distinct(), "again")
    remove(anchors, met)
    # tables of their own, so that the joins below can be split where an anchor or a span is hot
    classes = written(again.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("d", "at")).alias("w")), "span-classes")
    per_anchor = classes.groupBy("a").agg(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("open"), F.count("*").alias("classes"))
    per_anchor = written(per_anchor.where("classes > 1 or open = 0"), "span-anchors")
    spans = classes.join(per_anchor, "a")
    closed, some, hot = F.col("c") > 1, F.col("open") > 0, F.col("classes") > HOT
    witness = closed & some & (F.col("w") == F.struct("d", "at"))
    state = F.when(closed, 1).otherwise(0) + F.when(~closed | witness, F.when(hot, 4).otherwise(2)).otherwise(0)
    marked = again.join(spans, ["a", "s"]).select("d", "at", state.cast("int").alias("state"))
    states = marked.groupBy("d").agg(F.collect_list(F.struct("at", "state")).alias("x")).select("d", F.col("x.at").alias("at"), F.col("x.state").alias("state"))
    states = written(states.join(texts.select("d", "rep"), "d"), "states")

    chosen = rows.join(states.hint("merge"), (rows["d"] == states["d"]) & rows["doc_id"].eqNullSafe(states["rep"])).select(rows["d"], "text", "at", "state")
    parts = written(chosen.mapInArrow(_pieces(length), "kind byte, d long, s long, e long, a long, h long, bytes binary"), "spans")
    remove(again, classes, per_anchor, states)
    freed(spark)
    # a text that two tasks read comes twice; a place may be in a span and, of a hot anchor, a window
    to_sort = parts.where("kind in (1, 2)").dropDuplicates(["d", "s", "a", "h"])
    size = parts.where("kind in (1, 2)").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = partitions(spark, size, IN_TASK)
    runs = to_sort.withColumn("task", F.pmod(F.xxhash64("a", "h"), F.lit(tasks))).groupBy("task").applyInArrow(_sorted(length), "d long, s long, e long")
    runs = runs.union(parts.where("kind = 0").select("d", "s", "e")).union(texts.where(f"copies > 1 and n >= {length}").select("d", F.lit(0).cast("long"), "n"))
    blocks = partitions(spark, count, 20_000)
    merged = runs.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(blocks))).groupBy("block").applyInArrow(_merged, "d long, starts array<long>, ends array<long>")
    return rows, written(merged, "runs")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans of every row of docs."""
    rows, runs = repeats(docs, length)
    data = F.col("text").cast("binary")
    size = F.octet_length("text").cast("long")
    got = rows.join(runs.hint("merge"), "d", "left")
    # what is kept lies before the first run, between runs and after the last
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), "ends").alias("s"), F.concat("starts", F.array(size)).alias("e"))
    kept = F.aggregate(gaps, F.lit(b""), lambda acc, g: F.concat(acc, F.substring(data, g["s"].cast("int") + 1, (g["e"] - g["s"]).cast("int"))))
    removed = F.aggregate(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")), F.lit(0).cast("long"), lambda acc, g: acc + g["e"] - g["s"])
    return got.select(
        "doc_id",
        F.when(F.col("starts").isNull(), data).otherwise(kept).alias("kept"),
        size.alias("n_bytes"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("starts")).cast("long").alias("n_spans"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
