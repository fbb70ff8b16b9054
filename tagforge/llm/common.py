"""What several operators share: the shared folder, written tables, hashing of words, connected components."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.operators.stored import new_path, remove, shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"
#: Most rows that a side may have to be broadcast (ids of 8 bytes); a larger side is joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; else they stay on executors' disks until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _written_under(df: DataFrame, tag: str, key: str, before: str, value: str) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set(key, value)
    try:
        return written(df, tag)
    finally:
        conf.set(key, before)


def settled(df: DataFrame, tag: str) -> DataFrame:
    """written(); the shuffle files of its plan are removed at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    return _written_under(df, tag, key, df.sparkSession.conf.get(key, "false"), "true")


def narrow(df: DataFrame, tag: str) -> DataFrame:
    """written(); Python gets batches of about BATCH_BYTES, or of the session's limit if that is less."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before := spark.conf.get(key))
    return _written_under(df, tag, key, before, str(min(limit, BATCH_BYTES) if limit > 0 else BATCH_BYTES))


#: Each running task has a batch in its executor's memory outside the heap, in buffers of up to twice its size, and again in Python; Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Gives freed memory back to the system, as Python workers stay for later tasks, of other operators too."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def partitions(spark: SparkSession, rows: int, each: int, least: int = 0) -> int:
    """Blocks for so many rows, at least the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str | list[str], count: int | None = None) -> DataFrame:
    """Rows of df whose key is in ids, which grow with df and are shuffled; with a count, as for a bounded sample, they are broadcast if few."""
    return df.join(F.broadcast(ids) if count is not None and count <= BROADCAST_ROWS else ids.hint("merge"), key, "left_semi")


class Hashes(dict):
    """64-bit hashes of byte strings, kept up to a number of entries; the rest is computed anew."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes | None, memo: Hashes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased; white space is [\\x20\\x09-\\x0D]."""
    words = (text or b"").lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words; fewer words are one run; none for no words."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    h = words[: n - size + 1].copy()
    for j in range(1, size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[j : n - size + 1 + j]
    return mixed(h + np.uint64(size))


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    col = batch.column(name)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; others, whatever their names, play no part."""
    return df.select(*names)


def digest_hex(col: Column) -> Column:
    return F.lower(F.sha2(col, 256))


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        lo, hi = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        live = lo != hi
        i, j = i[live], j[live]
        np.minimum.at(root, hi[live], lo[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _forest(it):
    """Edges of a spanning forest, each from a node to its root, for each FOREST edges that come by."""

    def out():
        a, b = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        nodes, root = _roots(a, b)
        some = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(root[some], pa.int64())], names=["a", "b"])

    held, seen = [], 0
    for batch in it:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        seen += batch.num_rows
        if seen >= FOREST:
            yield out()
            held, seen = [], 0
    yield out()


#: Edges that a task turns into a spanning forest at once.
FOREST = 1_000_000


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(a, root) for every node of edges (a, b): root is the smallest id of its component.

    Each FOREST edges first give way to a spanning forest of theirs, so that a dense component brings as many edges as
    nodes. As long as more than FOREST edges are left, large-star and small-star rounds follow; each round's edges
    are a written table, so nothing is collected and a lost executor costs one round. The last FOREST edges are one task's.
    A node's neighbours are never gathered in one row: the least of them is a map-side combined minimum, joined back.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), tag)
    n, last = e.count(), None
    while n:
        new = written(e.coalesce(max(1, n // FOREST)).mapInArrow(_forest, "a long, b long"), tag)
        remove(e)
        e, one = new, n <= FOREST
        if one:
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = written(small, tag)
        remove(e)
        e, seen = new, _fingerprint(new)
        if seen == last:
            break
        n, last = seen[0], seen
    roots = e.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("root"))
    return e.select("a", F.col("b").alias("root")).union(roots)


def batches(it: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that long texts do not meet in memory."""
    for b in it:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def row_key() -> tuple[Column, Column]:
    """What names a row of documents where a doc_id may be repeated: doc_id and a hash of the text."""
    return F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows named in dropped (i, h), whatever other columns docs has. dropped is broadcast only if it is small."""
    n = dropped.count()
    i, h = row_key()
    rows = docs.select(i, h, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    side = F.broadcast(dropped) if n <= BROADCAST_ROWS else dropped.hint("merge")
    return rows.join(side, rows["i"].eqNullSafe(dropped["i"]) & (rows["h"] == dropped["h"]), "left_anti").select("row.*")
