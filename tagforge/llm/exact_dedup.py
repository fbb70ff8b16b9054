"""Exact dedup over a minimal perfect hash of historical digests.

A text's digest is the SHA-256 of its UTF-8 bytes without [\\x20\\x09-\\x0D]. The history is a table of
buckets; a bucket (leading bits of the digest) holds a minimal perfect hash over its distinct digests,
built level by level: each level marks the keys that are alone in their cell, and a key's slot is the
rank of its mark. Slots hold the full 32-byte digest and the winner's locator, so a lookup compares
all bytes: a digest that is not in the history may fall on a slot but is not taken for its owner.

Defined cases: a null text counts as empty; all empty texts are equal; of equal texts the row with the
most code points stays, then the smallest doc_id (a null doc_id is last); of rows with the
same doc_id and as many code points the first by a hash of the text stays, of identical rows one, and all of them count in
group_size; an empty table gives no rows; other
columns are ignored. A digest shared by a third of all rows is one slot; its rows are spread by salt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, row_key, table, without, written

GAMMA = 1.5
LEVELS = 40
#: Distinct digests in a bucket, about.
BUCKET = 50_000
#: A digest with more than 1/HOT of all rows is hot: there are fewer than HOT of them, so they can be broadcast.
HOT = 1000

INDEX = pa.schema([("bucket", pa.int64()), ("marks", pa.binary()), ("sizes", pa.list_(pa.int64())), ("digests", pa.binary()), ("keep_id", pa.list_(pa.int64())), ("keep_chars", pa.list_(pa.int64())), ("group_size", pa.list_(pa.int64()))])
FOUND = pa.schema([("row_id", pa.int64()), ("digest", pa.binary()), ("n_chars", pa.int64()), ("h_id", pa.int64()), ("h_chars", pa.int64()), ("h_size", pa.int64()), ("h", pa.int64()), ("first", pa.bool_()), ("top", pa.bool_())])
FOUND_DDL = "row_id long, digest binary, n_chars long, h_id long, h_chars long, h_size long, h long, first boolean, top boolean"


def _cells(words: np.ndarray, level: int, n: int) -> np.ndarray:
    h = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(marks, level sizes, slot of each of the n distinct digests); digests: n x 32 bytes."""
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    left, marks, sizes = np.arange(len(words)), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        n = max(64, int(GAMMA * len(left)))
        cell = _cells(words[left], level, n)
        mark = np.bincount(cell, minlength=n) == 1
        marks.append(mark)
        sizes.append(n)
        left = left[~mark[cell]]
    if len(left):
        raise ValueError("the digests of a bucket are not distinct")
    marks = np.concatenate(marks) if marks else np.zeros(0, bool)
    return marks, sizes, lookup(marks, sizes, digests)


def lookup(marks: np.ndarray, sizes: list[int], digests: np.ndarray) -> np.ndarray:
    """A slot for each digest, -1 if it hits no mark. A stranger may get a slot: compare the digest there."""
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    rank = np.cumsum(marks) - 1
    slot, open_, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, n in enumerate(sizes):
        at = base + _cells(words[open_], level, n)
        hit = marks[at]
        slot[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + n
    return slot


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, n_chars, h, digest) of every row; h is a hash of the text as it stands."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("h"),
        F.unhex(F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256)).alias("digest"),
    )


def _winner():
    """Greatest first: most code points, then the smallest id, null ids last."""
    return F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("row_id").isNull().alias("z"), F.col("row_id").alias("i")))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_chars, group_size) of every distinct digest; combined map-side, so a hot digest is a row for each task."""
    return rows.groupBy("digest").agg(_winner().alias("w"), F.count("*").alias("group_size")).select("digest", F.col("w.i").alias("keep_id"), (-F.col("w.c")).alias("keep_chars"), "group_size")


def _bucket(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n))


def _build(tab):
    d = np.frombuffer(b"".join(tab.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    marks, sizes, slot = build_mph(d)
    order = np.argsort(slot)
    take = pa.array(order)
    put = {k: [tab.column(k).combine_chunks().take(take).to_pylist()] for k in ("keep_id", "keep_chars", "group_size")}
    return pa.table({"bucket": [tab.column("bucket")[0].as_py()], "marks": [np.packbits(marks).tobytes()], "sizes": [sizes], "digests": [d[order].tobytes()], **put}, schema=INDEX)


def build_index(history: DataFrame, distinct: int) -> tuple[DataFrame, int]:
    """The index of winners() and its number of buckets; distinct: about how many digests there are."""
    n = partitions(history.sparkSession, distinct, BUCKET)
    index = history.withColumn("bucket", _bucket(n)).groupBy("bucket").applyInArrow(_build, "bucket long, marks binary, sizes array<long>, digests binary, keep_id array<long>, keep_chars array<long>, group_size array<long>")
    return index, n


def _probe(key, rows, index):
    if not rows.num_rows:
        return FOUND.empty_table()
    rows = rows.combine_chunks()
    given = [None] * rows.num_rows
    # equal rows are in one task: of each digest, doc_id and size the row of least h is the top, of identical ones one is first
    code = rows.column("digest").combine_chunks().dictionary_encode().indices.to_numpy()
    row_id = rows.column("row_id")
    n, h, i, null = rows.column("n_chars").to_numpy(), rows.column("h").to_numpy(), row_id.fill_null(0).to_numpy(), row_id.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((h, n, i, null, code))
    new = np.ones(len(order), bool)
    new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (n, i, null, code)], axis=0)
    top, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    top[order] = new
    new[1:] |= h[order][1:] != h[order][:-1]
    first[order] = new
    h_id, h_chars, h_size = given, given, given
    if index.num_rows:
        x = {k: index.column(k)[0] for k in index.column_names}
        sizes = x["sizes"].as_py()
        marks = np.unpackbits(np.frombuffer(x["marks"].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        d = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        slot = lookup(marks, sizes, d)
        held = np.frombuffer(x["digests"].as_py(), np.uint8).reshape(-1, 32)
        slot = np.where((slot >= 0) & (held[slot] == d).all(axis=1), slot, -1)
        take = pa.array(slot, pa.int64(), mask=slot < 0)
        h_id, h_chars, h_size = (x[k].values.take(take) for k in ("keep_id", "keep_chars", "group_size"))
    return pa.table([rows.column("row_id"), rows.column("digest"), rows.column("n_chars"), pa.array(h_id, pa.int64()), pa.array(h_chars, pa.int64()), pa.array(h_size, pa.int64()), rows.column("h"), pa.array(first), pa.array(top)], schema=FOUND)


def probe(rows: DataFrame, index: DataFrame, n: int, hot: DataFrame) -> DataFrame:
    """Every row with the winner that the history has for its digest (h_id, h_chars, h_size), or nulls.

    hot: (digest, salts), fewer than HOT rows. Rows of a hot digest go to salts tasks, to each of which
    the bucket's index goes too.
    """
    salted = F.pmod(F.xxhash64("row_id", "n_chars"), F.coalesce("salts", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("bucket", _bucket(n)).withColumn("salt", salted)
    most = hot.withColumn("bucket", _bucket(n)).groupBy("bucket").agg(F.max("salts").alias("salts"))
    index = index.join(F.broadcast(most), "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    left = rows.select("row_id", "digest", "n_chars", "h", "bucket", "salt")
    return left.groupBy("bucket", "salt").cogroup(index.drop("salts").groupBy("bucket", "salt")).applyInArrow(_probe, FOUND_DDL)


def found_in(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, with its winner (h_id, h_size), kept, what names it (row_id, h), and whether it is the first of the rows with that name.

    history: winners() of earlier batches. With it, a row whose digest the history has is a repeat of
    the history's winner (kept is false), and the others group among themselves. Without it, docs are
    their own history: the index holds every digest of theirs, and each row looks up its winner.
    """
    rows = written(digests(docs, id_col, text_col), "digests")  # texts are read and hashed once
    own = winners(rows)
    past = own if history is None else history
    total = rows.count()
    index, n = build_index(past, total if history is None else past.count())
    hot = own.where(F.col("group_size") * HOT > F.lit(max(total, 20 * HOT))).select("digest", F.ceil(F.col("group_size") / F.lit(max(1000, total // HOT))).cast("int").alias("salts"))
    found = probe(rows, index, n, hot)
    best = F.col("row_id").eqNullSafe(F.col("h_id")) & (F.col("n_chars") == F.col("h_chars")) & F.col("top")
    if history is not None:
        fresh = winners(found.where("h_size is null").select("row_id", "n_chars", "digest"))
        old = found.where("h_size is not null").withColumn("kept", F.lit(False))
        new = found.where("h_size is null").drop("h_id", "h_chars", "h_size").join(fresh, "digest").withColumnsRenamed({"keep_id": "h_id", "keep_chars": "h_chars", "group_size": "h_size"})
        found = old.unionByName(new.withColumn("kept", best))
    else:
        found = found.withColumn("kept", best)
    return found


def dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; see found_in()."""
    return found_in(docs, history, id_col, text_col).select(F.col("row_id").alias(id_col), F.col("h_id").alias("keep_id"), F.col("h_size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, all their columns; of identical rows one."""
    found = written(found_in(docs, history).select(F.col("row_id").alias("i"), "h", "kept", "first"), "found")
    out = without(docs, found.where("first and not kept").select("i", "h"))
    if found.where("not first").isEmpty():
        return out
    i, h = row_key()
    rows = out.select(i, h, F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row"))
    return rows.dropDuplicates(["i", "h"]).select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
