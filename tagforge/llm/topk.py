"""Exact top-k inner-product search: tiles of query blocks and candidate shards.

Both sides are packed into blocks of rows. A tile is one query block against one shard: a matrix
product, a partial selection of the k best per query, and only those leave the tile. The lists of a
query are merged in a tree: first those of a group of shards, then those of the groups. Memory is
a tile's matrices and scores, whatever the number of rows.

Components are quantised to floor(scale * x), x as double. The product runs in doubles while all of
its sums are below 2^53 and so exact, else in Python integers. Ties go to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors of
one length are compared; a null id takes no part; rows that repeat an id are separate candidates and separate queries,
each with a list of its own, except that a query never gets rows of its own id; an empty table gives no rows; a score beyond 64 bits is
held at the limit; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

QUERIES = 512
CANDIDATES = 8192
LEAST = 1024
FAN_IN = 16
EXACT = float(1 << 53)
HITS = pa.schema([("query_id", pa.int64()), ("variant", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])
PACKED = pa.schema([("ids", pa.binary()), ("variants", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32()), ("block", pa.int32())])


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))


def _pack(most: int, scale: float):
    def pack(key, tab):
        dim, block = (tab.column(k)[0].as_py() for k in ("dim", "block"))
        ids, variants = (tab.column(k).combine_chunks().to_numpy() for k in ("id", "variant"))
        flat = np.floor(scale * tab.column("v").combine_chunks().flatten().to_numpy()).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        at = range(0, len(ids), most)
        parts = [[np.ascontiguousarray(x[order[i : i + most]]).tobytes() for i in at] for x in (ids, variants, flat)]
        return pa.table([*parts, [dim for _ in at], [block for _ in at]], schema=PACKED)

    return pack


def packed(rows: DataFrame, blocks: int, most: int, scale: float) -> DataFrame:
    """(ids, variants, vectors, dim, block): rows dealt to blocks by a hash of id and vector, each block cut into packs of at most so many."""
    dealt = rows.withColumn("block", F.pmod("variant", F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(_pack(most, scale), "ids binary, variants binary, vectors binary, dim int, block int")


def tile_hits(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best of each query; candidates are in order of id."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        s = q @ c.T
        s[q_ids[:, None] == c_ids[None, :]] = -np.inf
        pos, take = np.arange(len(q)), min(k, s.shape[1])
        if take < s.shape[1]:
            # the k-th best score, then all above it and, of those equal to it, the smallest ids
            floor_ = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
            above = s > floor_[:, None]
            level = (s == floor_[:, None]) & (s > -np.inf)
            room = take - above.sum(axis=1)
            level &= np.cumsum(level, axis=1) <= room[:, None]
            r, j = np.nonzero(above | level)
        else:
            r, j = np.nonzero(s > -np.inf)
        return pos[r], j, s[r, j].astype(np.int64)
    out = []
    ci = [[int(x) for x in row] for row in c]
    for r, row in enumerate(q):
        qi = [int(x) for x in row]
        best = sorted((-sum(a * b for a, b in zip(qi, x, strict=True)), j) for j, x in enumerate(ci) if c_ids[j] != q_ids[r])[:k]
        out += [(r, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, j in best]
    r, j, s = zip(*out, strict=True) if out else ((), (), ())
    return np.array(r, np.int64), np.array(j, np.int64), np.array(s, np.int64)


def _tiles(k: int):
    def run(it):
        for b in it:
            cols = {x: b.column(x) for x in b.schema.names}
            for i in range(b.num_rows):
                dim = cols["dim"][i].as_py()
                q_ids, variants, c_ids = (np.frombuffer(cols[x][i].as_py(), np.int64) for x in ("q_ids", "q_variants", "ids"))
                q, c = (np.frombuffer(cols[x][i].as_py(), np.float64).reshape(-1, dim) for x in ("q_vectors", "vectors"))
                for at in range(0, len(q), QUERIES):
                    r, j, s = tile_hits(q_ids[at : at + QUERIES], q[at : at + QUERIES], c_ids, c, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at : at + QUERIES][r]), pa.array(variants[at : at + QUERIES][r]), pa.array(c_ids[j]), pa.array(s), pa.array(np.full(len(r), cols["shard"][i].as_py(), np.int64))], schema=HITS)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, never rows of the query's own id."""
    spark = candidates.sparkSession
    # a query is known by its id and a hash of both, as an id may be repeated; equal rows are asked once
    c, q = (usable(x, id_col, vector_col).withColumn("variant", F.xxhash64("id", "v")) for x in (candidates, queries))
    again = q.groupBy("id", "variant").agg(F.count("*").alias("copies")).where("copies > 1")
    q = q.dropDuplicates(["id", "variant"])
    n_c, n_q = candidates.count(), queries.count()
    # small tables still get a shard for each task, but none of fewer rows than LEAST
    shards, blocks = max(-(-n_c // CANDIDATES), min(partitions(spark, 0, 1), -(-n_c // LEAST)), 1), max(1, -(-n_q // QUERIES))
    # each shard meets each query block: the shards' packs are sent to as many tiles as there are blocks
    qs = packed(q, blocks, QUERIES, scale).select(F.col("ids").alias("q_ids"), F.col("variants").alias("q_variants"), F.col("vectors").alias("q_vectors"), F.col("dim").alias("q_dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("tile"))
    cs = packed(c, shards, CANDIDATES, scale).withColumnRenamed("block", "shard")
    tiles = cs.join(qs, (cs["shard"] == qs["tile"]) & (cs["dim"] == qs["q_dim"])).select("shard", "q_ids", "q_variants", "q_vectors", "ids", "vectors", "dim")
    hits = tiles.mapInArrow(_tiles(k), "query_id long, variant long, vec_id long, score long, shard long")
    best = [F.col("score").desc(), F.col("vec_id")]
    group = Window.partitionBy("query_id", "variant", "g").orderBy(*best)
    groups = hits.withColumn("g", F.pmod("shard", F.lit(max(1, shards // FAN_IN)))).withColumn("r", F.row_number().over(group)).where(F.col("r") <= k)
    top = groups.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(*best))).where(F.col("rank") <= k)
    top = top.join(again.select(F.col("id").alias("query_id"), "variant", "copies"), ["query_id", "variant"], "left")
    top = top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return top_k(e.where("vec_id % 20 = 0"), e)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
