"""Uniform and stratified samples, chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagforge.functions import rng


def stratified(rows: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """min(size / strata, rounded half to even; rows of the stratum) rows of each stratum: those with the least hashes.

    The rank's window stops each task at the quota (a group limit before the shuffle), so a large stratum is never sorted in one place.
    """
    quota = rows.select(stratum).distinct().agg(F.bround(F.lit(size) / F.count("*"), 0).cast("int").alias("quota"))
    order = Window.partitionBy(stratum).orderBy(rng.digest(seed, F.col(key), "sample"), key)
    r = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return r.join(F.broadcast(quota)).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def missing(strata: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    return strata.join(sample, stratum, "left_anti")


def uniform_pairs(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """rows (pair, half, answer, ...): whole pairs, as many for each answer of a pair's second row: min(size div answers, the rarest's)."""
    odd = rows.where("half = 1").select("pair", F.col("answer").alias("k"))
    per = odd.groupBy("k").agg(F.count("*").alias("n"))
    quota = per.agg(F.least(F.floor(F.lit(size) / F.count("*")), F.min("n")).cast("int").alias("quota"))
    order = Window.partitionBy("k").orderBy(rng.digest(seed, F.col("pair"), "pair"), "pair")
    chosen = odd.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).join(F.broadcast(quota)).where(F.col("rank") <= F.col("quota"))
    return rows.join(chosen.select("pair"), "pair", "left_semi")


def agreement(audit: DataFrame, flag: str) -> DataFrame:
    """Of an audited sample: rows, agreed, share."""
    yes = (F.upper(F.trim(F.col(flag))) == "S").cast("int")
    return audit.agg(F.count("*").alias("n"), F.sum(yes).cast("long").alias("agreed"), F.avg(yes).alias("share"))
