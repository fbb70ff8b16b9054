"""Row numbers without one task that sorts everything."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.operators.stored import written


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with n = 0, 1, ... by order, which must be total: ranges are sorted by themselves and shifted by the rows before them.

    The ranges are a written table, and the driver gets one count for each.
    """
    return in_order(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def in_order(df: DataFrame, name: str = "n") -> DataFrame:
    """df, whose partitions and rows are in order, with n = 0, 1, ...

    Spark's id is the partition and the place in it, so that no rows move; it is written with them, as another run could cut the
    ranges elsewhere.
    """
    p = written(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33).cast("int")
    counts = {r["_part"]: r["last"] + 1 for r in p.groupBy(part.alias("_part")).agg(F.max(F.col("_id").bitwiseAND((1 << 33) - 1)).alias("last")).collect()}
    parts = sorted(counts)
    before = list(accumulate([counts[k] for k in parts], initial=0))[:-1]
    shifts = df.sparkSession.createDataFrame(list(zip(parts, before, strict=True)), "_part int, _before long")
    inner = F.col("_id").bitwiseAND((1 << 33) - 1)
    return p.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn(name, (F.col("_before") + inner).cast("long")).drop("_part", "_before", "_id")
