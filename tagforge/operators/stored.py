"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only on a local master without the setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/tagforge"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tagforge-")
    return f"file://{_own}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Deletes tables of written(), once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/tagforge" in f:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
