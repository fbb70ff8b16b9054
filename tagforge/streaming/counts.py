"""Running counts of answers over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_counts(stream: DataFrame) -> DataFrame:
    """(answer, n) so far; state has a row for each class."""
    return stream.where("answer is not null").groupBy("answer").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(start, answer, n) by event time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "answer").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "answer", "n")
