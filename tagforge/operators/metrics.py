"""How evenly answers are spread. All metrics but the embedding one come from one histogram, (answer, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagforge.operators.taxonomy import Taxonomy

NAMES = ("cohesion_score", "normalized_entropy", "gini_coefficient", "coefficient_of_variation")


def answers(rows: DataFrame) -> DataFrame:
    """(answer) of conversations: the second turn; rows without one are left out."""
    return rows.select(F.try_element_at("conversations", F.lit(2)).getField("value").alias("answer")).where("answer is not null")


def histogram(rows: DataFrame) -> DataFrame:
    return rows.where("answer is not null").groupBy("answer").agg(F.count("*").alias("n"))



def evaluate(rows: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One row of the four metrics with the numbers of rows and classes. The histogram has a row for each class, so it is gathered in one."""
    hist = histogram(rows)
    branch = F.broadcast(taxonomy.branch_table(rows.sparkSession)).withColumnRenamed("category", "answer")
    h = hist.join(branch, "answer", "left")
    pairs = lambda n: n * (n - 1) / 2
    by_branch = h.groupBy("branch").agg(F.sum("n").alias("m"), F.collect_list("n").alias("ns"))
    g = by_branch.agg(
        F.sum("m").alias("total"), F.flatten(F.collect_list("ns")).alias("ns"),
        F.sum(F.when(F.col("branch").isNotNull(), pairs(F.col("m").cast("double")))).alias("close"),
    )
    total, k, ns = F.col("total").cast("double"), F.size("ns").cast("double"), F.col("ns")
    sum_of = lambda f: F.aggregate(F.array_sort(ns), F.lit(0.0), lambda s, n: s + f(n.cast("double")))
    running = F.aggregate(F.array_sort(ns), F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("all")), lambda s, n: F.struct((s["run"] + n).alias("run"), (s["all"] + s["run"] + n).alias("all")), lambda s: s["all"])
    mean = total / k
    return g.select(
        F.when(F.coalesce(total, F.lit(0.0)) < 2, 0.0).otherwise(F.coalesce(F.col("close"), F.lit(0.0)) / pairs(total)).alias(NAMES[0]),
        F.when(k <= 1, 0.0).otherwise(-sum_of(lambda n: n / total * F.log2(n / total)) / F.log2(k)).alias(NAMES[1]),
        F.when(k < 1, 0.0).otherwise((k + 1 - 2 * running / total) / k).alias(NAMES[2]),
        F.when(k < 1, 0.0).otherwise(F.sqrt(sum_of(lambda n: (n - mean) * (n - mean)) / k) / mean).alias(NAMES[3]),
        F.coalesce("total", F.lit(0)).cast("long").alias("n_rows"), F.size("ns").cast("long").alias("n_classes"),
    )


def health(m: DataFrame) -> Column:
    """One score of the metrics, in the columns of evaluate()."""
    cv = F.least(F.col(NAMES[3]), F.lit(2.5))
    return 0.4 * F.col(NAMES[0]) + 0.3 * F.col(NAMES[1]) + 0.2 * (1 - F.col(NAMES[2])) + 0.1 * (2.5 - cv) / 2.5


def embedding_cohesion(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """cohesion: the mean, over labels with two vectors, of the mean cosine of their pairs.

    Pairs are not made: the sum over pairs is (|sum u|^2 - sum |u|^2) / 2 for unit vectors u, so a label needs
    the sums of its dimensions, combined map-side.
    """
    norm = F.greatest(F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
    unit = F.transform(F.col(vector).cast("array<double>"), lambda x: x / F.col("norm"))
    v = vectors.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).withColumn("norm", norm).select(F.col(label).alias("label"), unit.alias("u"))
    dims = v.select("label", F.posexplode("u").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per = dims.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n")).where("n >= 2")
    return per.select(((F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("c")).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("cohesion"))
