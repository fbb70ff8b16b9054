"""Corpus-like views of the driver tables: sentences, mentions, predictions, option-list rows, tokens, responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.functions import text as T
from tagforge.operators import bio, prompts
from tagforge.operators.numbering import in_order
from tagforge.operators.taxonomy import Taxonomy

LEAVES = 155


class Whole(str):
    """A folder whose views have every sentence and every mention; doc_id and ord are then the sentence's number.

    The plain views stop at a document's first sentence and its first three mentions, as FIXTURES.md and the SQL have them.
    The table of sentences is kept with the folder, so that a query which reads it more than once splits and numbers them once.
    """

    numbered: DataFrame | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, doc_id, n, sentence): every long sentence, numbered from 0 by document and place."""
    if isinstance(sf_dir, Whole) and sf_dir.numbered is not None:
        return sf_dir.numbered
    # texts are dealt out, not sentences: they are split once, and not for the sample of doc_id that sets the ranges
    d = read(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange("doc_id")
    d = d.select("doc_id", F.posexplode(T.sentences(T.clean(F.col("text")))).alias("n", "sentence")).sortWithinPartitions("doc_id", "n", "sentence")
    s = in_order(d, "number").select("number", "doc_id", "n", "sentence")
    if isinstance(sf_dir, Whole):
        sf_dir.numbered = s
    return s


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentence): the first long sentence of each document; of a Whole folder (number, sentence) of all."""
    if isinstance(sf_dir, Whole):
        return all_sentences(spark, sf_dir).select(F.col("number").alias("doc_id"), "sentence")
    # exploded, as a filter on the split would compute it twice
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.slice(T.sentences(T.clean(F.col("text"))), 1, 1)).alias("sentence"))


def found(sf_dir: str) -> Column:
    """(entity, i) of a sentence's mentions in order: its first three long words (of a Whole folder all), each with the number of a leaf."""
    words = F.regexp_extract_all("sentence", F.lit(r"[\p{L}]{6,}"), F.lit(0))
    words = words if isinstance(sf_dir, Whole) else F.slice(words, 1, 3)
    return F.transform(words, lambda e, p: F.struct(e.alias("entity"), F.pmod(F.col("doc_id") * F.col("doc_id") + 31 * p, F.lit(LEAVES)).cast("int").alias("i")))


def leaf(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, sorted(Taxonomy.of().leaf_parent()))), i)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentence, pos, entity, l1, l2, l3): the first three long words (of a Whole folder all), with a leaf each."""
    m = sentences(spark, sf_dir).select("doc_id", "sentence", F.posexplode(found(sf_dir)).alias("pos", "m")).select("doc_id", "sentence", "pos", "m.*")
    return m.join(F.broadcast(Taxonomy.of().leaf_index(spark)), "i").select("doc_id", "sentence", F.col("pos").cast("int").alias("pos"), "entity", "l1", "l2", "l3", "i")


def counted(spark: SparkSession, sf_dir: str, form: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, form, n): how often a sentence's mentions have a form, from runs of equal ones."""
    s = sentences(spark, sf_dir).select("doc_id", F.explode(F.array(F.array_sort(F.transform(found(sf_dir), lambda m: form(m["entity"]))))).alias("f"))
    s = s.select("doc_id", "f", F.explode(F.array(F.filter(F.transform("f", lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get("f", i - 1)), i)), lambda i: i.isNotNull()))).alias("at"))
    ends = F.concat(F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), F.array(F.size("f")))
    runs = F.zip_with("at", ends, lambda a, b: F.struct(F.get("f", a).alias("form"), (b - a).cast("long").alias("n")))
    return s.where(F.size("f") > 0).select("doc_id", F.explode(runs).alias("x")).select("doc_id", "x.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, entity, category): mentions with losses, errors and inventions."""
    return labelled(spark, sf_dir).select("doc_id", F.explode("predicted").alias("x")).select("doc_id", "x.*")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentence, truth, predicted): a sentence's mentions and what is predicted, as arrays of (entity, category)."""
    s = sentences(spark, sf_dir).select("doc_id", "sentence", F.explode(F.array(found(sf_dir))).alias("m"))
    d, pair = F.col("doc_id"), lambda e, c: F.struct(e.alias("entity"), c.alias("category"))
    wrong = F.transform("m", lambda m, p: F.when((d + p) % 5 != 0, pair(m["entity"], leaf(F.when((d + p) % 7 == 0, (m["i"] + 1) % LEAVES).otherwise(m["i"])))))
    extra = F.when((d % 11 == 0) & (F.size("m") > 0), F.array(pair(F.lit("zzzzzz"), F.lit("city"))))
    none = F.array().cast("array<struct<entity:string,category:string>>")
    predicted = F.when(d % 13 != 0, F.concat(F.filter(wrong, lambda x: x.isNotNull()), F.coalesce(extra, none))).otherwise(none)
    both = F.struct(F.transform("m", lambda m: pair(m["entity"], leaf(m["i"]))).alias("truth"), predicted.alias("predicted"))
    return s.select("doc_id", "sentence", F.explode(F.array(both)).alias("x")).select("doc_id", "sentence", "x.*")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, sentence, mentions) with a document's mentions in order."""
    pairs = F.transform(found(sf_dir), lambda m: F.struct(m["entity"].alias("entity"), leaf(m["i"]).alias("category")))
    # exploded, as a filter on the mentions would find them twice
    some = sentences(spark, sf_dir).select(F.col("doc_id").alias("ord"), "sentence", "doc_id", F.explode(F.array(pairs)).alias("mentions"))
    return some.where(F.size("mentions") > 0).drop("doc_id")


def options(spark: SparkSession, sf_dir: str, sentences: bool = True) -> DataFrame:
    """(row_id, ord, pos, level, prompt, answer, options): three rows for each mention. sentences: see stage2."""
    rows = prompts.stage2(base(spark, sf_dir), Taxonomy.of(), sentences=sentences)
    if isinstance(sf_dir, Whole):  # stage2's own row_id has room for any number of mentions
        return rows
    return rows.withColumn("row_id", (F.col("ord") * 3 + F.col("pos")) * 3 + F.col("level") - 1)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.encode(base(spark, sf_dir))


def two_responses(entities: Column) -> list[Column]:
    """The sentence with its first mention marked, and with all."""
    return [T.mark_first(F.col("sentence"), entities[0]), prompts.mark_all(F.col("sentence"), entities)]


def responses(spark: SparkSession, sf_dir: str, most: int = 2) -> DataFrame:
    """(doc_id, query, ord, response): the two responses to each sentence, or the first (most=1)."""
    b = base(spark, sf_dir)
    return b.select(F.col("ord").alias("doc_id"), F.col("sentence").alias("query"), F.posexplode(F.array(*two_responses(F.col("mentions.entity"))[:most])).alias("ord", "response"))


def responded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, responses of response and n): both responses to each sentence, once for the n documents that have it."""
    s = sentences(spark, sf_dir).groupBy("sentence").agg(F.count("*").alias("n")).withColumn("doc_id", F.lit(0))
    s = s.select("sentence", "n", F.explode(F.array(F.transform(found(sf_dir), lambda m: m["entity"]))).alias("e")).where(F.size("e") > 0)
    return s.select(F.col("sentence").alias("query"), F.array(*[F.struct(r.alias("response"), "n") for r in two_responses(F.col("e"))]).alias("responses"))
