"""Coverage of the ontology, checks of rows, and what is to be generated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagforge.operators.taxonomy import Taxonomy


def counts(found: DataFrame) -> DataFrame:
    """(file, n, categories) and a last row for all (file null) of rows (file, category)."""
    return found.rollup("file").agg(F.count("category").alias("n"), F.countDistinct("category").alias("categories"), F.grouping("file").alias("g")).select(F.when(F.col("g") == 0, F.col("file")).alias("file"), "n", "categories")


def unknown(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """(category, n) of names that are no leaf."""
    return found.join(F.broadcast(leaves.select("category")), "category", "left_anti").groupBy("category").agg(F.count("*").alias("n"))


def per_leaf(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """(category, parent, n) of every leaf."""
    return leaves.join(found.groupBy("category").agg(F.count("*").alias("n")), "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def summary(found: DataFrame, leaves: DataFrame) -> DataFrame:
    covered = F.sum((F.col("n") > 0).cast("int"))
    return per_leaf(found, leaves).agg(F.count("*").alias("leaves"), covered.cast("long").alias("covered"), (F.count("*") - covered).cast("long").alias("missing"), F.round(100.0 * covered / F.count("*"), 4).alias("covered_percent"))


def missing_by_parent(found: DataFrame, leaves: DataFrame) -> DataFrame:
    return per_leaf(found, leaves).where("n = 0").groupBy("parent").agg(F.array_sort(F.collect_list("category")).alias("missing"))


def thin(found: DataFrame, leaves: DataFrame, below: int = 5) -> DataFrame:
    return per_leaf(found, leaves).where((F.col("n") > 0) & (F.col("n") < below)).orderBy("n", "category")


def filter_synthetic(records: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records with source 'synthetic', counts by reason) of records (text, entities of text and category)."""
    known = leaves.select("category").distinct().agg(F.collect_set("category").alias("leaves"))
    r = records.join(F.broadcast(known))
    empty = (F.coalesce("text", F.lit("")) == "") | (F.coalesce(F.size("entities"), F.lit(0)) <= 0)
    valid = lambda e: F.array_contains("leaves", F.coalesce(e["category"], F.lit("")))
    there = lambda e: F.instr(F.col("text"), F.coalesce(e["text"], F.lit(""))) > 0
    kinds = F.transform("entities", lambda e: F.when(~valid(e), 1).when(~there(e), 2).otherwise(0))
    r = r.withColumn("empty", empty).select("*", F.explode(F.array(kinds)).alias("kinds"))  # exploded, so that it is there once
    r = r.withColumn("good", F.filter("entities", lambda e, i: F.get("kinds", i) == 0))
    r = r.withColumns({
        "invalid": F.when(empty, 0).otherwise(F.size(F.filter("kinds", lambda k: k == 1))),
        "lost": F.when(empty, 0).otherwise(F.size(F.filter("kinds", lambda k: k == 2))),
    })
    entity = F.transform("good", lambda e: F.struct(e["text"].alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end"), e["category"].alias("category")))
    keep = [c for c in records.columns if c not in ("entities", "source")]
    good = r.where("not empty and size(good) > 0").select(*keep, entity.alias("entities"), F.lit("synthetic").alias("source"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    stats = r.agg(one(F.col("empty")).alias("empty_record"), one(F.col("invalid")).alias("invalid_category"), one(F.col("lost")).alias("span_not_found"), one(~F.col("empty") & (F.size("good") == 0)).alias("no_valid_entity"))
    return good, stats


def answer_listed(rows: DataFrame) -> DataFrame:
    """rows with listed: whether the answer is among the options."""
    return rows.withColumn("listed", F.coalesce(F.array_contains("options", F.col("answer")), F.lit(False)))


def pruned(rows: DataFrame) -> DataFrame:
    return answer_listed(rows).where("listed").drop("listed")


def gaps(found: DataFrame, leaves: DataFrame, below: int = 0, parents: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """(category, parent, n) of leaves that are absent or have fewer than below rows; rows of done, a run to resume, count too."""
    have = found.select("category") if done is None else found.select("category").union(done.select("category"))
    g = per_leaf(have, leaves).where((F.col("n") == 0) | (F.col("n") < below))
    return g.where(F.col("parent").isin(parents)) if parents else g


def batches(leaves_needed: DataFrame, taxonomy: Taxonomy, most: int = 8) -> DataFrame:
    """(parent_ord, batch, parent, leaves): the leaves of each parent in its order, at most so many in a batch."""
    rows = [(i, p, j, t) for i, (p, ts) in enumerate(taxonomy.third.items()) for j, t in enumerate(ts)]
    order = F.broadcast(leaves_needed.sparkSession.createDataFrame(rows, "parent_ord int, parent string, ord int, category string"))
    need = leaves_needed.select("category").distinct().join(order, "category")
    n = F.row_number().over(Window.partitionBy("parent_ord").orderBy("ord")) - 1
    b = need.withColumn("batch", F.floor(n / most).cast("int"))
    return b.groupBy("parent_ord", "batch", "parent").agg(F.array_sort(F.collect_list(F.struct("ord", "category"))).alias("l")).select("parent_ord", "batch", "parent", F.col("l.category").alias("leaves"))


def generation_prompt(rows: DataFrame, per_category: int, instructions: str, hints: dict[str, str] | None = None) -> DataFrame:
    """rows (parent, leaves) with prompt: a heading, a line for each leaf with its hint, then instructions.

    {parent}, {per_category} and {total} in the instructions are filled in; both come from the caller, as does the model's language.
    """
    given = hints or {}
    table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,string>")
    line = F.transform("leaves", lambda x: F.concat(F.lit('- "'), x, F.lit('"'), F.coalesce(F.concat(F.lit(": "), F.nullif(table[x], F.lit(""))), F.lit(""))))
    body = F.replace(F.lit(instructions), F.lit("{parent}"), F.col("parent"))
    body = F.replace(F.replace(body, F.lit("{per_category}"), F.lit(str(per_category))), F.lit("{total}"), (F.size("leaves") * per_category).cast("string"))
    return rows.withColumn("prompt", F.concat(F.array_join(line, "\n"), F.lit("\n\n"), body))


def accepted_synonyms(asked: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, failed) of replies (category, synonym) to the names asked: a reply must be for one of them, not empty and another word."""
    from tagforge.functions.text import synonym_form

    r = replies.withColumn("synonym", synonym_form(F.col("synonym"))).join(F.broadcast(asked.select("category").distinct()), "category", "left_semi")
    good = r.where((F.col("synonym") != "") & (F.col("synonym") != synonym_form(F.col("category"))))
    return good, asked.join(good, "category", "left_anti")
