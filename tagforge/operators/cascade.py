"""Three-level classification, level by level over all entities of all sentences.

A classifier is a function of a DataFrame: it gets rows with the columns asks and prompt and adds a column reply, null where asks
is false. A model's goes through mapInPandas with one load for each worker process (see `batched`); `by_table` answers from a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagforge.functions.text import question
from tagforge.operators.stored import written
from tagforge.operators.taxonomy import Taxonomy

Classifier = Callable[[DataFrame], DataFrame]


def by_table(replies: DataFrame) -> Classifier:
    """Replies by (key, level); other prompts get 'unknown'."""
    return lambda rows: rows.join(replies.select("key", "level", F.col("reply").alias("r")), ["key", "level"], "left").withColumn("reply", F.when(F.col("asks"), F.coalesce("r", F.lit("unknown")))).drop("r")


class Wide:
    """by_table() of (key, replies), an array with a reply for each level: joined once, before the first level, and not at each."""

    def __init__(self, replies: DataFrame):
        self.replies = replies

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.replies.select("key", F.col("replies").alias("_replies")), "key", "left")

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("reply", F.when(F.col("asks"), F.coalesce(F.get("_replies", F.col("level") - 1), F.lit("unknown"))))


def batched(load: Callable[[], Callable[[list[str]], list[str]]], size: int = 32) -> Classifier:
    """A model that load() gives, once for each worker process, asked in batches of prompts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in it:
            prompts = part.loc[part["asks"], "prompt"].tolist()
            replies = iter([r for i in range(0, len(prompts), size) for r in model(prompts[i : i + size])])
            yield part.assign(reply=[next(replies) if a else None for a in part["asks"].tolist()])

    def classify(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", reply string")

    return classify


def classify(entities: DataFrame, taxonomy: Taxonomy, classifier: Classifier, zero_shot: bool = True) -> DataFrame:
    """entities (id, pos, entity, sentence) with category.

    Each level offers the options below the last answer. 'unknown' ends an entity's walk. An answer that is not offered fails the
    sentence, so does a second level without options; without third-level options the second answer stays. All entities of a
    failed sentence are 'unknown'. All rows pass each level once, asked or not, so the plan grows with the levels and no faster.
    """
    choices = taxonomy.choices_table(entities.sparkSession)
    order = {1: taxonomy.first, 2: taxonomy.second, 3: taxonomy.third}
    lists = [(1, "", list(taxonomy.first))] + [(k, p.lower(), o) for k in (2, 3) for p, o in order[k].items()]
    offered = entities.sparkSession.createDataFrame(lists, "level int, parent_key string, options array<string>")
    depth = 1 if not taxonomy.second else 2 if not taxonomy.third else 3
    key = F.concat_ws("|", F.col("id").cast("string"), F.col("pos").cast("string"))
    state = entities.withColumn("key", key)
    state = classifier.prepare(state) if hasattr(classifier, "prepare") else state
    own = [c for c in state.columns if c != "key"]
    state = state.withColumns({"category": F.lit(""), "open": F.lit(True), "failed": F.lit(False)})
    for level in range(1, depth + 1):
        o = F.broadcast(offered.where(F.col("level") == level).select(F.col("parent_key").alias("p"), "options"))
        s = state.join(o, F.lower("category") == F.col("p"), "left").drop("p")
        asks = F.col("open") & F.col("options").isNotNull()
        s = s.withColumn("asks", asks).withColumn("failed", F.col("failed") | (F.col("open") & F.col("options").isNull() & F.lit(level == 2)))
        s = s.withColumn("prompt", question(F.col("entity"), F.col("sentence"), F.col("options"), zero_shot)).withColumn("level", F.lit(level))
        r = classifier(s).withColumn("reply", F.lower("reply"))
        c = F.broadcast(choices.where(F.col("level") == level).select(F.col("parent_key").alias("p"), F.col("answer_key").alias("a"), "option"))
        r = r.join(c, (F.lower("category") == F.col("p")) & (F.col("reply") == F.col("a")), "left")
        unknown = F.trim("reply") == "unknown"
        asks, unknown, missed = F.col("asks"), F.coalesce(unknown, F.lit(False)), F.col("option").isNull()
        state = r.select(
            *own, F.when(asks & unknown, "unknown").when(asks, F.coalesce("option", "category")).otherwise(F.col("category")).alias("category"),
            F.when(asks, ~unknown & ~missed).otherwise(F.col("open")).alias("open"), (F.col("failed") | (asks & ~unknown & missed)).alias("failed"), "key",
        )
    bad = F.max("failed").over(Window.partitionBy("id"))
    return state.select(*entities.columns, F.when(bad, "unknown").otherwise(F.col("category")).alias("category"))


def predictions(classified: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(id, sentence, entity, category): the parallel lists of each sentence, in order of pos. Rows without the sentence are put together by id."""
    keys = [c for c in ("id", "sentence") if c in classified.columns]
    g = classified.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "entity", "category"))).alias("m"))
    return g.select(*keys, F.col("m.entity").alias("entity"), F.col("m.category").alias("category"))


def named(queries: DataFrame, reference: DataFrame, limit: int | None = None) -> DataFrame:
    """queries with id: the reference's (its last row of a sentence counts), else sentence1, sentence2, ... in order of the query.

    The unmapped are numbered over range partitions: a partition's rows are counted, so no task sees all of them.
    """
    ids = reference.groupBy("sentence").agg(F.max_by("id", "ord").alias("id"))
    q = written(queries.join(ids, queries["query"] == ids["sentence"], "left").drop("sentence"), "named")  # it is read three times
    from tagforge.operators.numbering import numbered

    free = numbered(q.where("id is null").drop("id"), "query").withColumn("id", F.concat(F.lit("sentence"), (F.col("n") + 1).cast("string"))).drop("n")
    out = q.where("id is not null").select(*free.columns).unionByName(free)
    return out.orderBy("query").limit(limit) if limit is not None else out
