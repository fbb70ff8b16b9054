"""Training rows from annotated sentences, and the annotated corpus itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagforge.functions import text as T
from tagforge.operators.taxonomy import Taxonomy

def marked_all(sentence: str, entities: list[str]) -> str:
    """Every occurrence of every entity between ##, longer entities first, none across another."""
    taken, spans = bytearray(len(sentence)), []
    for e in sorted({e for e in entities if e}, key=lambda e: (-len(e), e)):
        at, n = sentence.find(e), len(e)
        while at >= 0:
            # what is taken is as long or longer, so it covers an end of what it meets
            free = not (taken[at] or taken[at + n - 1])
            if free:
                taken[at : at + n] = b"\1" * n
                spans.append((at, at + n))
            at = sentence.find(e, at + n if free else at + 1)
    out, last = [], 0
    for a, b in sorted(spans):
        out += sentence[last:a], "##", sentence[a:b], "##"
        last = b
    return "".join(out) + sentence[last:]


def mark_all(sentence: Column, entities: Column) -> Column:
    """marked_all() in batches: a choice over places that are taken has no equivalent in Spark that is not quadratic."""

    def run(s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else marked_all(x, y) for x, y in zip(s, e, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(sentence, entities)


def mark_each(sentence: Column, entities: Column) -> Column:
    """For each entity the sentence with that one marked, entities being sought left to right, each from the end of the last found.

    An entity that only stands behind the cursor stays unmarked.
    """
    return F.zip_with(entities, places_of(sentence, entities), lambda e, p: mark_at(sentence, e, p))


def mark_at(sentence: Column, entity: Column, place: Column) -> Column:
    """The sentence with the entity at a place (one-based, 0: nowhere) marked."""
    return F.when(place > 0, F.concat(sentence.substr(F.lit(1), place - 1), F.lit("##"), entity, F.lit("##"), sentence.substr(place + F.length(entity), F.length(sentence)))).otherwise(sentence)


def places_of(sentence: Column, entities: Column) -> Column:
    """One-based places of entities that are sought left to right, each from the end of the last found; 0 for one that is not there."""
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("at"))

    def step(s, e):
        # a lambda over one value, so that it is computed once
        after = lambda p: F.struct(F.when(p > 0, p - 1 + F.length(e)).otherwise(s["cursor"]).alias("cursor"), F.concat(s["at"], F.array(p)).alias("at"))
        return F.get(F.transform(F.array(_locate(e, sentence, s["cursor"])), after), F.lit(0))

    return F.aggregate(entities, start, step, lambda s: s["at"])


def _locate(e: Column, sentence: Column, cursor: Column) -> Column:
    """One-based place of e at or after the cursor (zero-based), 0 without one; an empty entity has none."""
    at = F.call_function("locate", e, sentence, cursor + 1)
    return F.when((at > 0) & (F.length(e) > 0), at).otherwise(F.lit(0)).cast("int")


def conversation(prompt: Column, answer: Column) -> Column:
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    return F.array(turn("user", prompt), turn("assistant", answer))


def stage1(base: DataFrame, max_sentences: int | None = None) -> DataFrame:
    """(ord, prompt, answer, conversations): a sentence and itself with all entities marked. base: ord, sentence, mentions."""
    if max_sentences is not None:
        base = base.where(F.col("ord") < max_sentences)
    answer = mark_all(F.col("sentence"), F.col("mentions.entity"))
    return base.select("ord", F.col("sentence").alias("prompt"), answer.alias("answer")).withColumn("conversations", conversation(F.col("prompt"), F.col("answer")))


def stage2(base: DataFrame, taxonomy: Taxonomy, max_sentences: int | None = None, sentences: bool = True) -> DataFrame:
    """(row_id, ord, pos, level, prompt, answer, options): three prompts for each mention, one for each level.

    sentences=False leaves entity and sentence out of prompts whose sentence has no 'list:', for those who only read or rewrite the
    options: these are found by 'list: ', 'in the list:' and the last colon, so such a prompt reads the same without its sentence.
    row_id keeps the order and the threes of a numbering by sentence, mention and level, without a global sort:
    3 * (ord * 2^32 + pos) + level - 1.
    """
    if max_sentences is not None:
        base = base.where(F.col("ord") < max_sentences)
    spark = base.sparkSession
    # places and marked sentences are columns of their own, so that they are left out where only answers are asked for; sentences are
    # marked a mention at a time, as those of all mentions are too much for one row
    told = F.lit(True) if sentences else F.instr("sentence", "list:") > 0
    entities = F.col("mentions.entity")
    places = places_of(F.col("sentence"), entities) if sentences else F.when(told, places_of(F.col("sentence"), entities))
    m = base.select("ord", "mentions", F.when(told, F.col("sentence")).alias("sentence"), places.alias("places"))
    m = m.select("ord", "sentence", "places", F.posexplode("mentions").alias("pos", "m")).select("ord", "pos", "m.entity", "m.category", "sentence", F.get("places", F.col("pos")).alias("place"))
    marked = mark_at(F.col("sentence"), F.col("entity"), F.col("place"))
    shown = [F.col("entity"), marked] if sentences else [F.when(F.col("sentence").isNull(), "").otherwise(F.col("entity")), F.coalesce(marked, F.lit(""))]
    m = m.join(F.broadcast(taxonomy.path_table(spark)), "category", "left")
    path = [F.coalesce(c, F.lit("miscellaneous")) for c in ("l1", "l2", "l3")]
    m = m.select("ord", "pos", shown[0].alias("entity"), shown[1].alias("marked"), F.posexplode(F.array(*path)).alias("k", "answer"))
    o = taxonomy.options_table(spark)
    m = m.join(F.broadcast(o), (o["level"] == m["k"] + 1) & (o["category"] == m["answer"]), "left")
    return m.select(
        ((F.col("ord").cast("long") * (1 << 32) + F.col("pos")) * 3 + F.col("k")).alias("row_id"), "ord", "pos", (F.col("k") + 1).alias("level"),
        T.prompt(F.col("entity"), F.col("marked"), F.col("options")).alias("prompt"), "answer", "options",
    ).withColumn("conversations", conversation(F.col("prompt"), F.col("answer")))


def base_sentences(records: DataFrame, leaves: DataFrame, composed: bool = False) -> DataFrame:
    """records (ord, text, entities of text and category) checked: sentence, mentions and reason.

    reason is null for a sentence of the corpus; else the first entity with a fault decides: `invalid_category` or
    `not_in_text`; `no_entity` without any. Ids keep the numbers of the input.
    """
    known = leaves.select("category").distinct().agg(F.collect_set("category").alias("leaves"))
    r = records.join(F.broadcast(known))
    sentence = T.apostrophes(F.col("text"), composed)
    if not composed:
        # one call for all entity texts of a row
        packed = T.apostrophes(F.array_join(F.transform("entities", lambda e: F.coalesce(e["text"], F.lit(""))), "\x00"))
        r = r.withColumn("entity_texts", F.split(packed, "\x00"))
    else:
        r = r.withColumn("entity_texts", F.transform("entities", lambda e: T.apostrophes(e["text"], True)))
    r = r.withColumn("sentence", sentence)
    r = r.withColumn("mentions", F.zip_with("entity_texts", "entities", lambda t, e: F.struct(T.strip(t).alias("entity"), T.strip(e["category"]).alias("category"))))
    r = r.withColumn("mentions", F.slice("mentions", 1, F.greatest(F.size("entities"), F.lit(0))))
    fault = F.transform("mentions", lambda m: F.when(~F.array_contains("leaves", m["category"]), "invalid_category").when(F.instr(F.col("sentence"), m["entity"]) == 0, "not_in_text"))
    reason = F.when(F.coalesce(F.size("entities"), F.lit(0)) <= 0, "no_entity").otherwise(F.get(F.filter(fault, lambda x: x.isNotNull()), F.lit(0)))
    return r.select("ord", F.concat(F.lit("sentence"), (F.col("ord") + 1).cast("string")).alias("sentence_id"), "sentence", "mentions", F.explode(F.array(reason)).alias("reason"))  # exploded, as a filter on it would compute it twice


def normalised_rows(rows: DataFrame) -> DataFrame:
    """(query, response) of rows in any of three shapes; of several turns of a role the last counts; rows lacking one are left out."""
    cols = set(rows.columns)

    def part(flat: str, role: str) -> Column:
        tries = [F.col(flat)] if flat in cols else []
        if "messages" in cols:
            tries.append(F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(-1)).getField("content"))
        if "conversations" in cols:
            tries.append(F.try_element_at(F.filter("conversations", lambda m: m["from"] == role), F.lit(-1)).getField("value"))
        return F.coalesce(*tries) if tries else F.lit(None).cast("string")

    return rows.withColumn("query", part("query", "user")).withColumn("response", part("response", "assistant")).where("query <> '' and response <> ''")
