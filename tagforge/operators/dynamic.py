"""Rewrites of option-list sets. Each stage measures its own input and picks its chances from that.

Rows: row_id, prompt, answer (and options, which are read from the prompt). Chance comes from hashes of
seed, row and slot, so results do not depend on partitioning. The metrics and the frequencies are one
row each and are joined as a broadcast; nothing is collected. A stage reads its rows two or three times, so give it a
table, not a long plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagforge.functions import rng
from tagforge.functions import text as T
from tagforge.operators import metrics
from tagforge.operators.stored import written
from tagforge.operators.taxonomy import Taxonomy, lookup, synonym_map

SEED = 42

#: So many different pairs of prompt and answer at most are worked out apart from the rows.
PAIRS = 50_000


def _with(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a one-row table."""
    return rows.join(F.broadcast(one))


def _known(rows: DataFrame, *keys: str, one: DataFrame | None = None, **columns: Column) -> DataFrame:
    """rows with columns that depend on their keys, and a one-row table, alone: where many rows share keys, they are worked out once for each and looked up."""
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()["n"]
    if n > PAIRS:
        return (rows if one is None else _with(rows, one)).select(*rows.columns, *[c.alias(k) for k, c in columns.items()])
    few = rows.select(*keys).distinct()
    few = (few if one is None else _with(few, one)).select(*[F.col(k).alias(f"_{k}") for k in keys], *[c.alias(k) for k, c in columns.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(few), same).drop(*[f"_{k}" for k in keys])


def special(o: Column) -> Column:
    return o.startswith("miscellaneous") | o.startswith("other")


def merge(rows: DataFrame, taxonomy: Taxonomy, seed: int = SEED) -> DataFrame:
    """Stage 1: of three rows the first two become one, which asks with finer options for the second's answer.

    Threes are row_id div 3; a tail of two can merge, one passes.
    """
    m = metrics.evaluate(rows, taxonomy).select(F.when(F.col(metrics.NAMES[0]) < 0.04, 0.6).otherwise(0.4).alias("p"))
    g = rows.groupBy(F.floor(F.col("row_id") / 3).cast("long").alias("g")).agg(F.array_sort(F.collect_list(F.struct("row_id", "prompt", "answer"))).alias("r"))
    g = _with(g, m).withColumn("hit", (F.size("r") >= 2) & (rng.uniform(seed, F.col("g"), "merge") < F.col("p")))
    one, two = F.col("r")[0], F.get("r", F.lit(1))
    # chances are known now, so that lists are read where they hit alone
    only = lambda c: F.when(F.col("hit"), c)
    parents = {k: v for k, v in taxonomy.parent().items() if k != v}
    parent = lambda c: F.coalesce(lookup(parents, c), c)
    related = taxonomy.related_table(rows.sparkSession)
    g = g.withColumn("second", two["answer"]).join(F.broadcast(related.withColumnRenamed("category", "second")), "second", "left")
    # a name outside the ontology is its own parent, so the first level are its siblings
    g = g.withColumn("related", F.coalesce("related", F.array(*map(F.lit, taxonomy.first))))
    others = F.filter(T.list_options(two["prompt"]), lambda o: o != F.col("second"))
    ranked = F.array_sort(F.transform(others, lambda o: F.struct((~F.array_contains("related", o)).alias("k"), rng.digest(seed, F.col("g"), F.concat(F.lit("type|"), o)).alias("h"), o.alias("o"))))
    # each column is exploded, so that it is there once when the next one looks it up for each of its elements
    put = lambda df, name, c: df.select("*", F.explode(F.array(c)).alias(name))
    g = put(g, "types", only(F.concat(F.array("second"), F.transform(F.slice(ranked, 1, 2), lambda s: s["o"]))))
    g = put(g, "above", only(F.transform("types", parent)))
    kept = F.filter(T.list_options(one["prompt"]), lambda o: ~F.coalesce(F.array_contains("above", o), F.lit(False)))
    g = put(g, "all", only(F.array_distinct(F.concat(kept, "types"))))
    # names above another of the list: those that are above themselves alone have no parent here
    g = put(g, "uppers", only(F.filter(F.transform("all", lambda x: lookup(parents, x)), lambda p: p.isNotNull())))
    g = g.withColumn("new", only(F.array_sort(F.filter("all", lambda o: ~F.array_contains("uppers", o)))))
    merged = F.struct(one["row_id"].alias("row_id"), T.with_options(one["prompt"], F.col("new")).alias("prompt"), F.col("second").alias("answer"))
    out = F.when(F.col("hit"), F.concat(F.array(merged), F.slice("r", 3, F.greatest(F.size("r") - 2, F.lit(0))))).otherwise(F.col("r"))
    return g.select(F.explode(out).alias("x")).select("x.*")


def _frequencies(rows: DataFrame) -> DataFrame:
    """One row: answers' counts as a map and their upper median. There are as many entries as classes."""
    return metrics.histogram(rows).agg(F.map_from_entries(F.collect_list(F.struct("answer", "n"))).alias("freq"), F.array_sort(F.collect_list("n")).alias("ns")).select("freq", F.get("ns", F.floor(F.size("ns") / 2).cast("int")).alias("median"))


def swap_synonyms(rows: DataFrame, taxonomy: Taxonomy, synonyms: dict[str, str] | None = None, seed: int = SEED) -> DataFrame:
    """Stage 2: in some rows options and answers more frequent (or rarer) than the median give way to synonyms."""
    m = metrics.evaluate(rows, taxonomy).select(F.when(F.col(metrics.NAMES[3]) > 2.0, 0.2).otherwise(0.4).alias("p"), (F.col(metrics.NAMES[2]) > 0.6).alias("high"))
    table = synonyms or synonym_map()
    one = _with(m, _frequencies(rows))

    def swap(w: Column) -> Column:
        n = F.coalesce(F.col("freq")[w], F.lit(0))
        due = F.when(F.col("high"), n > F.col("median")).otherwise(n < F.col("median"))
        s = lookup(table, T.fold(w, ascii_only=True))
        return F.when(due & s.isNotNull(), s).otherwise(w)

    # what a hit gives depends on the prompt and the answer alone
    few = _known(rows, "prompt", "answer", one=one, p=F.col("p"), swapped=F.struct(T.with_options(F.col("prompt"), F.transform(T.tail_options(F.col("prompt")), swap)).alias("prompt"), swap(F.col("answer")).alias("answer")))
    hit = rng.uniform(seed, F.col("row_id"), "synonym") <= F.col("p")
    return few.select("row_id", *[F.when(hit, F.col(f"swapped.{c}")).otherwise(F.col(c)).alias(c) for c in ("prompt", "answer")])


def reduce_options(rows: DataFrame, taxonomy: Taxonomy, seed: int = SEED) -> DataFrame:
    """Stage 3: in some rows with more than three options only the answer and a random choice of the others stay."""
    m = metrics.evaluate(rows, taxonomy).select(F.when(F.col(metrics.NAMES[1]) < 0.8, 0.24).otherwise(0.3).alias("p"))
    id_ = F.col("row_id")
    r = _with(_known(rows, "prompt", "answer", o=T.tail_options(F.col("prompt"))), m)
    r = r.withColumn("hit", (F.size("o") > 3) & (rng.uniform(seed, id_, "reduce") < F.col("p")))
    size = F.size("o") + F.when(F.array_contains("o", F.col("answer")), 0).otherwise(1)
    others = F.filter("o", lambda x: x != F.col("answer"))
    r = r.withColumn("take", rng.randint(seed, id_, "keep", 3, size) - 1)
    kept = F.concat(F.array("answer"), F.slice(rng.shuffled(seed, id_, "pick", others), F.lit(1), F.col("take")))
    return r.select("row_id", F.when(F.col("hit"), T.with_options(F.col("prompt"), rng.shuffled(seed, id_, "order", kept))).otherwise(F.col("prompt")).alias("prompt"), "answer")


def special_answers(rows: DataFrame, taxonomy: Taxonomy, seed: int = SEED) -> DataFrame:
    """Stage 4: in some rows the answer becomes the option of miscellaneous or other kind, or 'unknown'; the true one is kept aside.

    Of several such options only the first stays, so frequent or rare makes no difference to the choice.
    """
    m = metrics.evaluate(rows, taxonomy)
    weak = metrics.health(m) < 0.4
    weights = lambda a, b: F.when(weak, a).otherwise(b)
    m = m.select(
        (weights(0.2, 0.3) * F.when(F.col(metrics.NAMES[0]) < 0.03, 0.8).otherwise(1.0)).alias("p"),
        weights(0.1, 0.2).alias("w0"), weights(0.3, 0.5).alias("w1"), weights(0.5, 0.8).alias("w2"),
    )
    id_ = F.col("row_id")
    o = T.tail_options(F.col("prompt"))
    first = F.get(F.filter(o, special), F.lit(0))
    at = F.array_position(F.transform(o, special), True)
    o, new = F.filter(o, lambda x, i: ~special(x) | (i + 1 == at)), F.coalesce(first, F.lit("unknown"))
    more = F.when(F.array_contains(o, new), o).otherwise(F.concat(o, F.array(new)))
    r = _with(_known(rows, "prompt", "answer", enough=F.size(o) >= 3, new=new, o=more), m)
    r = r.withColumn("hit", F.col("enough") & (rng.uniform(seed, id_, "special") < F.col("p")))
    u = rng.uniform(seed, id_, "drop")
    cut = F.when(u < F.col("w0"), 0).when(u < F.col("w1"), 1).when(u < F.col("w2"), 2).otherwise(3)
    r = r.withColumn("cut", F.greatest(F.lit(0), F.least(cut, F.size("o") - 3)))
    gone = F.slice(rng.shuffled(seed, id_, "gone", F.filter("o", lambda x: x != F.col("new"))), F.lit(1), F.col("cut"))
    r = r.select("*", F.explode(F.array(F.when(F.col("hit"), gone))).alias("gone"))
    kept = F.filter("o", lambda x: ~F.array_contains("gone", x))
    return r.select("row_id", F.when(F.col("hit"), T.with_options(F.col("prompt"), rng.shuffled(seed, id_, "order4", kept))).otherwise(F.col("prompt")).alias("prompt"), F.when(F.col("hit"), F.col("new")).otherwise(F.col("answer")).alias("answer"), F.when(F.col("hit"), F.col("answer")).alias("original_answer"))


def pipeline(rows: DataFrame, taxonomy: Taxonomy, seed: int = SEED) -> DataFrame:
    """All stages, one after the other, each over a written table, as it reads its input for its metrics too. An error is raised, never passed over."""
    for stage in (merge, swap_synonyms, reduce_options, special_answers):
        rows = stage(written(rows.select("row_id", "prompt", "answer"), "rewrite"), taxonomy, seed=seed)
    return rows


def random_variant(rows: DataFrame, taxonomy: Taxonomy, synonyms: dict[str, str] | None = None, seed: int = SEED) -> DataFrame:
    """rows (row_id, query, response) each by one of four strategies: parent, synonym, fewer options, a catch-all answer.

    synonyms={} leaves the second without effect. A query without a list stays as it is.
    """
    table = synonym_map() if synonyms is None else synonyms
    leaf = {k.lower(): v.lower() for k, v in taxonomy.leaf_parent().items()}
    id_, old = F.col("row_id"), F.lower(T.strip(F.col("response")))
    listed = T.listed(F.col("query"))
    r = _known(rows, "query", "response", old=old, list=listed, o=F.transform(F.split(listed, ","), lambda x: F.when(~F.coalesce(F.lower(T.strip(x)) == old, F.lit(False)), T.strip(x))))
    r = r.withColumn("s", F.floor(rng.uniform(seed, id_, "strategy") * 4).cast("int") + 1)
    catch = F.when(rng.uniform(seed, id_, "catch") < 0.5, "miscellaneous").otherwise("other")
    swapped = F.coalesce(lookup(table, F.col("old")), F.col("old")) if table else F.col("old")
    r = r.withColumn("new", F.when(F.col("s") == 1, F.coalesce(lookup(leaf, F.col("old")), F.col("old"))).when(F.col("s") == 2, swapped).when(F.col("s") == 4, catch).otherwise(F.col("old")))
    r = r.select(*[c for c in r.columns if c != "o"], F.explode(F.array(F.transform("o", lambda x: F.coalesce(x, F.col("new"))))).alias("o"))
    at = F.array_position("o", F.col("new"))
    rest = F.filter("o", lambda _, i: i + 1 != at)
    take = rng.randint(seed, id_, "fewer", 2, F.size("o") - 1) - 1
    fewer = rng.shuffled(seed, id_, "mix", F.concat(F.array("new"), F.slice(rng.shuffled(seed, id_, "some", rest), F.lit(1), take)))
    r = r.withColumn("o", F.when((F.col("s") == 3) & (F.size("o") > 3) & (at > 0), fewer).otherwise(F.col("o")))
    hit = F.col("list") != ""
    return r.select("row_id", F.when(hit, F.replace("query", F.col("list"), F.array_join("o", ", "))).otherwise(F.col("query")).alias("query"), F.when(hit, F.col("new")).otherwise(F.col("response")).alias("response"))
