"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of a token budget, stopped at `most` times its size, the
excess reshared by weight until no source is above. A source whose target is e epochs and a rest takes
every document e times first; the rest is a weighted sample without replacement: each document gets the
exponential key -ln(u)/quality, keys are sorted within the source and sizes prefix-summed up to the
rest. The document at which the budget ends gives only the words that are left of it.

The sort is spread: keys fall into bins of a source, bins are summed (map-side combined), and only the
bin in which the budget ends is sorted by itself. A source with a third of all rows has as many bins as
its rows ask for.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in
the order; a null quality counts as 1; sources of size 0 have target 0; u is a hash of
seed and doc_id, so reruns agree, and equal keys go by doc_id, then size; rows repeated under one
doc_id are separate documents with one key; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, row_key, table, written

SPACE = " \t\n\x0b\x0c\r"
SEED = 42
#: Bins of a source: one for about so many of its documents.
IN_BIN = 2000
CYCLE = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+: what is left of 'x' for each run, once white space is deleted."""
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(ones, SPACE, "")).cast("long")


def targets(sources: DataFrame, share: float, most: float, cycle=CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, source_size). A source has one row here, so windows over all are over few rows."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*map(F.lit, cycle))
    s = sources.withColumn("w", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))))
    # Water level: sources are full in the order of most * size / weight. The k-th is full if the level
    # that the budget left by those before it gives would lift it to its limit.
    by = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("left", F.col("total") * F.lit(share) - F.col("full") * F.lit(most))
    s = s.withColumn("stops", F.col("left") * F.col("w") >= F.col("source_size") * F.lit(most) * F.col("open"))
    # The first that does not stop sets the level of all after it.
    s = s.withColumn("first", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "left", "open"))).over(Window.partitionBy()))
    level = F.col("first.left") * F.col("w") / F.col("first.open")
    return s.select("source", "source_size", F.when(F.col("stops"), F.col("source_size") * F.lit(most)).otherwise(level).cast("double").alias("target"))


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and key."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = SEED, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns in keep) of every document.

    quality: (doc_id, weight > 0), at most one row for a doc_id.
    """
    rows = docs.select("doc_id", "source", n_words(F.col(text_col)).alias("size"), *keep)
    if quality is not None:
        rows = rows.join(quality, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = written(rows, "mix")  # sizes are counted once
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = targets(sums.select("source", "source_size"), share, most)
    plan = goal.join(sums.drop("source_size"), goal["source"].eqNullSafe(sums["source"])).select(
        goal["source"].alias("src"), "source_size", "target",
        F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(int(most))).cast("long").alias("epochs"),
        F.ceil(F.col("docs") / IN_BIN).cast("long").alias("bins"),
    ).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    plan = written(plan, "mix-plan")
    few = plan.count() <= BROADCAST_ROWS  # a row for each source; many sources are joined by shuffle
    side = lambda t: F.broadcast(t) if few else t
    r = rows.join(side(plan), rows["source"].eqNullSafe(plan["src"])).drop("src")
    key = -F.log(uniform(seed, F.col("doc_id"))) / F.coalesce("weight", F.lit(1.0))
    # exp(-key) falls evenly into bins for weight 1 and keeps the order of keys
    r = r.withColumn("key", key).withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * F.col("bins")).cast("long"))
    per_bin = r.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("rest").alias("budget"))
    run = Window.partitionBy("source").orderBy("bin")
    per_bin = per_bin.withColumn("before", F.sum("in_bin").over(run) - F.col("in_bin"))
    edges = per_bin.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("in_bin") > F.col("budget"))).select(F.col("source").alias("s"), F.col("bin").alias("edge"), "before")
    r = r.join(side(edges), r["source"].eqNullSafe(edges["s"]), "left").drop("s")
    inner = r.where((F.col("bin") == F.col("edge")) & (F.col("rest") > 0))
    order = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size")
    inner = inner.withColumn("at", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inner = inner.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at"))))
    outer = r.where(~F.coalesce((F.col("bin") == F.col("edge")) & (F.col("rest") > 0), F.lit(False)))
    # without an edge bin, the rest is 0 or the whole source
    outer = outer.withColumn("part", F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), F.col("size")).otherwise(F.lit(0)))
    out = ["doc_id", *keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return inner.select(*out).union(outer.select(*out))


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, **how) -> DataFrame:
    """The mix itself: the rows of docs, all their columns, each as often as it is taken; where a budget ends, the text's leading words."""
    i, h = row_key()
    got = mix(docs.select(i.alias("doc_id"), "source", "text", h, F.col("source").alias("of")), quality, keep=("h", "of"), **how)
    # rows of one doc_id, text and source share their decisions: each takes least, and together they take extra more, step by step
    got = got.where("taken > 0 or size > 0").groupBy("doc_id", "h", "of").agg(F.first("size").alias("size"), F.count("*").alias("n"), F.sum("taken").alias("sum"), F.min("taken").alias("least"), F.max("taken").alias("most"))
    got = got.where("sum > 0").select(F.col("doc_id").alias("gi"), F.col("h").alias("gh"), F.col("of").alias("gs"), "size", "least", (F.col("most") - F.col("least")).alias("step"), (F.col("sum") - F.col("n") * F.col("least")).alias("extra"))
    got = written(got, "taken")
    rows = docs.select(i, h, F.col("source").alias("s"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(got.hint("merge"), rows["i"].eqNullSafe(got["gi"]) & (rows["h"] == got["gh"]) & rows["s"].eqNullSafe(got["gs"]))
    # only equal rows at which a source's budget ends are told apart, one group of each source at most
    number = F.row_number().over(Window.partitionBy("gi", "gh", "gs").orderBy("h")) - 1
    ends = rows.where("extra > 0").withColumn("taken", F.col("least") + F.greatest(F.lit(0), F.least("step", F.col("extra") - number * F.col("step"))))
    rows = rows.where("extra = 0").withColumn("taken", F.col("least")).unionByName(ends).where("taken > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))).alias("copy")
    rows = rows.select("row", "size", "taken", copy).withColumn("words", F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), 1, F.col("words").cast("int")), " ")
    rows = rows.withColumn("part", F.when(F.col("words") < F.col("size"), cut))
    new = {"text": F.coalesce("part", "row.text"), "n_chars": F.when(F.col("part").isNotNull(), F.length("part")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns])


def label_quality(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(doc_id, weight) of labelled documents; the best of several labels holds, null labels give none."""
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.when(F.col("q") > 0, good).otherwise(bad).alias("weight"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_quality(table(spark, sf_dir, "labels")))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM labels
      WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
        row_number() OVER o AS rn
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
g AS (SELECT *, total::DOUBLE * 1.5::DOUBLE - full_::DOUBLE * 2.0::DOUBLE AS left_ FROM f),
h AS (SELECT *, left_ * w >= source_size::DOUBLE * 2.0::DOUBLE * open_ AS stops FROM g),
t AS (SELECT source, source_size, CASE WHEN stops THEN source_size::DOUBLE * 2.0::DOUBLE
        ELSE (SELECT arg_min(left_, rn) FROM h WHERE NOT stops) * w / (SELECT arg_min(open_, rn) FROM h WHERE NOT stops) END::DOUBLE AS target FROM h),
p AS (SELECT d.doc_id, size, source_size, target, t.source,
        least(floor(target / greatest(source_size, 1)), 2)::BIGINT AS epochs,
        -ln((('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.doc_id = q.doc_id),
a AS (SELECT *, floor(target)::BIGINT - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS pos FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - pos)))::BIGINT AS taken FROM a
"""
