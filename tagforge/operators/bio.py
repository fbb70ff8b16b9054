"""Token tags: spans to BIO, BIO to spans, and runs of plain tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagforge.functions.text import tag_name, tokens

# Labels of a public multilingual corpus and the ontology's leaves that they mean.
LABEL_LEAVES = {
    "ARTIST": "artist", "ATHLETE": "athlete", "CLERIC": "other person", "POLITICIAN": "politician", "SCIENTIST": "scholar", "SPORTSMANAGER": "other person", "OTHERPER": "other person",
    "FACILITY": "other facility", "HUMANSETTLEMENT": "city", "STATION": "other transportation facility", "OTHERLOC": "other geographical entity",
    "AEROSPACEMANUFACTURER": "other commercial organization", "CARMANUFACTURER": "other commercial organization", "MUSICALGRP": "band", "ORG": "other non-commercial organization", "PRIVATECORP": "company", "PUBLICCORP": "company", "OTHERCORP": "company", "TECHCORP": "company", "SPORTSGRP": "sports team/league",
    "CLOTHING": "clothes", "DRINK": "beverages", "FOOD": "other food", "VEHICLE": "other vehicle", "OTHERPROD": "other product",
    "ARTWORK": "other visual art", "MUSICALWORK": "song", "SOFTWARE": "software", "VISUALWORK": "film", "WRITTENWORK": "fiction", "OTHERCW": "other art",
    "ANATOMICALSTRUCTURE": "other biological entity", "DISEASE": "disease", "MEDICALPROCEDURE": "other medical entity", "MEDICATION/VACCINE": "medication", "SYMPTOM": "symptom",
}


def first_match(text: Column, part: Column) -> Column:
    """Zero-based place of the first run of text (array) that equals part, -1 without one."""
    last = F.size(text) - F.size(part)
    places = F.when((last >= 0) & (F.size(part) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hit = F.filter(places, lambda i: (F.get(text, i) == F.get(part, F.lit(0))) & (F.slice(text, i + 1, F.size(part)) == part))
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(-1))


def encode(base: DataFrame, split: callable = tokens) -> DataFrame:
    """base with tokens and tags. Mentions (entity, category) are laid in order at their first match, later over earlier.

    split: tokens() for words, characters() for languages without spaces. Mentions without tokens are left out.
    """
    # exploded arrays of one struct: each is then computed once for a row, not once for each element that looks it up
    row = lambda df, **cols: df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_x")).select(*df.columns, "_x.*")
    last = F.reverse(F.filter("mentions", lambda m: m["entity"].isNotNull()))
    got = row(base, tokens=split(F.col("sentence")), _last=last, _of=F.transform(last, lambda m: m["entity"]))
    # equal entities lie on the same tokens, so the last of them counts; then the first in this order is on top
    got = row(got, _parts=F.transform(F.array_distinct("_of"), lambda e: F.struct(split(e).alias("part"), tag_name(F.get(F.col("_last"), (F.array_position("_of", e) - 1).cast("int"))["category"]).alias("tag"))))
    at = lambda p: F.when(F.size(p) == 1, F.array_position("tokens", p[0]).cast("int") - 1).otherwise(first_match(F.col("tokens"), p))
    placed = F.filter(F.transform("_parts", lambda p: F.struct(at(p["part"]).alias("at"), F.size(p["part"]).alias("n"), p["tag"].alias("tag"))), lambda p: (p["at"] >= 0) & (p["n"] > 0))
    got = row(got, _placed=placed)
    over = F.flatten(F.transform("_placed", lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1)))
    tags = F.flatten(F.transform("_placed", lambda p: F.transform(F.sequence(F.lit(1), p["n"]), lambda k: F.concat(F.when(k == 1, "B-").otherwise("I-"), p["tag"]))))
    got = row(got, _over=over, _tags=F.concat(F.array(F.lit("O")), tags))
    return got.select(*base.columns, "tokens", F.transform("tokens", lambda _, i: F.get("_tags", F.array_position("_over", i).cast("int"))).alias("tags"))


def token_rows(tagged: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, token, tag), a row for each token."""
    return tagged.select(*keys, F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "t")).select(*keys, "pos", F.col("t.tokens").alias("token"), F.col("t.tags").alias("tag"))


def to_lines(tagged: DataFrame) -> DataFrame:
    """A text block for each sentence: 'token tag' lines and a blank line."""
    return tagged.select(F.concat(F.array_join(F.zip_with("tokens", "tags", lambda a, b: F.concat(a, F.lit(" "), b)), "\n"), F.lit("\n")).alias("value"))


def tag_names(tags: Column, table: list[str]) -> Column:
    """Names of integer tags."""
    return F.transform(tags, lambda t: F.get(F.array(*map(F.lit, table)), t))


def decode(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, entity, category, start) of BIO rows (keys, pos, token, tag).

    O or '' ends a span, other tags without B- or I- are passed over, an I- of another category begins a span.
    """
    known = rows.where("tag in ('O', '') or tag like 'B-%' or tag like 'I-%'")
    order = Window.partitionBy(*keys).orderBy("pos")
    kind, category = F.substring("tag", 1, 1), F.when(F.col("tag").isin("O", ""), None).otherwise(F.substring("tag", 3, 1 << 20))
    r = known.withColumn("category", category).withColumn("starts", (kind == "B") | ~F.col("category").eqNullSafe(F.lag("category").over(order)))
    r = r.withColumn("span", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = r.where("category is not null").groupBy(*keys, "span", "category").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return spans.where("category <> ''").select(*keys, F.array_join(F.col("t.token"), " ").alias("entity"), "category", F.col("t.pos")[0].alias("start"))


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once for a row, however often lambdas look into it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _runs(items: Column, starts: Column) -> Column:
    """Slices of items, each from one of the starts (zero-based, in order) to the next."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(items, a + 1, b - a))


def decode_arrays(tagged: DataFrame, *keys: str) -> DataFrame:
    """decode() of rows with arrays of tokens and tags: nothing is sorted or moved."""
    t = F.filter(F.arrays_zip("tokens", "tags", F.sequence(F.lit(0), F.size("tokens") - 1).alias("pos")), lambda x: x["tags"].isin("O", "") | x["tags"].startswith("B-") | x["tags"].startswith("I-"))
    t = F.transform(t, lambda x: F.struct(x["pos"].alias("pos"), x["tokens"].alias("token"), F.substring(x["tags"], 1, 1).alias("kind"), F.when(~x["tags"].isin("O", ""), F.substring(x["tags"], 3, 1 << 20)).alias("category")))
    r = _once(tagged.where(F.size("tokens") > 0).select(*keys, "tokens", "tags"), "_t", t)
    before = lambda i: F.get("_t", i - 1)["category"]
    starts = F.filter(F.transform("_t", lambda x, i: F.when((i == 0) | (x["kind"] == "B") | ~x["category"].eqNullSafe(before(i)), i)), lambda i: i.isNotNull())
    r = _once(r, "_s", starts)
    spans = r.select(*keys, F.explode(_runs(F.col("_t"), F.col("_s"))).alias("t"))
    spans = spans.select(*keys, F.array_join(F.col("t.token"), " ").alias("entity"), F.col("t")[0]["category"].alias("category"), F.col("t")[0]["pos"].alias("start"))
    return spans.where("category <> ''")


def to_leaves(spans: DataFrame, valid: DataFrame, table: dict[str, str] = LABEL_LEAVES) -> DataFrame:
    """spans with leaf and problem: `unmapped` labels, or mapped ones that are `invalid`."""
    key = F.upper("category")
    leaf = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    marked = valid.select(F.col("category").alias("leaf"), F.lit(True).alias("ok")).distinct()
    got = spans.withColumn("leaf", leaf).join(F.broadcast(marked), "leaf", "left")
    return got.withColumn("problem", F.when(F.col("leaf").isNull(), "unmapped").when(F.col("ok").isNull(), "invalid")).drop("ok")


def convert(rows: DataFrame, valid: DataFrame, key: str = "sentence_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, labels without leaf with counts, counts of sentences) of token rows; sentences without a valid span are left out."""
    spans = to_leaves(decode(rows, key), valid)
    good = spans.where("problem is null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "entity", "leaf"))).alias("e"))
    text = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "token"))).getField("token"), " ").alias("text"))
    entity = F.transform("e", lambda e: F.struct(e["entity"].alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end"), e["leaf"].alias("category")))
    records = text.join(good, key).select(key, "text", entity.alias("entities"))
    lost = spans.where("problem = 'unmapped'").groupBy(F.upper("category").alias("label")).count()
    counts = text.join(good, key, "left").agg(F.count("e").alias("converted"), F.sum(F.col("e").isNull().cast("int")).alias("skipped"))
    return records, lost, counts


def decode_plain(lines: DataFrame, keep_unterminated: bool = True) -> DataFrame:
    """(sentence, text, entities) of a column file (file, line_no, value): first field the token, last the tag, blank lines end sentences.

    Neighbours of one tag are one entity. Lines of one field are passed over. keep_unterminated=False leaves out a last
    sentence without a blank line after it.
    """
    fields = F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x != "")
    order = Window.partitionBy("file").orderBy("line_no")
    r = lines.withColumn("f", fields).withColumn("blank", (F.size("f") == 0).cast("int"))
    r = r.withColumn("sentence", F.sum("blank").over(order) - F.col("blank")).withColumn("ended", F.max("blank").over(Window.partitionBy("file", "sentence")))
    if not keep_unterminated:
        r = r.where("ended = 1")
    r = r.where(F.size("f") >= 2).select("file", "sentence", "line_no", F.col("f")[0].alias("token"), F.element_at("f", -1).alias("tag"))
    inner = Window.partitionBy("file", "sentence").orderBy("line_no")
    r = r.withColumn("run", F.sum((~F.col("tag").eqNullSafe(F.lag("tag").over(inner))).cast("int")).over(inner))
    words = r.groupBy("file", "sentence", "run", "tag").agg(F.array_sort(F.collect_list(F.struct("line_no", "token"))).alias("t"))
    whole = words.groupBy("file", "sentence").agg(
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "t"))), lambda s: s["t"]["token"])), " ").alias("text"),
        F.array_sort(F.collect_set(F.when(F.col("tag") != "O", F.array_join(F.col("t.token"), " ")))).alias("entities"),
    )
    return whole.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("sentence")))


def decode_plain_arrays(files: DataFrame, keep_unterminated: bool = True) -> DataFrame:
    """decode_plain() of files whose lines are an array (file, lines): nothing is sorted or moved."""
    f = _once(files.select("file", "lines"), "_f", F.transform("lines", lambda v: F.filter(F.split(F.trim(F.regexp_replace(v, r"\s+", " ")), " "), lambda x: x != "")))
    blank = F.filter(F.transform("_f", lambda x, i: F.when(F.size(x) == 0, i)), lambda i: i.isNotNull())
    f = _once(f, "_starts", F.concat(F.array(F.lit(0)), F.transform(blank, lambda i: i + 1)))
    parts = F.transform(_runs(F.col("_f"), F.col("_starts")), lambda p: F.filter(p, lambda x: F.size(x) >= 2))
    parts = parts if keep_unterminated else F.slice(parts, F.lit(1), F.size("_starts") - 1)
    s = f.select("file", F.posexplode(F.filter(parts, lambda p: F.size(p) > 0)).alias("n", "p"))
    tags = F.transform("p", lambda x: F.element_at(x, -1))
    s = _once(_once(s, "tags", tags), "tokens", F.transform("p", lambda x: x[0]))
    starts = F.filter(F.transform("tags", lambda g, i: F.when((i == 0) | (g != F.get("tags", i - 1)), i)), lambda i: i.isNotNull())
    s = _once(s, "_s", starts)
    runs = F.filter(F.transform(_runs(F.arrays_zip("tokens", "tags"), F.col("_s")), lambda x: F.when(x[0]["tags"] != "O", F.array_join(x["tokens"], " "))), lambda x: x.isNotNull())
    return s.select("file", F.array_join("tokens", " ").alias("text"), F.array_sort(F.array_distinct(runs)).alias("entities"), (F.col("n") + 1).alias("idx"))
