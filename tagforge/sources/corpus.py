"""Readers and writers of the corpus formats. Bad rows are kept apart and can be counted, never lost silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "array<struct<text:string,start:int,end:int,category:string>>"
RECORD = f"text string, entities {ENTITY}, source string"
TURNS = "conversations array<struct<`from`:string,value:string>>"
SHAPES = f"query string, response string, messages array<struct<role:string,content:string>>, {TURNS}"


def resolve(spark: SparkSession, base: str) -> str:
    """base with .jsonl or .json, whichever exists (through Spark's file systems)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stem = base.rsplit(".", 1)[0] if "." in base.rsplit("/", 1)[-1] else base
    for end in (".jsonl", ".json"):
        path = jvm.org.apache.hadoop.fs.Path(stem + end)
        if path.getFileSystem(conf).exists(path):
            return stem + end
    raise FileNotFoundError(f"neither {stem}.jsonl nor {stem}.json")


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, file_ord, line_no, value): line_no follows the place in the file, without gaps being promised."""
    order = {p: i for i, p in enumerate(paths)}
    parts = [spark.read.text(p).select(F.col("_metadata.file_path").alias("file"), F.lit(i).alias("file_ord"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"), "value") for p, i in order.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("line_no", F.row_number().over(Window.partitionBy("file_ord", "file").orderBy("at"))).drop("at")


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of an array of objects or of lines, told apart by the first character; blank lines do not count."""
    head = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").head()
    kind = T._parse_datatype_string(schema)
    if head and head["v"].startswith("["):
        # elements as texts first, so that one of another shape is a bad row by itself; text that is no array at all is one bad row
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("r"), "value")
        raw = whole.select(F.explode(F.coalesce("r", F.array("value"))).alias("value")).where("value is not null")
    else:
        raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.withColumn("r", F.from_json("value", kind.add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad is null").select(*[F.col(f"r.`{f.name}`") for f in kind.fields if f.name != "_bad"]), parsed.where("r._bad is not null").select("value")


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Annotated records of several files, one after the other."""
    out = None
    for i, p in enumerate(paths):
        part = read_json(spark, p, RECORD)[0].withColumn("file_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence_id, ord, sentence, mentions) of objects keyed by sentence; lists are cut to the shorter."""
    kind = "map<string,struct<sentence:string,entity:array<string>,category:array<string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", kind).alias("m"))
    rows = raw.select("file", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("file", F.col("e.key").alias("sentence_id"), "ord", F.col("e.value").alias("v"))
    n = F.greatest(F.least(F.size("v.entity"), F.size("v.category")), F.lit(0))
    zip_ = F.arrays_zip(F.slice("v.entity", F.lit(1), n).alias("entity"), F.slice("v.category", F.lit(1), n).alias("category"))
    return rows.select("file", "sentence_id", "ord", F.col("v.sentence").alias("sentence"), zip_.alias("mentions"))


def read_categories(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, category) of record files (.jsonl) and keyed objects (.json); others are an error."""
    out = None
    for p in paths:
        if p.endswith(".jsonl"):
            part = read_json(spark, p, RECORD)[0].select(F.lit(p).alias("file"), F.explode("entities.category").alias("category"))
        elif p.endswith(".json"):
            part = read_base(spark, p).select(F.lit(p).alias("file"), F.explode("mentions.category").alias("category"))
        else:
            raise ValueError(f"unknown format: {p}")
        out = part if out is None else out.union(part)
    return out


def read_responses(spark: SparkSession, folder: str, names: str = "*.jsonl") -> DataFrame:
    """(query, ord, response) of every .jsonl in a folder, in order of file and line; fields by any of their names, '' counting as missing, and rows lacking one left out."""
    raw = lines(spark, f"{folder}/{names}")
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{n}"), F.lit("")) for n in names])
    r = raw.select(get("query", "prompt", "input").alias("query"), get("response", "output", "text").alias("response"), F.struct("file", "line_no").alias("ord"))
    return r.where("query is not null and response is not null")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    rows.write.mode(mode).option("ignoreNullFields", "true").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def write_base(rows: DataFrame, path: str) -> None:
    """Keyed rows as lines, one object a sentence: a single object of a whole corpus would go through one task."""
    rows.select(F.to_json(F.create_map("sentence_id", F.struct("sentence", F.col("mentions.entity").alias("entity"), F.col("mentions.category").alias("category")))).alias("value")).write.mode("overwrite").text(path)


def write_audit(sample: DataFrame, path: str) -> None:
    """The sheet for annotators: numbered rows with two blank columns."""
    sample.select("id", "split", "sentence", "entity", F.col("category").alias("category_llm"), F.lit("").alias("corretto (S/N)"), F.lit("").alias("note")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_bio(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").text(path)


def inference_rows(sentences: DataFrame) -> DataFrame:
    """Requests of the extractor: query and an empty response."""
    return sentences.select(F.col("sentence").alias("query"), F.lit("").alias("response"))


def blocks(texts: DataFrame, header: str | None = None, least: int = 20, first_page: int = 0, pages: int | None = None) -> DataFrame:
    """Text blocks (page, block) longer than least, without those that hold the header, of a range of pages. Extraction itself is left to the caller."""
    b = texts.where(F.length(F.trim("block")) > least).where(F.col("page") >= first_page)
    if pages is not None:
        b = b.where(F.col("page") < first_page + pages)
    return b.where(~F.contains(F.lower("block"), F.lit(header.lower()))) if header else b


def rename_splits(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    given = names or {"validation": "dev"}
    table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    return rows.withColumn("split", F.coalesce(table[F.col("split")], F.col("split")))


def copy_splits(spark: SparkSession, source: str, target: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> dict[str, int]:
    """Splits' lines copied to another folder, with their numbers; a split that is not there is an error."""
    out = {}
    for s in splits:
        rows = spark.read.text(resolve(spark, f"{source}/{s}")).where(F.trim("value") != "")
        rows.write.mode("overwrite").text(f"{target}/{s}.jsonl")
        out[s] = spark.read.text(f"{target}/{s}.jsonl").count()
    return out
