"""Language ID by hyperdimensional profiles.

Every letter slot has a random vector of +1 and -1. A run of three letters is the product of its vectors,
the first rotated twice, the second once, which binds order; a document bundles (adds) the vectors of its runs,
weighted by the root of their counts, and a language bundles its training documents. A document's language
is the prototype with the greatest cosine. Texts are lower-cased; what is not a letter is one boundary slot.

Training reads a bounded sample of the rows that it is given, PER_LANGUAGE of each language at most (those with the
smallest hash of doc_id); op7 and the pipeline give it none of the held-out third. Only texts enter a prediction.

`accepted` keeps a text whose greatest cosine is NOISE deviations of the cosine of unrelated vectors, 1 / sqrt(DIM), or more. The
cosine says little about a text of fewer than SURE letters, so these all stay.

Vectors of runs are kept between texts, KEPT at most in each worker process.

Defined cases: a text that is null or has no letter is `und` with score 0, and not accepted; if there is nothing to learn from every text is
`und` and none of SURE letters is accepted; equal cosines go to the smaller language; a null doc_id is not held out and not learned
from; rows with the same doc_id are predicted each, equal ones are learned from once; an empty table gives no rows; whole texts are
read, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, release, semi_by_id, table, written

DIM = 512
SEED = 7
SLOTS = 128
PER_LANGUAGE = 1500
PARTS = 64
UNKNOWN = "und"
#: Run vectors that a worker keeps (DIM bytes each), and runs of a text handled at once.
KEPT = 1 << 15
AT_ONCE = 4096
NOISE = 3.2
SURE = 40
#: Languages of a model at most; it is sent to all tasks. More are an error, not a cut.
LANGUAGES = 2000

PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def letter_slots() -> np.ndarray:
    """The slot of each code point of the lower plane: 0 no letter, 1-26 a-z, else 27 and up by code point."""
    slots = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            slots[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SLOTS - 27)
    return slots


class Profiles:
    """Vectors of runs, made when first met; one for each worker process."""

    def __init__(self, dim: int = DIM, seed: int = SEED, kept: int = KEPT):
        rng = np.random.default_rng(seed)
        self.dim, self.kept = dim, kept
        self.letters = rng.choice(np.array([-1, 1], np.int8), (SLOTS, dim))
        self.slots = letter_slots()
        self.row = np.full(SLOTS**3, -1, np.int32)
        self.vectors = np.empty((kept, dim), np.int8)
        self.used = 0

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of at most AT_ONCE runs."""
        new = codes[self.row[codes] < 0]
        if self.used + len(new) > self.kept:
            self.row[:] = -1
            self.used, new = 0, codes
        if len(new):
            to = self.used + len(new)
            a, b, c = new // SLOTS**2, new // SLOTS % SLOTS, new % SLOTS
            self.vectors[self.used : to] = np.roll(self.letters, 2, axis=1)[a] * np.roll(self.letters, 1, axis=1)[b] * self.letters[c]
            self.row[new] = np.arange(self.used, to)
            self.used = to
        return self.vectors[self.row[codes]]

    def runs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three slots whose middle is a letter, and their counts."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.slots[np.minimum(cp, 0xFFFF)].astype(np.int32)
        high = cp > 0xFFFF
        if high.any():
            s[high] = [27 + c % (SLOTS - 27) if chr(c).isalpha() else 0 for c in cp[high].tolist()]
        s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])] if len(s) else s  # a run of boundaries is one
        s = np.concatenate([[0], s, [0]])
        codes = (s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:]
        codes = codes[s[1:-1] > 0]
        if len(codes) > 50_000:
            n = np.bincount(codes, minlength=SLOTS**3)
            u = np.flatnonzero(n)
            return u, n[u]
        return np.unique(codes, return_counts=True)

    def vector(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """The text's bundle, of length 1, and how many letters it has; None without one."""
        codes, n = self.runs(text or "")
        if not len(codes):
            return None, 0
        v = np.zeros(self.dim, np.float32)
        weight = np.sqrt(n).astype(np.float32)
        for at in range(0, len(codes), AT_ONCE):
            v += weight[at : at + AT_ONCE] @ self.of(codes[at : at + AT_ONCE]).astype(np.float32)
        size = float(np.sqrt(v @ v))
        return v / size if size else v, int(n.sum())


_profiles: dict[tuple, Profiles] = {}


def profiles(dim: int, seed: int) -> Profiles:
    if (dim, seed) not in _profiles:
        _profiles[dim, seed] = Profiles(dim, seed)
    return _profiles[dim, seed]


def train(labelled: DataFrame, dim: int = DIM, seed: int = SEED, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of length 1) from (doc_id, text, lang), bounded by per_language rows of each language."""
    # a language with most rows is ranked in PARTS parts first
    labelled = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    rows = labelled.select("doc_id", "lang", "h", "t", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).alias("part"))
    rows = rows.groupBy("lang", "part", "h", "doc_id", "t").agg(F.count("*"))
    for by in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id", "t"))).where(F.col("r") <= per_language)
    # at most LANGUAGES * per_language of these, as more languages are an error
    ids = written(rows.select("doc_id", "lang", "t"), "sample")
    sample = semi_by_id(labelled, ids, ["doc_id", "lang", "t"], ids.count()).dropDuplicates(["doc_id", "lang", "t"]).select("text", "lang")

    def sums(it):
        held: dict[str, np.ndarray] = {}
        p = profiles(dim, seed)
        for b in batches(it, 512):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                v, _ = p.vector(text)
                if v is not None:
                    held[lang] = held.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"lang": list(held), "at": [list(range(dim)) for _ in held], "v": [x.tolist() for x in held.values()]}, schema=pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))]))

    parts = sample.mapInArrow(sums, "lang string, at array<int>, v array<double>")
    added = parts.select("lang", F.explode(F.arrays_zip("at", "v")).alias("x")).groupBy("lang", "x.at").agg(F.sum(F.round("x.v", 9).cast("decimal(30,9)")).cast("double").alias("v"))
    rows = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    protos = np.array([[x["v"] for x in r["x"]] for r in rows], np.float32).reshape(len(rows), dim)
    return [r["lang"] for r in rows], protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """docs (whatever its columns) with lang_pred and score; its texts are read whole."""
    languages, protos = model
    names = docs.columns

    def run(it):
        p = profiles(dim, seed)
        for b in batches(it, 512):
            lang, score = [], []
            for text in b.column("text").to_pylist():
                v = p.vector(text)[0] if languages else None
                if v is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                else:
                    c = protos @ v
                    best = int(np.argmax(c))
                    lang.append(languages[best])
                    score.append(min(1.0, max(0.0, float(c[best]))))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names if k != "text"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(k for k in names if k != "text"), "lang_pred", "score"])
        release()

    return docs.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in docs.dtypes if k != "text") + ", lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """The rows of docs, all their columns, whose text has letters and is nearer to a language than to noise, or too short to tell."""
    languages, protos = model
    least = NOISE / np.sqrt(dim)

    def run(it):
        p = profiles(dim, seed)
        for b in batches(it, 512):
            keep = []
            for text in b.column("text").to_pylist():
                v, letters = p.vector(text)
                keep.append(v is not None and (letters < SURE or bool(languages) and float((protos @ v).max()) >= least))
            yield b.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = train(d.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(d.select("doc_id", held_out().alias("held_out"), "text"), model)
