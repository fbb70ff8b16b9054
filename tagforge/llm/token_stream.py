"""Token-id output as Arrow files of equal-length sequences and masks.

A shard is one Arrow IPC file whose record batches hold two fixed-size lists, `tokens` (uint16 if
the vocabulary allows, else uint32) and `mask` (bits: token or padding), so sequence i is row i % BATCH of batch
i // BATCH, read without copying from a memory map. Beside it a file with the documents of the shard: id, first
token in the shard, number of tokens. Shards follow doc_id; a manifest row per shard gives the tokens before it.

Documents are dealt by ranges of doc_id and sorted there; a task streams its texts into its shard, so
memory is one batch of texts and one batch of sequences. A file is written under an attempt's own name
and moved into place, so a task that is run again overwrites whole files with the same content.

Defined cases: a null text is empty and has only the end id; null ids come first; rows that repeat an id keep all, those
of one id ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, new_path, partitions, table, written

LENGTH = 2048
BATCH = 64
IN_SHARD = 4096
END_ID = 2

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SHARD = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

#: How byte-level BPE splits text before its merges: a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that all regular expression libraries class alike.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-\u024f]*")


class ByteBpe:
    """Encodes text as the tokenizers library does with the file at path.

    The file's own merges run in tiktoken's faster loop if it can take them: their order must be that of the ids, and
    the text of well-known characters, without special tokens. All else goes to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._fast(json.load(f))

    @staticmethod
    def _fast(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[x + y] for x, y in pairs]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if made != sorted(set(made)) or len(made) + 256 != len(vocab.keys() - special):
            return None
        # the printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = dict(zip(map(chr, printable), printable, strict=True)) | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
        import tiktoken

        ranks = {bytes(stand[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The text's ids."""
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def file_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Streams documents' ids into one shard."""

    def __init__(self, sink, length: int, wide: bool = True, batch: int = BATCH):
        self.schema, self.length, self.size = file_schema(length, wide), length, length * batch
        self.kind = np.uint32 if wide else np.uint16
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.size:
            self._flush(self.held // self.size * self.size)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.parts)
        for i in range(0, n, self.size):
            self._write(ids[i : i + self.size], np.ones(self.size, bool))
        self.parts, self.held = [ids[n:]], len(ids) - n

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.parts)
            pad = -len(ids) % self.length
            self._write(np.concatenate([ids, np.zeros(pad, self.kind)]), np.arange(len(ids) + pad) < len(ids))
        self.out.close()


class TokenFile:
    """Random access to a shard's sequences; with a local file nothing is copied."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return n and (n - 1) * BATCH + self.reader.get_batch(n - 1).num_rows

    def column(self, name: str, batch: int) -> np.ndarray:
        """Whole batch, one row for each sequence."""
        return self.reader.get_batch(batch).column(name).flatten().to_numpy(zero_copy_only=name == "tokens").reshape(-1, self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.column("tokens", i // BATCH)[i % BATCH], self.column("mask", i // BATCH)[i % BATCH]

    def slices(self, start: int, n: int):
        """The tokens from start on, by batch."""
        size = self.length * BATCH
        while n > 0:
            part = self.column("tokens", start // size).reshape(-1)[start % size :][:n]
            yield part
            start, n = start + len(part), n - len(part)

    def close(self) -> None:
        self.source.close()


def _writer(folder: str, tokenizer: str, end_id: int | None, length: int):
    def write(it):
        context = TaskContext.get()
        # each attempt has files of its own; the manifest, which Spark commits, names those of the one that counts
        shard = context.partitionId()
        own = f"shard-{shard:06d}-{context.taskAttemptId()}"
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        bpe, end = encoder(tokenizer), np.array([] if end_id is None else [end_id], np.uint32)
        docs = 0
        with fs.open_output_stream(f"{base}/{own}") as sink, fs.open_output_stream(f"{base}/{own}.docs") as doc_sink:
            out, index = ShardWriter(sink, length, bpe.tokenizer.get_vocab_size() > 1 << 16 or (end_id or 0) >= 1 << 16), pa.ipc.new_file(doc_sink, DOCS)
            for batch in batches(it, 512):
                starts, sizes = [], []
                for text in batch.column("text").to_pylist():
                    ids = np.concatenate([bpe.encode(text or ""), end])
                    starts.append(out.total)
                    sizes.append(len(ids))
                    if len(ids):
                        out.add(ids)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
                docs += batch.num_rows
            out.close()
            index.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{folder}/{own}"]), pa.array([docs], pa.int64()), pa.array([out.total], pa.int64())], schema=SHARD)

    return write


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, length: int = LENGTH, in_shard: int = IN_SHARD, rows: int | None = None) -> DataFrame:
    """Writes docs' ids under folder (a URI that executors reach); gives the manifest: shard, path, docs, tokens, before."""
    spark = docs.sparkSession
    n = partitions(spark, docs.count() if rows is None else rows, in_shard)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    shards = written(dealt.mapInArrow(_writer(folder, tokenizer, end_id, length), "shard long, path string, docs long, tokens long"), "shards")
    run = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return shards.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))


def _reader(it):
    for batch in it:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            tokens = TokenFile(path)
            fs, p = pafs.FileSystem.from_uri(path + ".docs")
            with fs.open_input_file(p) as f:
                index = pa.ipc.open_file(f)
                for i in range(index.num_record_batches):
                    d = index.get_batch(i)
                    starts, sizes, sums = d.column("start").to_numpy(), d.column("n_tokens").to_numpy(), []
                    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                        crc = 0
                        for part in tokens.slices(s, n):
                            crc = zlib.crc32(part.astype("<u4", copy=False), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array(starts + before), d.column("n_tokens"), pa.array(sums, pa.int64())], schema=READ)
            tokens.close()


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "before").repartition(n, "path").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_documents(write_files(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer))
