"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space in blocks of documents; a block keeps its distinct words once and each
document as positions in them. The blocks' words meet by hash of the word, where each distinct word of
the corpus is encoded once; ids go back to the blocks and are joined to the documents by position. What
moves is packed: a row holds a block's words of one hash range. Neither texts nor single words are
shuffled, and the word table, which grows with the corpus, is never in one place. Decoding joins ids to
the table of pieces, which has as many rows as the vocabulary and is sent to every task.

The tokenizer's own rule never joins across white space, so ids of a word do not depend on its neighbours.
Texts with control characters or beyond Latin scripts are normalised by the library itself.

Defined cases: a null text counts as empty and has no ids; an empty list decodes to the empty text;
special tokens in a text are single ids, as in the library; rows repeated under one doc_id are encoded each;
an empty table gives no rows; other columns are ignored unless asked for.
"""

from __future__ import annotations

import os
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, partitions, release, table, written

#: Bytes of text in a block, about, and of words in a hash range of the corpus.
BLOCK_BYTES = 16 << 20
RANGE_ROWS = 8192
LEVEL = 9
#: White space as the tokenizer's regular expressions have it; Python's also has 1C to 1F (hex).
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Texts of these characters alone are already composed, and lower() goes by single characters.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-įı-ɏ]*")

SPLIT = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("codes", pa.list_(pa.binary())), ("counts", pa.binary())])
CODED = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

_tokenizers: dict[str, tuple] = {}


def tokenizer(path: str) -> tuple:
    """(as in the file, without normalizer, pattern of its special tokens)"""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (whole, bare):
            t.no_padding()
            t.no_truncation()
        bare.normalizer = normalizers.Sequence([])
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        _tokenizers[path] = whole, bare, re.compile("(" + "|".join(map(re.escape, special)) + ")" if special else r"(?!)")
    return _tokenizers[path]


def split(text: str, path: str) -> list[str]:
    """Lower-cased words at white space; special tokens stand alone with a leading space, which no word has."""
    whole, _, special = tokenizer(path)
    if "<|" in text and special.search(text):
        return [w for i, part in enumerate(special.split(text)) for w in ([" " + part] if i % 2 else split_plain(part, whole))]
    return split_plain(text, whole)


def split_plain(text: str, whole) -> list[str]:
    if PLAIN.fullmatch(text):
        return text.lower().split()
    return [w for w in WHITE.split(whole.normalizer.normalize_str(text)) if w]


def encode_words(words: list[str], path: str) -> list[list[int]]:
    whole, bare, _ = tokenizer(path)
    out = [e.ids for e in bare.encode_batch_fast([w if w[0] != " " else "" for w in words], add_special_tokens=False)]
    for i, w in enumerate(words):
        if w[0] == " ":
            out[i] = [whole.token_to_id(w[1:])]
    return out


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def packed(a: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte by byte of their places, compressed."""
    planes = np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4)
    return squeezed(np.ascontiguousarray(planes.T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def coded(ranks: np.ndarray) -> list[bytes]:
    """Positions of words, frequent ones first: a byte for the first 255, two for most others, up to seven for the rest, each in its own stream."""
    more = ranks[ranks >= 255] - np.uint32(255)
    high = more >> np.uint32(8)
    rest = high[high >= 255] - np.uint32(255)
    places = [(rest >> np.uint32(k)) & np.uint32(255) for k in (0, 8, 16, 24)]
    return [squeezed(x.astype(np.uint8).tobytes()) for x in (np.minimum(ranks, 255), np.minimum(high, 255), more & np.uint32(255), *places)]


def uncoded(streams: list[bytes]) -> np.ndarray:
    a, high, low, *places = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).astype(np.uint32) for x in streams)
    high[high == 255] = 255 + (places[0] | places[1] << np.uint32(8) | places[2] << np.uint32(16) | places[3] << np.uint32(24))
    a[a == 255] = 255 + (high << np.uint32(8) | low)
    return a


def positions(counts: np.ndarray) -> np.ndarray:
    """The position of each word of a block, words being in order of (range, word): frequent ones first, else in that order."""
    often = np.argsort(-counts.astype(np.int64), kind="stable")
    at = np.empty(len(counts), np.uint32)
    at[often] = np.arange(len(counts))
    return at


def _block(texts: list, doc_ids: list, block: int, ranges: int, path: str):
    """A row for each hash range with its words in order, and one with the documents as positions in the block's words, frequent ones first."""
    place: dict[str, int] = {}
    sizes, codes = [], []
    for text in texts:
        words = split(text or "", path)
        sizes.append(len(words))
        for w in set(words).difference(place):
            place[w] = len(place)
        codes.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
    flat, words = np.concatenate(codes), list(place)
    of = [xxhash.xxh3_64_intdigest(w) % ranges for w in words]
    order = sorted(range(len(words)), key=lambda i: (of[i], words[i]))
    counts = np.bincount(flat, minlength=len(words))[np.array(order, np.int64)]
    rank = np.empty(len(words), np.uint32)
    rank[np.array(order, np.int64)] = positions(counts)
    rows = {k: [] for k in SPLIT.names}
    for r, mine in groupby(order, key=of.__getitem__):
        for k, v in zip(SPLIT.names, (block, r, squeezed("\n".join([words[i] for i in mine]).encode()), None, None, None, None), strict=True):
            rows[k].append(v)
    for k, v in zip(SPLIT.names, (block, None, None, doc_ids, packed(np.array(sizes)), coded(rank[flat]), packed(counts)), strict=True):
        rows[k].append(v)
    return pa.RecordBatch.from_pydict(rows, schema=SPLIT)


def _splitter(ranges: int, path: str):
    def run(it):
        block = TaskContext.get().partitionId() << 32
        texts, ids, held = [], [], 0
        for b in batches(it, 256):
            for text, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                texts.append(text)
                ids.append(i)
                held += len(text or "")
                if held >= BLOCK_BYTES:
                    yield _block(texts, ids, block, ranges, path)
                    texts, ids, held, block = [], [], 0, block + 1
        if texts:
            yield _block(texts, ids, block, ranges, path)
        release()

    return run


def _encoder(path: str):
    def run(key, tab):
        """The blocks' words of one hash range: each distinct one is encoded once."""
        release()  # what the group before has left
        words = [zstandard.ZstdDecompressor().decompress(x).decode().split("\n") for x in tab.column("words").to_pylist()]
        ends = np.cumsum([0, *map(len, words)])
        coded = pa.chunked_array([pa.array(w, pa.string()) for w in words]).combine_chunks().dictionary_encode()
        del words
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for i in range(0, len(coded.dictionary), 20_000):
            got = encode_words(coded.dictionary[i : i + 20_000].to_pylist(), path)
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((x for y in got for x in y), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        start = np.cumsum(size) - size
        index, out = coded.indices.to_numpy(), []
        for k in range(tab.num_rows):
            w = index[ends[k] : ends[k + 1]]
            out.append((packed(size[w]), packed(gather(flat, start[w], size[w]))))
        return pa.table([tab.column("block"), tab.column("range"), [x[0] for x in out], [x[1] for x in out]], schema=CODED)

    return run


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each pair, one after the other."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[np.arange(total) + shift]


def _assembler(path: str, text: bool):
    """Ids joined back by position: a block's documents and its words' ids; with text, also what the ids decode to."""
    schema, table_ = IDS.append(pa.field("text", pa.string())) if text else IDS, []

    def run(key, docs, coded):
        release()
        if not docs.num_rows:
            return schema.empty_table()
        coded = coded.sort_by("range")
        counts, words = (unpacked(docs.column(k)[0].as_py()) for k in ("counts", "sizes"))
        at, codes = positions(counts), uncoded(docs.column("codes")[0].as_py())
        each = [unpacked(x) for x in coded.column("sizes").to_pylist()]
        in_order = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
        parts = [unpacked(x) for x in coded.column("ids").to_pylist()]
        flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        size, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[at], start[at] = in_order, np.cumsum(in_order) - in_order
        if text and not table_:
            table_.append(pa.array(pieces(path), pa.large_string()))
        ids = docs.column("doc_ids")[0].values
        out, ends = [], np.concatenate([[0], np.cumsum(words.astype(np.int64))])
        for i in range(0, len(words), 1000):
            j = min(i + 1000, len(words))
            c = codes[ends[i] : ends[j]]
            cum = np.concatenate([[0], np.cumsum(size[c])])
            lists = pa.ListArray.from_arrays(pa.array(cum[ends[i : j + 1] - ends[i]].astype(np.int32)), pa.array(gather(flat, start[c], size[c])))
            out.append(pa.record_batch([ids[i:j], lists, *(joined(lists, x) for x in table_)], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def encode(docs: DataFrame, path: str, text: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, as the tokenizers library encodes its text without adding special tokens; with text, also the decoded text.

    Decoding where the ids are joined spares a second Python worker for each running task; workers stay, and hold memory, long after.
    """
    ranges = partitions(docs.sparkSession, docs.count(), RANGE_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = written(rows.mapInArrow(_splitter(ranges, path), "block long, range int, words binary, doc_ids array<long>, sizes binary, codes array<binary>, counts binary"), "words")
    coded = t.where("range is not null").select("block", "range", "words").groupBy("range").applyInArrow(_encoder(path), "block long, range int, sizes binary, ids binary")
    blocks = t.where("range is null").select("block", "doc_ids", "sizes", "codes", "counts")
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assembler(path, text), "doc_id long, ids array<int>" + ", text string" * text)


def pieces(path: str) -> list[str]:
    """The piece of each id: as many as the vocabulary has."""
    whole = tokenizer(path)[0]
    return [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())]


def joined(lists: pa.ListArray, table_: pa.Array) -> pa.Array:
    """The pieces of each list of ids, joined by spaces."""
    ends = lists.offsets.to_numpy()
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int64)), table_.take(lists.flatten())), pa.scalar(" ", pa.large_string())).cast(pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column text: the ids' pieces joined by spaces, as the library does for a file without decoder."""
    names = encoded.columns

    def run(it):
        table_ = pa.array(pieces(path), pa.large_string())
        for big in it:
            for b in batches([big], 256):
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), joined(b.column("ids"), table_)], names=[*names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in encoded.dtypes) + ", text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode(docs, path, text=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path or default_path())
