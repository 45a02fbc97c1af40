"""Encoding of a whole corpus with a public byte-level BPE vocabulary, and back.

The pattern of the vocabulary cuts a text into words that merge on their own, so a word's ids do not depend on its text.
Documents are cut into words with positions, in blocks whose words are numbered; all blocks' words are made distinct over
the corpus, each distinct word is encoded once, its ids are joined back to the blocks that hold it, and every block puts
its documents together by position. What is shuffled is a dictionary per block, not every occurrence of a word.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import materialize

#: Characters of text in a block, about; a block's words are numbered together.
BLOCK_CHARS = 4_000_000
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_folder() -> str:
    """The folder of the public vocabularies: DOCKETRY_TOKENIZERS, or the place of the installed package, or /opt/tokenizers."""
    if at := os.environ.get("DOCKETRY_TOKENIZERS"):
        return at
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def _parsed(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file."""
    with open(path, "rb") as f:
        return _parsed(f.read())


def _encoding(of: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=of, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file; it knows no special tokens, so their strings are ordinary text."""
    return _encoding(ranks(path))


def _sent(spark: SparkSession, path: str):
    """The rank file, to executors, which need not hold it; as large as the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_HELD: dict[int, object] = {}


def _encoder_of(sent):
    """The encoder of a rank file that was sent, made once in a Python worker."""
    at = hash(sent.value)
    if at not in _HELD:
        _HELD[at] = _encoding(_parsed(sent.value))
    return _HELD[at]


@lru_cache(maxsize=1)
def _words():
    import regex

    return regex.compile(PATTERN).findall


def rank_file(name: str = "byte_bpe_50k") -> str:
    return os.path.join(vocabulary_folder(), f"{name}.tiktoken")


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BLOCK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, the number of every word in order, and the distinct words by number."""
    find, words, lens = _words(), [], np.zeros(len(texts), np.int32)
    for i, t in enumerate(texts):
        if t:
            found = find(t)
            lens[i] = len(found)
            words += found
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    return lens, coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32), coded.dictionary


def _flat(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return sizes, np.fromiter((x for p in parts for x in p), np.int32, int(sizes.sum()))


def _take(order: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number order[0], order[1], ... put one after another, and where each begins in the result."""
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = sizes[order]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[order], n)
    return values[at], np.concatenate([[0], ends])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in _slices(texts):
            lens, order, words = _numbered(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), _one_list(ids.slice(a, b - a)), pa.array([zlib.compress(lens.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(order.tobytes(), 1)], pa.binary()), _one_list(words.cast(pa.string()))],
                ["block", "ids", "lens", "words_at", "words"],
            )
            number += 1


def _one_list(values: pa.Array) -> pa.Array:
    values = pa.concat_arrays([values])
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _encode_words(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder_of(sent).encode_ordinary
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array([np.asarray(enc(w), np.uint32).tobytes() for w in words.to_pylist()], pa.binary())], ["word", "coded"])

    return run


def _assemble(key, blocks: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of one block; words may be empty, if no document has any."""
    at = words.column("at").to_numpy()
    coded = words.column("coded").to_pylist()
    parts: list[bytes] = [b""] * len(at)
    for i, c in zip(at, coded, strict=True):
        parts[i] = c
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    values = np.frombuffer(b"".join(parts), np.uint32).astype(np.int32)
    out = []
    for row in range(blocks.num_rows):
        lens = np.frombuffer(zlib.decompress(blocks.column("lens")[row].as_py()), np.int32)
        order = np.frombuffer(zlib.decompress(blocks.column("words_at")[row].as_py()), np.uint32)
        ids, offsets = _take(order, sizes, values)
        doc_offsets = offsets[np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])].astype(np.int32)
        out.append(pa.Table.from_arrays([blocks.column("ids")[row].values, pa.ListArray.from_arrays(pa.array(doc_offsets), pa.array(ids))], ["id", "ids"]))
    return pa.concat_tables(out)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every text, special tokens neither added nor recognised.

    Null and empty texts have an empty list. Every row of docs gives a row, also of repeated or null ids; other columns
    are ignored. vocabulary is a rank file, by default the 50k byte-level one."""
    path = vocabulary or rank_file()
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = materialize(plain.mapInArrow(_blocks, f"block bigint, ids array<{kind}>, lens binary, words_at binary, words array<string>"), "blocks")
    words = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    # a row per distinct word of the corpus; its blocks' rows meet it in a plain join, which may be split where a word is in very many
    once = words.select("word").distinct().mapInArrow(_encode_words(_sent(docs.sparkSession, path)), "word string, coded binary")
    coded = words.join(once, "word").select("of", "at", "coded")
    whole = blocks.select("block", "ids", "lens", "words_at").groupBy("block").cogroup(coded.groupBy("of"))
    return whole.applyInArrow(_assemble, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(token, bytes): the vocabulary as a table; its size is that of the file, whatever the corpus."""
    rows = [(i, bytearray(b)) for b, i in ranks(vocabulary or rank_file()).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id_col, text): texts put together again by joining ids to the token-byte table; an empty list gives ''.

    Bytes that are no UTF-8 become replacement marks. id_col must be unique."""
    table = F.broadcast(token_bytes(encoded.sparkSession, vocabulary))  # 50,256 rows, whatever the corpus
    at = encoded.select(id_col, F.posexplode(ids_col).alias("at", "token"))
    pieces = at.join(table, "token").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8")
    return encoded.select(id_col).join(pieces.select(id_col, text.alias("text")), id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = _encoder_of(sent).encode_ordinary, {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                lens, order, words = _numbered(texts[a:b])
                if len(known) > 500_000:
                    known.clear()  # only a cache: counts need no shuffle, so each task sizes its own words
                sizes = np.zeros(len(words), np.int64)
                for i, w in enumerate(words.to_pylist()):
                    if (n := known.get(w)) is None:
                        n = known[w] = len(enc(w))
                    sizes[i] = n
                sums = np.concatenate([[0], np.cumsum(sizes[order])])[np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(sums), pa.int64())], ["id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_tokens) of every row, 0 for null and empty texts; needs no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_count(_sent(docs.sparkSession, vocabulary or rank_file())), f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
