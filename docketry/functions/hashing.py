"""Hashes of the ledger: canonical JSON, payload and entry hashes, and BLAKE3 from its published specification."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The prefix of an entry hash, and the hash before the first entry.
ENTRY_PREFIX, GENESIS = "ledger/v1", "GENESIS"


def canonical_json(**fields: Column) -> Column:
    """A compact JSON object with its keys in order; texts are quoted, numbers and booleans written plainly, nulls null."""
    parts = []
    for k in sorted(fields):
        value = F.to_json(F.struct(fields[k].alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.concat(F.lit(json.dumps(k) + ":"), F.substring(value, F.lit(6), F.length(value) - 6)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def hash_key(text: Column) -> Column:
    """The first 16 hexadecimal digits of the hash of a text written as JSON."""
    return F.substring(payload_hash(F.substring(F.to_json(F.struct(text.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)), 1, 16)


def corpus_hash(rows: DataFrame, order: Column, id_: Column, body: Column) -> DataFrame:
    """(corpus_hash, n): one hash over all rows in order, each as id, a zero character, body and a line feed. One value is
    made of all rows: for catalogs, which are small."""
    line = F.concat(id_, F.lit("\x00"), body, F.lit("\n"))
    held = rows.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))).alias("x"))
    return held.select(payload_hash(F.array_join(F.transform("x", lambda r: r["t"]), "")).alias("corpus_hash"), F.size("x").cast("bigint").alias("n"))


def payload_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def entry_hash(previous: Column, payload: Column, created_at: Column) -> Column:
    """Hash of prefix, previous hash, payload hash and the time's microseconds as eight big-endian bytes."""
    micros = F.unix_micros(created_at.cast("timestamp")) if not isinstance(created_at, int) else F.lit(created_at)
    return F.sha2(F.concat(F.lit(ENTRY_PREFIX).cast("binary"), previous.cast("binary"), payload.cast("binary"), F.unhex(F.lpad(F.hex(micros), 16, "0"))), 256)


# The initial state, the word permutation and the flags of BLAKE3.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF


def _compress(cv, block: bytes, length: int, counter: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *_IV[:4], counter & _M, counter >> 32 & _M, length, flags]

    def g(a, b, c, d, x, y):
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & _M
            v[d] ^= v[a]
            v[d] = (v[d] >> r1 | v[d] << 32 - r1) & _M
            v[c] = (v[c] + v[d]) & _M
            v[b] ^= v[c]
            v[b] = (v[b] >> r2 | v[b] << 32 - r2) & _M

    for turn in range(7):
        for i in range(4):
            g(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            g(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if turn < 6:
            m = [m[p] for p in _PERMUTE]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3_hex(data: bytes) -> str:
    """The 256-bit BLAKE3 hash of data, in hexadecimal."""

    def chunk(part: bytes, counter: int, root: int) -> list[int]:
        cv = list(_IV)
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, b in enumerate(blocks):
            last = i == len(blocks) - 1
            cv = _compress(cv, b, len(b), counter, (_CHUNK_START if not i else 0) | (_CHUNK_END | root if last else 0))
        return cv

    def tree(part: bytes, counter: int, root: int) -> list[int]:
        if len(part) <= 1024:
            return chunk(part, counter, root)
        chunks = -(-len(part) // 1024)
        left = (1 << (chunks - 1).bit_length() - 1) * 1024
        pair = tree(part[:left], counter, 0) + tree(part[left:], counter + left // 1024, 0)
        return _compress(_IV, struct.pack("<16I", *pair), 64, 0, _PARENT | root)

    return struct.pack("<8I", *tree(data, 0, _ROOT)).hex()


def blake3(text: Column) -> Column:
    """BLAKE3 of a text's UTF-8 bytes; null for null. An Arrow-batched function, for ledgers that ask for it."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else blake3_hex(x.encode()))

    return run(text)
